"""Queries over appended chains, many as-of times, the bucketed store and ranks over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemo.operators import log as L
from mnemo.operators import order as O
from mnemo.operators import predicates as P
from mnemo.operators import working as W
from mnemo.plans import fixtures as T
from mnemo.plans.registry import query
from mnemo.plans.state_queries import CHAIN, HALF, HEAT, NOW, halves
from mnemo.sources.durable import job_dir
from mnemo.streaming import store as B


def place(spark, name: str) -> str:
    return f"{job_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("chain_appended", "audit_log", CHAIN + " SELECT id, chain_id, prev_root, root_hash FROM c", recursive=True)
def chain_appended(spark, sf):
    """The log appended in three batches of which the second repeats rows of the first: all roots are those of one chain."""
    log, path = T.audit_log(spark, sf), place(spark, "chain")
    third = F.floor(log.select(F.max("id") / 3).scalar())
    for b, part in enumerate((F.col("id") <= third, F.col("id").between(third / 2, 2 * third), F.col("id") > 2 * third)):
        L.append_chain(log.where(part), path, b)
    return L.stored_chain(spark, path).select("id", "chain_id", "prev_root", "root_hash")


DAYS = """days AS (SELECT DISTINCT (micros // 86400000000 + 1) * 86400000000 AS ends FROM audit_log), w AS (SELECT key, op_type, after, micros, id, min(micros) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM audit_log)
 SELECT ends AS micros, key, after AS value FROM w JOIN days ON ends >= micros AND (until IS NULL OR ends < until) WHERE op_type <> 'delete' AND (until IS NULL OR until > micros)"""


@query("states_each_day", "audit_log", DAYS)
def states_each_day(spark, sf):
    """The state at the end of every day on which something changed."""
    log = T.audit_log(spark, sf)
    day = F.floor(F.col("micros") / 86_400_000_000)
    return L.states_at(log, log.select(((day + 1) * 86_400_000_000).alias("micros")))


@query("bucketed_upsert", "commits", f"""cur AS (SELECT * FROM commits WHERE seq <= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), inc AS (SELECT * FROM commits WHERE seq > {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
 SELECT key, coalesce(inc.value, cur.value) AS value, coalesce(cur.session_id, inc.session_id) AS session_id, coalesce(cur.access_count, 0) + CASE WHEN cur.key IS NULL THEN inc.access_count + 1 WHEN inc.key IS NULL THEN 1 ELSE 2 END AS access_count FROM cur FULL JOIN inc USING (key)""")  # fmt: skip
def bucketed_upsert(spark, sf):
    """Both halves of the commits into a bucketed store, the second one twice, which changes nothing."""
    current, batch = halves(spark, sf)
    store = place(spark, "store")
    write = B.bucketed_writer(store, f"{store}-log", NOW)
    for b, rows in enumerate((current, batch, batch)):
        write(rows, min(b, 1))
    return B.current(spark, store).select("key", "value", "session_id", "access_count")


@query("canonical_rank", "memories", """x AS (SELECT *, k % 9 = 0 AS canonical, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS p FROM memories WHERE NOT (ttl IS NOT NULL AND 1706745600.0 - created_at > ttl))
 SELECT key, row_number() OVER (ORDER BY canonical DESC, p, is_verified DESC, current_strength * importance DESC, created_at DESC, key) AS rank FROM x""")  # fmt: skip
def canonical_rank(spark, sf):
    """The contract's order over all entries."""
    level = F.when(F.col("k") % 3 == 0, "high").when(F.col("k") % 3 == 1, "normal").otherwise("low")
    m = T.memories(spark, sf).withColumns({"canonical": F.col("k") % 9 == 0, "priority": level})
    return P.canonical_order(m, NOW).select("key", "rank")


@query("running_value", "commits", "SELECT seq, sum(k) OVER (ORDER BY created_at, seq)::BIGINT AS until FROM commits")
def running_value(spark, sf):
    return O.running_sum(T.commits(spark, sf), [F.col("created_at"), F.col("seq")], "k").select("seq", F.col("until").cast("long").alias("until"))


BUSY = HEAT.replace("created_at AS t", "created_at / 3600 AS t")


@query("hot_sessions_busy", "memories", BUSY + " SELECT memory_type AS session_id, round(count(*) / 64, 6) AS usage, count(*) FILTER (heat >= 0.7) AS hot FROM memories JOIN last USING (key) GROUP BY 1 HAVING count(*) / 64 >= 0.8 AND count(*) FILTER (heat >= 0.7) >= 1", recursive=True)
def hot_sessions_busy(spark, sf):
    """An hour of the log counts as a second, so keys get hot; all entries of a type are one session of 64 slots."""
    heat = W.heat(T.commits(spark, sf).withColumn("created_at", F.col("created_at") / 3600))
    m = T.memories(spark, sf).join(heat, "key").withColumn("session_id", F.col("memory_type"))
    return W.hot_sessions(m, 64).withColumn("usage", F.round("usage", 6))
