"""Queries over the store, its log, belief revision and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import strength as S
from mnemo.operators import agents as A
from mnemo.operators import forgetting as G
from mnemo.operators import log as L
from mnemo.operators import predicates as P
from mnemo.operators import revise as R
from mnemo.operators import upsert as U
from mnemo.operators import working as W
from mnemo.plans import fixtures as T
from mnemo.plans.registry import query

NOW = T.NOW
#: 2024-01-15, -10 and -20 in microseconds.
MID, EARLY, LATE = 1705276800000000, 1704844800000000, 1705708800000000
TOLD = "op_type IN ('create', 'update', 'delete')"
STATE = "SELECT key, arg_max(CASE WHEN after IS NULL THEN '' ELSE after END, id) AS value, arg_max(op_type, id) AS op FROM audit_log WHERE micros <= {} GROUP BY key"
DECAY = """ltp AS (SELECT *, CASE WHEN importance >= 0.9 AND verification_score >= 0.8 THEN 0.1 WHEN importance >= 0.7 OR (verification_score >= 0.5 AND access_count >= 5) THEN 0.3
 WHEN importance >= 0.5 OR access_count >= 10 THEN 0.5 ELSE 1.0 END::DOUBLE AS slow, (1706745600.0 - last_accessed) / 86400.0 AS days,
 CASE memory_type WHEN 'working' THEN 0.05 WHEN 'episodic' THEN 0.02 WHEN 'procedural' THEN 0.015 WHEN 'semantic' THEN 0.005 ELSE 0.01 END::DOUBLE AS rate,
 CASE memory_type WHEN 'working' THEN 1 WHEN 'episodic' THEN 3 WHEN 'procedural' THEN 7 WHEN 'semantic' THEN 14 ELSE 7 END::DOUBLE AS crossing,
 CASE memory_type WHEN 'working' THEN 0.5 WHEN 'episodic' THEN 0.35 WHEN 'procedural' THEN 0.3 WHEN 'semantic' THEN 0.2 ELSE 0.25 END::DOUBLE AS beta,
 CASE WHEN access_count >= 20 THEN 1.2 WHEN access_count >= 10 THEN 1.1 WHEN access_count >= 5 THEN 1.05 ELSE 1.0 END::DOUBLE AS boost,
 CASE memory_type WHEN 'working' THEN 0.3 WHEN 'episodic' THEN 0.08 WHEN 'procedural' THEN 0.05 WHEN 'semantic' THEN 0.03 ELSE 0.05 END::DOUBLE AS floor_at FROM memories),
 decayed AS (SELECT *, least(1.0, greatest(0.0, current_strength * least(1.0, boost * CASE WHEN days < crossing THEN exp(-rate * slow * days) ELSE exp(-rate * slow * crossing) * pow(days / crossing, -beta * slow) END))) AS strength FROM ltp) """
six = lambda c: F.round(c, 6)


@query("top_after_decay", "audit_log memories", DECAY + f"""
 , state AS ({STATE.format(MID)}), live AS (SELECT * FROM decayed JOIN (SELECT key FROM state WHERE op <> 'delete') USING (key) WHERE strength >= floor_at),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY importance * round(strength, 6) DESC, key) AS r FROM live)
 SELECT memory_type, r::INT AS rank, key, round(strength, 6) AS strength FROM ranked WHERE r <= 5""".replace(" , state", ", state", 1))  # fmt: skip
def top_after_decay(spark, sf):
    state = L.state_at(T.audit_log(spark, sf), MID).select("key")
    kept = G.decay_pass(T.memories(spark, sf).join(state, "key", "left_semi"), NOW)
    kept = kept.withColumn("strength", six("current_strength"))
    return G.top_per_group(kept, "memory_type", [F.desc(F.col("importance") * F.col("strength")), F.col("key")], 5, salts=16).select("memory_type", "rank", "key", "strength")


# the change log

CHAIN = """h AS (SELECT *, sha256(concat_ws(':', op_type, key, micros::VARCHAR, coalesce(before, 'None'), coalesce(after, 'None'))) AS data_hash, row_number() OVER (PARTITION BY chain_id ORDER BY id) AS n FROM audit_log),
 c AS (SELECT chain_id, n, id, data_hash, repeat('0', 64) AS prev_root, sha256(repeat('0', 64) || ':' || data_hash) AS root_hash FROM h WHERE n = 1
 UNION ALL SELECT h.chain_id, h.n, h.id, h.data_hash, c.root_hash, sha256(c.root_hash || ':' || h.data_hash) FROM c JOIN h ON h.chain_id = c.chain_id AND h.n = c.n + 1)"""


@query("chain_roots", "audit_log", CHAIN + " SELECT chain_id, count(*) AS entries, arg_max(root_hash, n) AS root FROM c GROUP BY chain_id", recursive=True)
def chain_roots(spark, sf):
    return L.build_chain(T.audit_log(spark, sf)).groupBy("chain_id").agg(F.count("*").alias("entries"), F.max_by("root_hash", "id").alias("root"))


@query("chain_verified", "audit_log", "SELECT chain_id, chain_id <> 'a1' AS valid, count(*) AS entries, CASE WHEN chain_id = 'a1' THEN min(CASE WHEN id % 1000 = 501 THEN id END) END AS first_error FROM audit_log GROUP BY chain_id")
def chain_verified(spark, sf):
    """One row in a thousand of chain a1 is tampered with."""
    chained = L.build_chain(T.audit_log(spark, sf))
    forged = chained.withColumn("after", F.when(F.col("id") % 1000 == 501, "forged").otherwise(F.col("after")))
    return L.verify_chain(forged).select("chain_id", "valid", "entries", "first_error")


@query("log_history", "audit_log", "SELECT key, id, op_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC)::INT AS rank FROM audit_log) WHERE rank <= 3")
def log_history(spark, sf):
    return L.history(T.audit_log(spark, sf), 3).select("key", "id", "op_type", "rank")


@query("state_at", "audit_log", f"SELECT key, value FROM ({STATE.format(MID)}) WHERE op <> 'delete'")
def state_at(spark, sf):
    return L.state_at(T.audit_log(spark, sf), MID)


@query("states_at", "audit_log", " UNION ALL ".join(f"SELECT {t}::BIGINT AS micros, key, value FROM ({STATE.format(t)}) WHERE op <> 'delete'" for t in (EARLY, MID, LATE)))
def states_at(spark, sf):
    times = spark.range(3).select((F.lit(EARLY) + F.col("id") * (MID - EARLY)).alias("micros"))
    return L.states_at(T.audit_log(spark, sf), times)


DIFF = f"""a AS (SELECT key, value AS before FROM ({STATE.format(EARLY)}) WHERE op <> 'delete'), b AS (SELECT key, value AS after FROM ({STATE.format(LATE)}) WHERE op <> 'delete')
 SELECT key, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS status, before, after FROM a FULL JOIN b USING (key) WHERE before IS DISTINCT FROM after"""


@query("log_diff", "audit_log", DIFF)
def log_diff(spark, sf):
    return L.diff(T.audit_log(spark, sf), EARLY, LATE)


@query("rollback_plan", "audit_log", f"""a AS (SELECT key, value AS before FROM ({STATE.format(LATE)}) WHERE op <> 'delete'), b AS (SELECT key, value AS after FROM ({STATE.format(EARLY)}) WHERE op <> 'delete')
 SELECT key, CASE WHEN before IS NULL THEN 'create' WHEN after IS NULL THEN 'delete' ELSE 'update' END AS action, before, after FROM a FULL JOIN b USING (key) WHERE before IS DISTINCT FROM after""")  # fmt: skip
def rollback_plan(spark, sf):
    log = T.audit_log(spark, sf)
    return L.rollback(L.state_at(log, LATE), log, EARLY)


@query("verify_keys", "audit_log memories", """h AS (SELECT key, string_agg(id::VARCHAR, ',' ORDER BY id DESC) AS changes FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS r FROM audit_log) WHERE r <= 20 GROUP BY key),
 k AS (SELECT key FROM memories UNION ALL SELECT 'nokey') SELECT k.key, m.key IS NOT NULL AS exists, m.value, coalesce(changes, '') AS changes FROM k LEFT JOIN memories m USING (key) LEFT JOIN h ON h.key = k.key""")  # fmt: skip
def verify_keys(spark, sf):
    m = T.memories(spark, sf)
    keys = m.select("key").unionByName(spark.range(1).select(F.lit("nokey").alias("key")))
    return L.verify_keys(m, T.audit_log(spark, sf), keys).withColumn("changes", F.concat_ws(",", F.col("changes").cast("array<string>")))


# keyed merges

HALF = "(SELECT max(seq) // 2 FROM commits)"


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The store after the first half of the commits, and the second half as a batch."""
    c = T.commits(spark, sf)
    middle = F.floor(c.select(F.max("seq") / 2).scalar())
    return U.last_of_each(c.where(F.col("seq") <= middle), "key"), c.where(F.col("seq") > middle)


@query("upsert", "commits", f"""cur AS (SELECT * FROM commits WHERE seq <= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
 inc AS (SELECT * FROM commits WHERE seq > {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
 SELECT key, coalesce(inc.value, cur.value) AS value, round(coalesce(cur.created_at, inc.created_at), 3) AS created_at, coalesce(cur.session_id, inc.session_id) AS session_id,
 CASE WHEN inc.key IS NULL THEN cur.access_count ELSE coalesce(cur.access_count, inc.access_count) + 1 END AS access_count, round(CASE WHEN inc.key IS NULL THEN cur.updated_at ELSE 1706745600.0 END, 3) AS updated_at FROM cur FULL JOIN inc USING (key)""")  # fmt: skip
def upsert(spark, sf):
    current, batch = halves(spark, sf)
    return U.upsert(current, batch, NOW).select("key", "value", F.round("created_at", 3).alias("created_at"), "session_id", "access_count", F.round("updated_at", 3).alias("updated_at"))


@query("forget_keys", "memories", "k AS (SELECT key FROM memories WHERE access_count < 5 UNION ALL SELECT 'nokey') SELECT k.key, m.value AS before, m.key IS NOT NULL AS deleted FROM k LEFT JOIN memories m USING (key)")
def forget_keys(spark, sf):
    m = T.memories(spark, sf)
    keys = m.where("access_count < 5").select("key").unionByName(spark.range(1).select(F.lit("nokey").alias("key")))
    return U.forget(m, keys)[1]


@query("commit_log", "commits", f"""cur AS (SELECT * FROM commits WHERE seq <= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
 inc AS (SELECT *, lag(value) OVER w AS earlier, row_number() OVER w AS n FROM commits WHERE seq > {HALF} WINDOW w AS (PARTITION BY key ORDER BY seq))
 SELECT inc.seq, CASE WHEN n = 1 AND cur.key IS NULL THEN 'create' ELSE 'update' END AS op_type, inc.key, CASE WHEN n = 1 THEN cur.value ELSE earlier END AS before, inc.value AS after FROM inc LEFT JOIN cur ON cur.key = inc.key""")  # fmt: skip
def commit_log(spark, sf):
    return U.commit_log(*halves(spark, sf))


# revision

CANDIDATES = """s AS (SELECT *, {} AS score FROM commits), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, seq) AS n, count(*) OVER (PARTITION BY key) AS c FROM s)
 SELECT key, seq AS winner, round(score, 6) AS score, c - 1 AS conflicts_resolved FROM r WHERE n = 1 AND c > 1"""
for _strategy, _score in {"entrenchment": "greatest(0.5::DOUBLE, importance)", "recency": "created_at", "verification": "is_verified::INT::DOUBLE", "importance": "importance"}.items():

    @query(f"resolve_{_strategy}", "commits", CANDIDATES.format(_score))
    def resolve(spark, sf, strategy=_strategy):
        out = R.resolve_candidates(T.commits(spark, sf), strategy).where("winner")
        return out.select("key", F.col("seq").alias("winner"), six("score").alias("score"), "conflicts_resolved")


REPLAY = """o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, greatest(0.0, least(1.0, importance)) AS own FROM commits),
 f AS (SELECT key, n, seq, value, importance AS imp, created_at AS at, is_verified AS ver, own AS ent, 'new' AS decision, seq AS held FROM o WHERE n = 1
 UNION ALL SELECT o.key, o.n, o.seq, CASE WHEN {acc} THEN o.value ELSE f.value END, CASE WHEN {acc} THEN o.importance ELSE f.imp END, CASE WHEN {acc} THEN o.created_at ELSE f.at END, CASE WHEN {acc} THEN o.is_verified ELSE f.ver END,
 CASE WHEN {acc} THEN greatest(f.ent, o.own) ELSE f.ent END, CASE WHEN o.value = f.value THEN 'same' WHEN {acc} THEN 'accepted' ELSE 'rejected' END, CASE WHEN {acc} THEN o.seq ELSE f.held END
 FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1) """
RULES = {
    "entrenchment": "(o.value <> f.value AND o.importance >= f.ent)",
    "recency": "(o.value <> f.value AND o.created_at >= f.at)",
    "verification": "(o.value <> f.value AND CASE WHEN o.is_verified <> f.ver THEN o.is_verified ELSE o.importance >= f.imp END)",
    "importance": "(o.value <> f.value AND o.importance >= f.imp)",
}
for _strategy, _rule in RULES.items():

    @query(f"revise_{_strategy}", "commits", REPLAY.format(acc=_rule) + "SELECT key, seq, decision FROM f", recursive=True)
    def revise(spark, sf, strategy=_strategy):
        return R.revise(T.commits(spark, sf), strategy)[1]


@query("revised_beliefs", "commits", REPLAY.format(acc=RULES["entrenchment"]) + "SELECT key, value, round(ent, 6) AS entrenchment, held AS seq FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1", recursive=True)
def revised_beliefs(spark, sf):
    return R.revise(T.commits(spark, sf))[0].select("key", "value", six("entrenchment").alias("entrenchment"), "seq")


@query("revision_summary", "commits", REPLAY.format(acc=RULES["entrenchment"]) + """SELECT count(*) AS operations, count(*) FILTER (decision IN ('accepted', 'rejected')) AS conflicts, count(*) FILTER (decision = 'accepted') AS accepted,
 count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'same') AS unchanged, count(*) FILTER (decision = 'new') AS beliefs FROM f""", recursive=True)  # fmt: skip
def revision_summary(spark, sf):
    return R.revision_summary(R.revise(T.commits(spark, sf))[1])


@query("expand", "commits", "SELECT seq, key, coalesce(lag(value) OVER (PARTITION BY key ORDER BY seq) <> value, false) AS conflict FROM commits")
def expand(spark, sf):
    return R.expand(T.commits(spark, sf))[1].select("seq", "key", "conflict")


@query("contract", "memories", "SELECT key, value, importance AS entrenchment, 'contracted' AS reason FROM memories WHERE importance >= 0.5 AND access_count < 5")
def contract(spark, sf):
    m = T.memories(spark, sf)
    return R.contract(R.load_beliefs(m), m.where("access_count < 5").select("key"))[1]


@query("entrenchment", "commits", "SELECT seq, key, max(greatest(0.0, least(1.0, importance))) OVER (PARTITION BY key ORDER BY seq) AS entrenchment FROM commits")
def entrenchment(spark, sf):
    return R.entrenchment(T.commits(spark, sf)).select("seq", "key", "entrenchment")


@query("load_beliefs", "memories", "SELECT key, value, least(1.0, importance) AS entrenchment FROM memories WHERE importance >= 0.5")
def load_beliefs(spark, sf):
    return R.load_beliefs(T.memories(spark, sf)).select("key", "value", "entrenchment")


PROTECTED = "(importance >= 0.85 OR access_count >= 20 OR (memory_type = 'procedural' AND access_count >= 10))"


@query("forget_contradictions", "commits", f"""g AS (SELECT key, count(DISTINCT left(value, 50)) AS kinds FROM commits GROUP BY key),
 b AS (SELECT key, value AS best FROM commits QUALIFY row_number() OVER (PARTITION BY key ORDER BY verification_score * importance DESC, seq) = 1)
 SELECT seq, CASE WHEN lost THEN key END AS superseded_by, CASE WHEN lost THEN 0.3 ELSE 1.0 END::DOUBLE AS current_strength FROM (SELECT *, kinds > 1 AND value <> best AND NOT {PROTECTED} AS lost FROM commits JOIN g USING (key) JOIN b USING (key))""")  # fmt: skip
def forget_contradictions(spark, sf):
    out = R.forget_contradictions(T.commits(spark, sf).withColumn("current_strength", F.lit(1.0)), S.is_protected())
    return out.select("seq", "superseded_by", "current_strength")


# agents


@query("push", "agent_beliefs", """e AS (SELECT * FROM commits WHERE agent_id = 'a1'), u AS (SELECT 'a0' AS agent_id, key, value, created_at, seq, 1 AS new FROM e UNION ALL SELECT agent_id, key, value, created_at, seq, 0 FROM agent_beliefs)
 SELECT agent_id, key, value, seq FROM u QUALIFY row_number() OVER (PARTITION BY agent_id, key ORDER BY created_at DESC, new, seq) = 1""")  # fmt: skip
def push(spark, sf):
    columns = ["agent_id", "key", "value", "created_at", "seq"]
    entries = T.commits(spark, sf).where("agent_id = 'a1'").withColumn("agent_id", F.lit("a0")).select(columns)
    return A.push(T.agent_beliefs(spark, sf).select(columns), entries).select("agent_id", "key", "value", "seq")


@query("pull", "agent_beliefs agents", """o AS (SELECT agents.agent_id, b.key, b.agent_id AS from_agent, b.value, b.created_at FROM agent_beliefs b JOIN agents ON agents.agent_id <> b.agent_id WHERE b.created_at >= 1705276800.0
 QUALIFY row_number() OVER (PARTITION BY agents.agent_id, b.key ORDER BY b.created_at DESC, b.seq) = 1)
 SELECT o.agent_id, o.key, from_agent, o.value, round(o.created_at, 3) AS created_at FROM o LEFT JOIN agent_beliefs m ON m.agent_id = o.agent_id AND m.key = o.key WHERE m.key IS NULL OR o.created_at > m.created_at""")  # fmt: skip
def pull(spark, sf):
    return A.pull(T.agent_beliefs(spark, sf), T.agents(spark), MID / 1e6).withColumn("created_at", F.round("created_at", 3))


@query("merge_agents", "agent_beliefs agents", """p AS (SELECT * FROM (VALUES ('a0', 'a3'), ('a1', 'a2')) AS t(a, b)), h AS (SELECT * FROM agent_beliefs JOIN agents USING (agent_id)),
 x AS (SELECT p.a, p.b, key, value AS va, reliability AS ra FROM p JOIN h ON agent_id = a), y AS (SELECT p.a, p.b, key, value AS vb, reliability AS rb FROM p JOIN h ON agent_id = b)
 SELECT a, b, key, CASE WHEN va IS NULL OR (vb IS NOT NULL AND va <> vb AND rb > ra) THEN vb ELSE va END AS value, coalesce(va <> vb, false) AS conflict, va IS NULL OR vb IS NULL AS copied FROM x FULL JOIN y USING (a, b, key)""")  # fmt: skip
def merge_agents(spark, sf):
    pairs = spark.createDataFrame([("a0", "a3"), ("a1", "a2")], "a string, b string")
    return A.merge(T.agent_beliefs(spark, sf), T.agents(spark), pairs)


@query("consensus", "agent_beliefs agents", """v AS (SELECT key, value, count(*) AS votes, max(reliability) AS trust, min(seq) AS first FROM agent_beliefs JOIN agents USING (agent_id) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY votes DESC, trust DESC, first) AS n, count(*) OVER (PARTITION BY key) AS kinds, sum(votes) OVER (PARTITION BY key)::BIGINT AS holders FROM v)
 SELECT key, value, votes, holders FROM r WHERE n = 1 AND kinds > 1""")  # fmt: skip
def consensus(spark, sf):
    return A.consensus(T.agent_beliefs(spark, sf), T.agents(spark))


@query("divergence", "agent_beliefs", """a AS (SELECT key, value AS value_a FROM agent_beliefs WHERE agent_id = 'a0'), b AS (SELECT key, value AS value_b FROM agent_beliefs WHERE agent_id = 'a1')
 SELECT key, CASE WHEN value_a IS NULL THEN 'missing_in_a' WHEN value_b IS NULL THEN 'missing_in_b' ELSE 'conflict' END AS status, value_a, value_b FROM a FULL JOIN b USING (key) WHERE value_a IS DISTINCT FROM value_b""")  # fmt: skip
def divergence(spark, sf):
    b = T.agent_beliefs(spark, sf)
    return A.divergence(b.where("agent_id = 'a0'"), b.where("agent_id = 'a1'"))


@query("vclock_compare", "commits", """n AS (SELECT agent_id, key, count(*) AS n FROM commits GROUP BY ALL), x AS (SELECT a.agent_id AS a, b.agent_id AS b FROM (SELECT DISTINCT agent_id FROM n) a, (SELECT DISTINCT agent_id FROM n) b WHERE a.agent_id < b.agent_id),
 k AS (SELECT DISTINCT key FROM n), c AS (SELECT a, b, k.key, coalesce(p.n, 0) AS pa, coalesce(q.n, 0) AS pb FROM x, k LEFT JOIN n p ON p.agent_id = x.a AND p.key = k.key LEFT JOIN n q ON q.agent_id = x.b AND q.key = k.key)
 SELECT a, b, CASE WHEN bool_or(pa < pb) AND bool_or(pa > pb) THEN 'concurrent' WHEN bool_or(pa < pb) THEN 'before' WHEN bool_or(pa > pb) THEN 'after' ELSE 'equal' END AS relation, sum(greatest(pa, pb))::BIGINT AS merged FROM c GROUP BY ALL""")  # fmt: skip
def vclock_compare(spark, sf):
    clocks = A.vclock_tick(T.commits(spark, sf))
    a, b = clocks.select(F.col("agent_id").alias("a"), F.col("clock").alias("ca")), clocks.select(F.col("agent_id").alias("b"), F.col("clock").alias("cb"))
    total = F.aggregate(F.map_values(A.vclock_merge(F.col("ca"), F.col("cb"))), F.lit(0).cast("long"), lambda n, x: n + x)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", A.vclock_compare(F.col("ca"), F.col("cb")).alias("relation"), total.alias("merged"))


@query("sync_stats", "commits", "SELECT count(DISTINCT agent_id) AS agents, count(*) AS syncs, count(DISTINCT CASE WHEN op_type <> 'delete' THEN agent_id END) AS active_agents FROM commits")
def sync_stats(spark, sf):
    return A.sync_stats(T.commits(spark, sf))


# strength and forgetting


@query("decay_pass", "memories", DECAY + "SELECT key, round(strength, 6) AS strength FROM decayed WHERE strength >= floor_at")
def decay_pass(spark, sf):
    return G.decay_pass(T.memories(spark, sf), NOW).select("key", six("current_strength").alias("strength"))


@query("decay_details", "memories", DECAY + """SELECT key, round(least(1.0, boost * CASE WHEN days < crossing THEN exp(-rate * slow * days) ELSE exp(-rate * slow * crossing) * pow(days / crossing, -beta * slow) END), 6) AS decay_factor,
 CASE WHEN days < crossing THEN 'exponential' ELSE 'power_law' END AS decay_phase, CASE slow WHEN 0.1 THEN 'full' WHEN 0.3 THEN 'weekly' WHEN 0.5 THEN 'burst' ELSE 'none' END AS ltp FROM decayed""")  # fmt: skip
def decay_details(spark, sf):
    return G.decay_pass(T.memories(spark, sf), NOW, prune=False).select("key", "decay_factor", "decay_phase", "ltp")


@query("decay_counts", "memories", DECAY + "SELECT count(*) AS scanned, count(*) FILTER (strength >= floor_at) AS updated, count(*) FILTER (strength < floor_at) AS pruned FROM decayed")
def decay_counts(spark, sf):
    return G.decay_counts(T.memories(spark, sf), NOW)


@query("decay_preview", "memories", DECAY + """, d AS (SELECT key AS id, day, exp(sum(ln(least(1.0, boost * CASE WHEN day < crossing THEN exp(-rate * slow * day) ELSE exp(-rate * slow * crossing) * pow(day / crossing, -beta * slow) END))) OVER (PARTITION BY key ORDER BY day)) AS raw
 FROM decayed, (SELECT unnest(range(31))::INT AS day)) SELECT id, day, round(raw, 4) AS strength FROM (SELECT *, lag(raw) OVER (PARTITION BY id ORDER BY day) AS b FROM d) WHERE b IS NULL OR b >= 0.001""".replace(", d AS", ", d AS", 1))  # fmt: skip
def decay_preview(spark, sf):
    return G.decay_preview(T.memories(spark, sf).withColumnRenamed("key", "id"), 30)


@query("legacy_decay", "memories", """SELECT key, round(least(1.0, greatest(0.0, pow(1 - CASE memory_type WHEN 'episodic' THEN 0.02 WHEN 'procedural' THEN 0.005 WHEN 'semantic' THEN 0.01 ELSE 0.01 END::DOUBLE, (1706745600.0 - last_accessed) / 3600.0))), 6) AS strength FROM memories""")
def legacy_decay(spark, sf):
    hours = (F.lit(NOW) - F.col("last_accessed")) / 3600.0
    return T.memories(spark, sf).select("key", six(S.legacy_decay(F.col("current_strength"), F.col("memory_type"), hours)).alias("strength"))


@query("access_reinforcement", "commits", """g AS (SELECT *, 0.05::DOUBLE / (1 + 0.1::DOUBLE * (row_number() OVER (PARTITION BY key ORDER BY seq) - 1)) AS gain FROM commits)
 SELECT seq, round(least(1.0, 0.5 + sum(gain) OVER (PARTITION BY key ORDER BY seq)), 6) AS strength FROM g""")  # fmt: skip
def access_reinforcement(spark, sf):
    return G.reinforced(T.commits(spark, sf).withColumn("strength0", F.lit(0.5))).select("seq", six("strength").alias("strength"))


@query("protected", "memories", f"SELECT key FROM memories WHERE {PROTECTED}")
def protected(spark, sf):
    return T.memories(spark, sf).where(S.is_protected()).select("key")


STALE = "m AS (SELECT * REPLACE (CASE WHEN access_count % 3 = 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS current_strength, CASE WHEN k % 11 = 0 THEN 1706000000.0::DOUBLE END AS invalid_at) FROM memories) "


def weakened(spark, sf) -> DataFrame:
    """Memories, of which some are weak and some have ended."""
    return T.memories(spark, sf).withColumns({"current_strength": F.when(F.col("access_count") % 3 == 0, 0.05).otherwise(1.0), "invalid_at": F.when(F.col("k") % 11 == 0, 1706000000.0)})


@query("forget_stale", "memories", STALE + f""", a AS (SELECT *, CASE WHEN {PROTECTED} THEN 'protect' WHEN access_count >= 3 THEN 'archive' ELSE 'delete' END AS action FROM m WHERE invalid_at < 1706745600.0 OR current_strength < 0.1)
 SELECT key, action, CASE WHEN action = 'protect' THEN greatest(current_strength, 0.2) ELSE 0.0 END::DOUBLE AS strength FROM a""")  # fmt: skip
def forget_stale(spark, sf):
    return G.forget_stale(weakened(spark, sf), NOW).select("key", "action", F.col("current_strength").alias("strength"))


@query("enforce_limits", "memories", f"""n AS (SELECT memory_type FROM memories GROUP BY 1 HAVING count(*) > 0.9 * CASE memory_type WHEN 'working' THEN 8 WHEN 'semantic' THEN 100 ELSE 5000 END),
 t AS (SELECT * FROM memories JOIN n USING (memory_type) QUALIFY row_number() OVER (PARTITION BY memory_type ORDER BY importance DESC, key) <= 200),
 r AS (SELECT *, importance * current_strength * (1 + 0.1::DOUBLE * access_count) AS worth, count(*) OVER (PARTITION BY memory_type) AS n FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY worth, key) AS rank FROM r)
 SELECT key, memory_type, round(worth, 6) AS worth, CASE WHEN {PROTECTED} THEN 'protect' WHEN access_count >= 3 THEN 'archive' ELSE 'delete' END AS action FROM q WHERE rank <= floor(n * 0.2)""")  # fmt: skip
def enforce_limits(spark, sf):
    return G.enforce_limits(T.memories(spark, sf), {"working": 8, "semantic": 100}).withColumn("worth", six("worth"))


@query("explain_forgetting", "memories", DECAY + f"""SELECT key, concat_ws('; ', CASE WHEN ttl IS NOT NULL AND 1706745600.0 - created_at > ttl THEN 'stale' END, CASE WHEN strength < current_strength THEN 'expected decay' END, CASE WHEN NOT {PROTECTED} THEN 'no protection' END) AS reasons FROM decayed""")
def explain_forgetting(spark, sf):
    return G.explain_forgetting(T.memories(spark, sf), NOW)


@query("explain_history", "audit_log", "SELECT key, string_agg(id || ' ' || op_type, ', ' ORDER BY id) AS story FROM audit_log GROUP BY key")
def explain_history(spark, sf):
    return G.explain_history(T.audit_log(spark, sf))


@query("forgetting_stats", "audit_log", """s AS (SELECT count(DISTINCT key) AS tracked, count(DISTINCT CASE WHEN op_type <> 'delete' THEN key END) AS committed, count(DISTINCT CASE WHEN op_type = 'delete' THEN key END) AS forgotten FROM audit_log)
 SELECT *, round(forgotten / greatest(committed, 1), 6) AS ratio FROM s""")  # fmt: skip
def forgetting_stats(spark, sf):
    return G.forgetting_stats(T.audit_log(spark, sf))


@query("consolidation_report", "memories", DECAY + """SELECT count(*) AS entries, count(*) FILTER (memory_type IN ('working', 'episodic') AND access_count >= 10) AS promotable, 0::BIGINT AS facts, count(*) - count(DISTINCT key) AS duplicate_keys,
 count(*) FILTER (abs(strength - current_strength) > 0.01) AS changed, count(*) FILTER (strength < floor_at) AS prunable FROM decayed""")  # fmt: skip
def consolidation_report(spark, sf):
    return G.consolidation_report(T.memories(spark, sf), NOW)


@query("co_access_pairs", "commits", """l AS (SELECT session_id, key, max(created_at) AS t FROM commits GROUP BY ALL)
 SELECT a.session_id, a.key AS key_a, b.key AS key_b FROM l a JOIN l b ON a.session_id = b.session_id AND a.key < b.key AND abs(a.t - b.t) < 86400.0""")  # fmt: skip
def co_access_pairs(spark, sf):
    return G.co_access_pairs(T.commits(spark, sf), 86400.0)


HEAT = """o AS (SELECT key, created_at AS t, importance, row_number() OVER (PARTITION BY key ORDER BY created_at, seq) AS n FROM commits),
 f AS (SELECT key, n, t, greatest(0.0, least(1.0, 0.2::DOUBLE * greatest(0.1, importance))) AS h FROM o WHERE n = 1
 UNION ALL SELECT o.key, o.n, o.t, greatest(0.0, least(1.0, f.h * pow(0.95::DOUBLE, (o.t - f.t) / 3600) + 0.2::DOUBLE * greatest(0.1, o.importance))) FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1),
 last AS (SELECT key, h AS heat FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)"""


@query("heat", "commits", HEAT + " SELECT key, round(heat, 6) AS heat FROM last", recursive=True)
def heat(spark, sf):
    return W.heat(T.commits(spark, sf)).select("key", six("heat").alias("heat"))


@query("working_set", "memories", HEAT + """, p AS (SELECT *, importance / greatest(1.0, 1706745600.0 - last_accessed) + 0.25::DOUBLE * heat AS priority FROM memories JOIN last USING (key)), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(priority, 9) DESC, key)::INT AS slot FROM p)
 SELECT key, slot, slot <= 8 AS stays, CASE WHEN slot <= 8 THEN memory_type ELSE 'semantic' END AS memory_type FROM r""", recursive=True)  # fmt: skip
def working_set(spark, sf):
    m = T.memories(spark, sf).join(W.heat(T.commits(spark, sf)), "key")
    return W.working_set(m, NOW).select("key", "slot", "stays", "memory_type")


@query("replay_working_memory")
def replay_working_memory(spark, sf):
    return W.replay_working_memory(T.commits(spark, sf))


@query("gate_to_episodic", "memories", HEAT + " SELECT key, importance >= 0.5 OR heat >= 0.7 AS promoted, CASE WHEN importance >= 0.5 OR heat >= 0.7 THEN 'episodic' ELSE memory_type END AS memory_type FROM memories JOIN last USING (key)", recursive=True)
def gate_to_episodic(spark, sf):
    return W.gate_to_episodic(T.memories(spark, sf).join(W.heat(T.commits(spark, sf)), "key")).select("key", "promoted", "memory_type")


@query("hot_sessions", "memories", HEAT + " SELECT session_id, round(count(*) / 8, 6) AS usage, count(*) FILTER (heat >= 0.15) AS hot FROM memories JOIN last USING (key) GROUP BY 1 HAVING count(*) >= 7 AND count(*) FILTER (heat >= 0.15) >= 1".replace("0.15", "0.7"), recursive=True)
def hot_sessions(spark, sf):
    return W.hot_sessions(T.memories(spark, sf).join(W.heat(T.commits(spark, sf)), "key")).withColumn("usage", six("usage"))


@query("working_stats", "memories", "SELECT session_id, count(*) AS entries, round(count(*) / 8, 6) AS usage, round(avg(importance), 6) AS avg_importance, count(*) FILTER (1706745600.0 - last_accessed <= 60) AS recent FROM memories GROUP BY 1")
def working_stats(spark, sf):
    return W.working_stats(T.memories(spark, sf), NOW)


# lookups and verification


@query("lookup", "memories", "SELECT key, value FROM memories WHERE key IN (SELECT DISTINCT key FROM commits WHERE memory_type = 'spatial')")
def lookup(spark, sf):
    return P.lookup(T.memories(spark, sf), T.commits(spark, sf).where("memory_type = 'spatial'")).select("key", "value")


@query("load_by_type", "memories", "SELECT memory_type, rank, key FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY importance DESC, created_at DESC, key)::INT AS rank FROM memories) WHERE rank <= 10")
def load_by_type(spark, sf):
    return P.load_by_type(T.memories(spark, sf), 10).select("memory_type", "rank", "key")


@query("high_priority", "memories", STALE + "SELECT key, importance * current_strength AS score FROM m WHERE (invalid_at IS NULL OR invalid_at > 1706745600.0) AND current_strength > 0.1 ORDER BY score DESC, key LIMIT 20")
def high_priority(spark, sf):
    return P.high_priority(weakened(spark, sf), NOW, 20).select("key", "score")


@query("stale", "memories", STALE + "SELECT key FROM m WHERE invalid_at < 1706745600.0 OR current_strength < 0.1")
def stale(spark, sf):
    return P.stale(weakened(spark, sf), NOW).select("key")


@query("is_stale", "memories", STALE + "SELECT key, coalesce(invalid_at < 1706745600.0, false) OR coalesce(1706745600.0 - created_at > ttl, false) OR current_strength < 0.1 AS stale FROM m")
def is_stale(spark, sf):
    return weakened(spark, sf).select("key", S.is_stale(NOW).alias("stale"))


@query("recall_layers", "memories agent_beliefs", """l AS (SELECT key, value, importance, current_strength, memory_type, 0 AS layer FROM memories UNION ALL SELECT key, value, importance, 1.0, memory_type, 1 FROM agent_beliefs WHERE agent_id = 'a0' UNION ALL SELECT key, value, importance, current_strength, memory_type, 2 FROM memories WHERE memory_type = 'working'),
 t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer DESC) = 1) SELECT key, value, layer FROM t WHERE memory_type = 'episodic' ORDER BY importance * current_strength DESC, key LIMIT 20""")  # fmt: skip
def recall_layers(spark, sf):
    m, b = T.memories(spark, sf), T.agent_beliefs(spark, sf).where("agent_id = 'a0'").withColumn("current_strength", F.lit(1.0))
    return P.recall([m, b, m.where("memory_type = 'working'")], memory_type="episodic").select("key", "value", "layer")


@query("canonical_order", "memories", """x AS (SELECT *, k % 9 = 0 AS canonical, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS p FROM memories WHERE NOT (ttl IS NOT NULL AND 1706745600.0 - created_at > ttl))
 SELECT session_id, key, row_number() OVER (PARTITION BY session_id ORDER BY canonical DESC, p, is_verified DESC, current_strength * importance DESC, created_at DESC, key)::INT AS rank FROM x""")  # fmt: skip
def canonical_order(spark, sf):
    m = T.memories(spark, sf).withColumns({"canonical": F.col("k") % 9 == 0, "priority": F.element_at(F.array(F.lit("high"), F.lit("normal"), F.lit("low")), F.col("k") % 3 + 1)})
    return P.canonical_order(m, NOW, ["session_id"]).select("session_id", "key", "rank")


@query("validate_entries", "doc_memories", "SELECT key, CASE WHEN strlen(value) > 1048576 THEN 'value too large' END AS error FROM doc_memories")
def validate_entries(spark, sf):
    m = T.doc_memories(spark, sf).withColumn("value", F.to_json(F.struct("value")))
    return m.select("key", P.key_error(F.col("key"), F.col("value")).alias("error"))


@query("sanitize_text", "", "SELECT page_id, left(trim(replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), 'javascript:', '', 'gi'), chr(0), '')), 500) AS text FROM pages")
def sanitize_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.sanitize_text(F.col("html")).alias("text"))


@query("check_invariants", "commits", """n AS (SELECT session_id, key, count(DISTINCT value) AS n FROM commits GROUP BY ALL), c AS (SELECT session_id, count(*) FILTER (n > 1) AS v FROM n GROUP BY 1),
 w AS (SELECT session_id, greatest(count(*) FILTER (memory_type = 'working') - 8, 0) AS v, count(*) FILTER (importance < 0.01) AS u FROM commits GROUP BY 1)
 SELECT session_id, rule, v::BIGINT AS violations, v = 0 AS valid FROM (SELECT session_id, 'CAPACITY' AS rule, v FROM w UNION ALL SELECT session_id, 'CONSISTENCY', v FROM c UNION ALL SELECT session_id, 'WORTH', u FROM w UNION ALL SELECT session_id, unnest(['MONOTONICITY', 'TYPE_SAFETY', 'NON_NEGATIVITY', 'KEY_VALIDITY']), 0 FROM w)""")  # fmt: skip
def check_invariants(spark, sf):
    return P.check_invariants(T.commits(spark, sf).withColumn("current_strength", F.lit(1.0)), "session_id", {"WORTH": F.col("importance") >= 0.01})


@query("verify_transition", "commits", f"""b AS (SELECT key FROM commits WHERE seq <= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND is_verified), a AS (SELECT key, is_verified FROM commits QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
 SELECT key FROM a JOIN b USING (key) WHERE NOT is_verified""")  # fmt: skip
def verify_transition(spark, sf):
    return P.verify_transition(halves(spark, sf)[0], T.memories(spark, sf))


@query("verification_gate", "memories agent_beliefs", STALE + """, h AS (SELECT key, value AS held FROM agent_beliefs WHERE agent_id = 'a0'), j AS (SELECT m.*, held, coalesce(invalid_at < 1706745600.0, false) OR coalesce(1706745600.0 - created_at > ttl, false) AS gone FROM m LEFT JOIN h USING (key))
 SELECT key, CASE WHEN gone OR current_strength < 0.3 THEN 'STALE' WHEN held <> value THEN 'CONFLICT' WHEN verification_score < 0.3 THEN 'LOW_CONFIDENCE' ELSE 'PASS' END AS status,
 CASE WHEN gone THEN 0.0 WHEN current_strength < 0.3 THEN current_strength WHEN held <> value THEN 0.0 ELSE verification_score END::DOUBLE AS confidence FROM j""")  # fmt: skip
def verification_gate(spark, sf):
    held = T.agent_beliefs(spark, sf).where("agent_id = 'a0'")
    return P.verification_gate(weakened(spark, sf), held, NOW).select("key", "status", "confidence")


@query("recall_status", "memories", STALE + "SELECT key, CASE WHEN coalesce(invalid_at < 1706745600.0, false) OR coalesce(1706745600.0 - created_at > ttl, false) OR current_strength < 0.1 THEN 'STALE' WHEN NOT contains(key, 'u1') AND importance < 0.5 THEN 'LOW_CONFIDENCE' ELSE 'PASS' END AS status FROM m")
def recall_status(spark, sf):
    return weakened(spark, sf).select("key", P.recall_status(NOW, F.lit("U1"), F.col("importance")).alias("status"))


@query("integrity_hash", "memories", "SELECT key, left(sha256(key || ':' || value || ':' || memory_type), 16) AS hash FROM memories")
def integrity_hash(spark, sf):
    return T.memories(spark, sf).select("key", P.integrity_hash().alias("hash"))


@query("apply_verification", "memories", "SELECT key, true AS is_verified, 0.8::DOUBLE AS verification_score, 'state_verifier' AS verification_method, 0 AS failed FROM memories")
def apply_verification(spark, sf):
    return P.apply_verification(T.memories(spark, sf)).select("key", "is_verified", "verification_score", "verification_method", F.size("failed_rules").alias("failed"))


@query("tag_event", "memories", "SELECT 'e1' AS event_id, key, row_number() OVER (ORDER BY created_at DESC, key)::INT AS rank FROM memories WHERE memory_type = 'semantic' QUALIFY rank <= 50")
def tag_event(spark, sf):
    m = T.memories(spark, sf)
    return P.event_members(P.tag_event(m, m.where("memory_type = 'semantic'"), "e1")[0], 50).select("event_id", "key", "rank")


@query("auto_recall", "memories", """s AS (SELECT * FROM memories WHERE memory_type = 'semantic' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY importance DESC, key) <= 200), a AS (SELECT * FROM s WHERE importance > 0.7 AND access_count > 3 AND k % 10 <> 0)
 SELECT agent_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY importance DESC, last_accessed DESC, access_count DESC, key)::INT AS rank FROM a) WHERE rank <= 5""")  # fmt: skip
def auto_recall(spark, sf):
    m = T.memories(spark, sf)
    return P.auto_recall(m, m.where("k % 10 = 0"), "agent_id").select("agent_id", "key", "rank")


@query("checkpoint_history", "commits", "SELECT thread_id, checkpoint_id, rank, rank = 1 AS latest FROM (SELECT session_id AS thread_id, seq AS checkpoint_id, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, seq DESC)::INT AS rank FROM commits) WHERE rank <= 5")
def checkpoint_history(spark, sf):
    c = T.commits(spark, sf).select(F.col("session_id").alias("thread_id"), F.col("seq").alias("checkpoint_id"), "updated_at", F.create_map(F.lit("value"), "value").alias("values"), F.array("value").alias("pending_sends"))
    return P.checkpoint_history(c, 5).select("thread_id", "checkpoint_id", "rank", "latest")
