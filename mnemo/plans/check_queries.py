"""Queries over checks with their reasons, rollbacks with their log, heat, walked edges and backlogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import forgetting as G
from mnemo.operators import graph as H
from mnemo.operators import log as L
from mnemo.operators import predicates as P
from mnemo.operators import scores as C
from mnemo.operators import search as I
from mnemo.operators import working as W
from mnemo.plans import fixtures as T
from mnemo.plans.recall_queries import ENTITY, SPOTS, STARTS, STOP, WORDS, index, node_times, starts
from mnemo.plans.registry import query
from mnemo.plans.state_queries import CHAIN, EARLY, HALF, LATE, NOW, STATE, halves, six, weakened

#: Memories of which some break rules: no JSON, negative importance.
BROKEN = "x AS (SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN '{bad' ELSE value END AS value, CASE WHEN k % 13 = 0 THEN -0.5 ELSE importance END::DOUBLE AS importance) FROM memories)"


def broken(spark, sf) -> DataFrame:
    k = F.col("k")
    return T.memories(spark, sf).withColumns({"value": F.when(k % 11 == 0, "{bad").otherwise(F.col("value")), "importance": F.when(k % 13 == 0, -0.5).otherwise(F.col("importance"))})


@query("chain_state", "audit_log", CHAIN + """, b AS (SELECT chain_id, min(CASE WHEN chain_id = 'a1' AND id % 1000 = 501 THEN id END) AS first_error FROM audit_log GROUP BY 1)
 SELECT chain_id, first_error, arg_max(root_hash, n) AS stored_root, CASE WHEN first_error IS NULL THEN arg_max(root_hash, n) ELSE coalesce(arg_max(root_hash, n) FILTER (id < first_error), repeat('0', 64)) END AS current_root, first_error IS NOT NULL AS root_mismatch
 FROM c JOIN b USING (chain_id) GROUP BY chain_id, first_error""", recursive=True)  # fmt: skip
def chain_state(spark, sf):
    """One row in a thousand of chain a1 is tampered with."""
    forged = L.build_chain(T.audit_log(spark, sf)).withColumn("after", F.when((F.col("chain_id") == "a1") & (F.col("id") % 1000 == 501), "forged").otherwise(F.col("after")))
    return L.verify_chain(forged).select("chain_id", "first_error", "stored_root", "current_root", "root_mismatch")


@query("rollback_log", "audit_log", f"""a AS (SELECT key, value AS before FROM ({STATE.format(LATE)}) WHERE op <> 'delete'), b AS (SELECT key, value AS after FROM ({STATE.format(EARLY)}) WHERE op <> 'delete'),
 p AS (SELECT key, CASE WHEN before IS NULL THEN 'create' WHEN after IS NULL THEN 'delete' ELSE 'update' END AS op_type, before, after FROM a FULL JOIN b USING (key) WHERE before IS DISTINCT FROM after)
 SELECT op_type, key, {LATE}::BIGINT AS micros, before, after FROM p UNION ALL SELECT 'rollback', '__system', {LATE}, '{{"target_micros":{EARLY}}}', '{{"created":' || count(*) FILTER (op_type = 'create') || ',"updated":' || count(*) FILTER (op_type = 'update') || ',"deleted":' || count(*) FILTER (op_type = 'delete') || '}}' FROM p""")  # fmt: skip
def rollback_log(spark, sf):
    log = T.audit_log(spark, sf)
    return L.rollback_log(L.rollback(L.state_at(log, LATE), log, EARLY), EARLY, LATE)


@query("verify_keys_checked", "audit_log memories", BROKEN + """, k AS (SELECT key FROM memories UNION ALL SELECT 'nokey')
 SELECT k.key, x.key IS NOT NULL AS exists, CASE WHEN x.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN importance < 0 THEN 'NON_NEGATIVITY' END, CASE WHEN value = '{bad' THEN 'TYPE_SAFETY' END) END AS failed, true AS integrity_valid FROM k LEFT JOIN x USING (key)""")  # fmt: skip
def verify_keys_checked(spark, sf):
    m, log = broken(spark, sf), T.audit_log(spark, sf)
    keys = m.select("key").unionByName(spark.range(1).select(F.lit("nokey").alias("key")))
    return L.verify_keys(m, log, keys, chained=L.build_chain(log)).select("key", "exists", F.array_join("failed_rules", ",").alias("failed"), "integrity_valid")


@query("transition_report", "memories", BROKEN + f""", b AS (SELECT session_id, key FROM commits WHERE seq <= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND is_verified),
 l AS (SELECT x.session_id, count(*) AS lost FROM x JOIN b USING (session_id, key) WHERE NOT x.is_verified GROUP BY 1),
 r AS (SELECT session_id, concat_ws(',', CASE WHEN count(*) FILTER (memory_type = 'working') > 8 THEN 'CAPACITY' END, CASE WHEN count(*) FILTER (importance < 0) > 0 THEN 'NON_NEGATIVITY' END, CASE WHEN count(*) FILTER (value = '{{bad') > 0 THEN 'TYPE_SAFETY' END) AS failed FROM x GROUP BY 1)
 SELECT session_id, coalesce(lost, 0) AS lost, CASE WHEN lost > 0 THEN '' ELSE failed END AS failed, lost IS NULL AND failed = '' AS valid FROM r LEFT JOIN l USING (session_id)""")  # fmt: skip
def transition_report(spark, sf):
    out = P.transition_report(halves(spark, sf)[0], broken(spark, sf), "session_id")
    return out.select("session_id", "lost", F.array_join("failed_rules", ",").alias("failed"), "valid")


@query("gate_reasons", "memories agent_beliefs", """m AS (SELECT * REPLACE (CASE WHEN access_count % 3 = 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS current_strength, CASE WHEN k % 11 = 0 THEN 1706000000.0::DOUBLE END AS invalid_at), CASE WHEN k % 5 = 0 THEN session_id || ':1' END AS named FROM memories),
 h AS (SELECT key, value AS held FROM agent_beliefs WHERE agent_id = 'a0'), j AS (SELECT m.*, CASE WHEN h.held <> value THEN m.key END AS own, o.key AS other, coalesce(invalid_at < 1706745600.0, false) OR coalesce(1706745600.0 - created_at > ttl, false) AS gone FROM m LEFT JOIN h USING (key) LEFT JOIN h o ON o.key = named)
 SELECT key, CASE WHEN gone THEN 'no longer valid' WHEN current_strength < 0.3 THEN 'too weak' WHEN own IS NOT NULL OR other IS NOT NULL THEN 'conflicts with ' || concat_ws(', ', least(own, other), CASE WHEN own <> other THEN greatest(own, other) END) WHEN verification_score < 0.3 THEN 'verified too little' END AS reason FROM j""")  # fmt: skip
def gate_reasons(spark, sf):
    entries = weakened(spark, sf).withColumn("conflicts_with", F.when(F.col("k") % 5 == 0, F.concat("session_id", F.lit(":1"))))
    return P.verification_gate(entries, T.agent_beliefs(spark, sf).where("agent_id = 'a0'"), NOW).select("key", "reason")


@query("consolidation_health", "memories kg_sparse", SPOTS + """, f AS (SELECT count(*) AS n FROM spots WHERE kind = 'isolated') SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM memories WHERE 1706745600.0 - last_accessed < 432000.0) AS strengthened, n AS blind_spots, round(greatest(0.0, 1 - 0.1 * n), 6)::DOUBLE AS health FROM f""", recursive=True)
def consolidation_health(spark, sf):
    spots = H.blind_spots(node_times(spark, sf), T.kg_sparse(spark, sf), NOW).where("kind = 'isolated'")
    return G.consolidation_health(T.memories(spark, sf), spots, NOW, 432000.0)


@query("replay_with_uses")
def replay_with_uses(spark, sf):
    """Views are uses of an entry, all else puts it; heat decides with importance who leaves."""
    return W.replay_working_memory(T.commits(spark, sf).withColumn("used", F.col("memory_type") == "episodic"), 3)


@query("walked_edges", "kg_edges", f"""s AS (SELECT * FROM ({STARTS}) AS t(start)), e AS (SELECT DISTINCT source, target FROM kg_edges),
 w AS (SELECT start, start AS node, 0 AS depth FROM s UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node WHERE depth < 1)
 SELECT start, source, target, relation_type, weight FROM kg_edges JOIN (SELECT DISTINCT start, node FROM w) ON node = source WHERE relation_type IN ('causes', 'supports')""", recursive=True)  # fmt: skip
def walked_edges(spark, sf):
    e = T.kg_edges(spark, sf)
    return H.walked_edges(e, H.traverse(e, starts(spark, sf), 2), 2, ["causes", "supports"])


@query("graph_stats_linked", "kg_edges", """n AS (SELECT count(*) AS nodes FROM (SELECT source FROM kg_edges UNION SELECT target FROM kg_edges)), e AS (SELECT count(*) AS edges, count(*) FILTER (relation_type = 'contradicts') AS contradictions FROM kg_edges),
 i AS (SELECT count(*) AS entity_links FROM (SELECT DISTINCT source, target FROM kg_edges WHERE relation_type = 'related_to')) SELECT *, round(edges / (nodes * (nodes - 1)), 9) AS density FROM n, e, i""")  # fmt: skip
def graph_stats_linked(spark, sf):
    e = T.kg_edges(spark, sf)
    return H.graph_stats(e, e.where("relation_type = 'related_to'").select(F.col("target").alias("entity"), F.col("source").alias("key")))


@query("metadata_edges", "memories", """SELECT key AS source, 'e' || (k % 7) AS target, 'causes' AS relation_type, 0.5::DOUBLE AS weight, 0::BIGINT AS edge_seq FROM memories
 UNION ALL SELECT key, session_id, 'related_to', 0.25, 2 FROM memories WHERE k % 2 = 0 UNION ALL SELECT key, session_id, 'supports', 0.5, 2 FROM memories WHERE k % 2 = 1""")  # fmt: skip
def metadata_edges(spark, sf):
    member = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"target": "'), "session_id", F.lit('", "strength": 0.25}'))).otherwise(F.concat(F.lit('{"target": "'), "session_id", F.lit('", "type": "supports"}')))
    meta = F.concat(F.lit('{"relations": [["causes", "e'), F.col("k") % 7, F.lit('"], 5, '), member, F.lit(', {"target": ""}, ["alone"], {"target": "z", "strength": 0}]}'))
    return H.metadata_edges(T.memories(spark, sf).withColumn("metadata", meta))


@query("query_entities", "queries", f"e AS (SELECT DISTINCT query_id, e FROM (SELECT query_id, {WORDS.format('query')} FROM queries) {STOP}), g AS (SELECT query_id, string_agg(e, ',' ORDER BY e) AS entities FROM e GROUP BY 1) SELECT query_id, coalesce(entities, '') AS entities, len(regexp_extract_all(lower(query), '[a-z0-9_]+'))::INT AS token_count FROM queries LEFT JOIN g USING (query_id)")
def query_entities(spark, sf):
    return I.query_analysis(T.queries(spark, sf)).select("query_id", F.array_join("entities", ",").alias("entities"), "token_count")


@query("temporal_sort", "memories", """r AS (SELECT session_id, key, created_at, k, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, key) AS rank, CASE substr(session_id, -1) WHEN '1' THEN 'ordering' WHEN '2' THEN 'after' WHEN '3' THEN 'before' ELSE 'when' END AS kind FROM memories)
 SELECT session_id, key, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN kind IN ('ordering', 'after') THEN created_at WHEN kind = 'before' THEN -created_at ELSE 0 END, rank)::INT AS place FROM r""")  # fmt: skip
def temporal_sort(spark, sf):
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("importance"), "key"))
    last = F.right("session_id", F.lit(1))
    kind = F.when(last == "1", "ordering").when(last == "2", "after").when(last == "3", "before").otherwise("when")
    return C.temporal_sort(T.memories(spark, sf).withColumn("rank", rank), kind, "session_id").select("session_id", "key", "place")


@query("ingest_backlog", "doc_memories", ENTITY + r""", late AS (SELECT * FROM doc_memories WHERE key NOT IN (SELECT key FROM ei WHERE seq % 2 = 0) ORDER BY importance DESC, key LIMIT 500),
 w AS (SELECT DISTINCT key, unnest(regexp_extract_all(value, '([a-z_]+)\s*[=:]\s*([^,\n]+)', 1)) AS name FROM late), f AS (SELECT entity FROM ei SEMI JOIN late USING (key))
 SELECT (SELECT count(*) FROM late) AS processed, (SELECT count(DISTINCT entity) FROM f) AS entities, (SELECT count(*) FROM f) + (SELECT count(*) FROM w) AS relations""")  # fmt: skip
def ingest_backlog(spark, sf):
    return H.ingest_backlog(T.doc_memories(spark, sf), index(spark, sf).where("seq % 2 = 0"))[2]


@query("key_values", "", r"""SELECT page_id, string_agg(n || '=' || v, ';' ORDER BY i) AS pairs FROM (SELECT page_id, unnest(regexp_extract_all(url, '([a-z_]+)\s*[=:]\s*([^,\n]+)', 1)) AS n, unnest(regexp_extract_all(url, '([a-z_]+)\s*[=:]\s*([^,\n]+)', 2)) AS v, generate_subscripts(regexp_extract_all(url, '([a-z_]+)\s*[=:]\s*([^,\n]+)', 1), 1) AS i FROM pages) GROUP BY 1""")
def key_values(spark, sf):
    pairs = F.transform(X.key_values(F.col("url")), lambda x: F.concat_ws("=", x["name"], x["value"]))
    return T.table(spark, sf, "pages").select("page_id", F.array_join(pairs, ";").alias("pairs")).where("pairs <> ''")
