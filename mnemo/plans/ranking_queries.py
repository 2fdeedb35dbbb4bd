"""Queries over rerankings, synonyms, temporal boosts and agreed values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import agents as A
from mnemo.operators import search as I
from mnemo.plans import fixtures as T
from mnemo.plans.recall_queries import RANKED, doc_vectors, docs_and_queries
from mnemo.plans.registry import ORACLES, query


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


LETTERS = "SELECT DISTINCT {0}, w FROM (SELECT {0}, unnest(regexp_extract_all(lower({1}), '[a-z]{{3,}}')) AS w FROM {2}) WHERE w NOT IN (" + listed(X.KEYWORD_STOP) + ")"


@query("rerank_distance", "doc_memories queries", """n AS (SELECT a.vec_id AS query_id, 'd' || b.vec_id AS key, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d FROM embeddings a, embeddings b
 WHERE a.vec_id IN (SELECT query_id FROM queries) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, 'd' || b.vec_id) <= 10),
 qk AS (""" + LETTERS.format("query_id", "query", "queries") + "), dk AS (" + LETTERS.format("key", "value", "doc_memories") + """),
 own AS (SELECT query_id, count(*) AS words FROM qk GROUP BY 1), met AS (SELECT query_id, key, count(*) AS shared FROM n JOIN qk USING (query_id) JOIN dk USING (key, w) GROUP BY ALL),
 z AS (SELECT query_id, session_id, round(d * (1 - 0.30 * coalesce(shared, 0) / greatest(coalesce(words, 0), 1)), 6) AS distance FROM n JOIN doc_memories USING (key) JOIN queries USING (query_id) LEFT JOIN own USING (query_id) LEFT JOIN met USING (query_id, key)),
 best AS (SELECT query_id, session_id, min(distance) AS distance FROM z GROUP BY ALL)
 SELECT query_id, session_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, session_id NULLS FIRST)::INT AS rank FROM best""")  # fmt: skip
def rerank_distance(spark, sf):
    """The ten nearest documents of each query, one row for each of their sessions."""
    docs, q = docs_and_queries(spark, sf)
    near = I.knn(*doc_vectors(spark, sf), 10).drop("rank")
    return I.rerank_distance(near.join(docs.select("key", "value", "session_id"), "key").join(q, "query_id"))


@query("rerank_boosted", "doc_memories queries query_truth", r"""q AS (SELECT query_id, list_distinct(regexp_split_to_array(lower(trim(query)), '\s+')) AS qw FROM queries),
 d AS (SELECT key, importance, access_count, 1 - importance / 2 AS strength, list_distinct(regexp_split_to_array(lower(trim(value)), '\s+')) AS vw FROM doc_memories),
 h AS (SELECT query_id, key FROM query_truth WHERE query_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key) <= 10),
 z AS (SELECT query_id, key, round((0.5 + 0.5 * strength) * (1 + 0.5 * importance) * (1 + 0.03 * least(access_count, 20)) * (1 + 0.5 * len(list_intersect(qw, vw)) / greatest(len(qw), 1)), 6) AS score FROM h JOIN d USING (key) JOIN q USING (query_id)
 UNION ALL SELECT query_id, key, count(*)::DOUBLE FROM (SELECT query_id, unnest(qw) AS w FROM q WHERE query_id NOT IN (SELECT query_id FROM h)) JOIN (SELECT key, unnest(vw) AS w FROM d) USING (w) GROUP BY ALL) """ + RANKED.format("z", 5))  # fmt: skip
def rerank_boosted(spark, sf):
    """Hits are the documents that hold a query of even number; the other queries have none, so that the entries sharing most words take their place."""
    docs, q = docs_and_queries(spark, sf)
    hits = T.query_truth(spark, sf).where("query_id % 2 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("key")))
    return I.rerank_boosted(q, hits, docs.withColumn("current_strength", 1 - F.col("importance") / 2))


SYNONYM_SQL = f"syn AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{w}{chr(39)})' for i, (k, g) in enumerate(X.SYNONYMS.items()) for w in dict.fromkeys((k, *g)))}) AS v(g, w))"


@query("expanded_queries", "queries", SYNONYM_SQL + f""", asked AS (SELECT query_id, query || ' ' || list_extract([{', '.join(f"'{k}'" for k in X.SYNONYMS)}], (query_id % {len(X.SYNONYMS) + 1} + 1)::INT) AS query FROM queries WHERE query_id % {len(X.SYNONYMS) + 1} < {len(X.SYNONYMS)}
 UNION ALL SELECT query_id, query FROM queries WHERE query_id % {len(X.SYNONYMS) + 1} = {len(X.SYNONYMS)}),"""
 + r""" own AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(trim(query)), '\s+')) AS w FROM asked),
 every AS (SELECT query_id, w FROM own UNION SELECT query_id, b.w FROM own JOIN syn a ON own.w = a.w JOIN syn b ON a.g = b.g)
 SELECT query_id, string_agg(w, ' ' ORDER BY w) AS words, count(*) AS n FROM every GROUP BY 1""")  # fmt: skip
def expanded_queries(spark, sf):
    """Each query with one word of a synonym group behind it, but for the last of each turn, which gets none."""
    names = F.array(*map(F.lit, X.SYNONYMS), F.lit(None).cast("string"))
    asked = T.queries(spark, sf).withColumn("query", F.concat_ws(" ", "query", F.get(names, (F.col("query_id") % (len(X.SYNONYMS) + 1)).cast("int"))))
    words = X.expand_query(F.col("query"))
    return asked.select("query_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n"))


@query("temporal_boosts", "doc_memories", """k AS (SELECT key, seq, CASE WHEN regexp_matches(lower(value), 'when|date|time|day|month') THEN 'when' WHEN regexp_matches(lower(value), 'before|earlier|prior|first') THEN 'before' WHEN regexp_matches(lower(value), 'after|later|following|then|last') THEN 'after'
 WHEN regexp_matches(lower(value), 'how long|duration|between|gap|elapsed') THEN 'duration' WHEN regexp_matches(lower(value), 'order|sequence|chronolog|timeline') THEN 'ordering' END AS kind FROM doc_memories)
 SELECT key, kind, CASE WHEN kind IS NULL THEN 1.0 WHEN seq % 4 = 0 THEN 0.8 WHEN kind = 'duration' THEN 1.2 ELSE 1.4 END::DOUBLE AS boost FROM k""")  # fmt: skip
def temporal_boosts(spark, sf):
    """What kind of time each document speaks of, and its boost; every fourth counts as undated."""
    docs = T.doc_memories(spark, sf).withColumn("kind", X.temporal_type(F.col("value")))
    return docs.select("key", "kind", X.temporal_boost(F.col("kind"), F.col("seq") % 4 != 0).cast("double").alias("boost"))


@query("consensus_applied", "", f"SELECT c.key, c.value, a.agent_id FROM ({ORACLES['consensus']}) c, (VALUES ('a0'), ('a1'), ('a2'), ('a3')) a(agent_id)")
def consensus_applied(spark, sf):
    agents = T.agents(spark)
    return A.apply_consensus(A.consensus(T.agent_beliefs(spark, sf), agents), agents)
