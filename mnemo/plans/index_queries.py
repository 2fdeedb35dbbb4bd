"""Queries over the kept text index, with and without stemming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import stem as P
from mnemo.operators import ann as A
from mnemo.operators import text_index as I
from mnemo.plans import fixtures as T
from mnemo.plans.recall_queries import BM25, RANKED, vectors
from mnemo.plans.registry import query
from mnemo.sources.durable import job_dir

# Porter's stemmer in SQL: a step is a common table expression over (word, x)

SHAPE = "list_reduce(string_split({0}, ''), lambda seen, c: seen || CASE WHEN c = '' THEN '' WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(seen, 1) = 'c') THEN 'v' ELSE 'c' END, '')"


def _choice(rules: dict[str, str]) -> str:
    return "CASE p.suffix " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def _step(name: str, before: str, suffixes, then: str) -> str:
    split = f"SELECT word, x, regexp_extract(x, '^(.*?)({'|'.join(suffixes)})$', ['stem', 'suffix']) AS p FROM {before}"
    shaped = f"SELECT *, {SHAPE.format('p.stem')} AS shape FROM ({split})"
    measured = f"SELECT *, len(regexp_extract_all(shape, 'v+c+')) AS m, ends_with(shape, 'cvc') AND NOT regexp_matches(p.stem, '[wxy]$') AS closed FROM ({shaped})"
    return f"{name} AS (SELECT word, CASE WHEN p.suffix = '' THEN x ELSE {then} END AS x FROM ({measured}))"


def porter_sql(words: str) -> str:
    """CTEs ending in ``stems`` (word, stem) for the table ``words`` (word)."""
    mended = "CASE WHEN regexp_matches(p.stem, '(at|bl|iz)$') THEN p.stem || 'e' WHEN right(p.stem, 1) = substr(p.stem, -2, 1) AND len(p.stem) > 1 AND NOT regexp_matches(p.stem, '[aeioulsz]$') THEN left(p.stem, -1) WHEN m = 1 AND closed THEN p.stem || 'e' ELSE p.stem END"
    steps = [
        _step("w1", f"(SELECT word, word AS x FROM {words})", P.PLURALS, f"CASE WHEN p.stem = '' THEN CASE p.suffix WHEN 'sses' THEN 'sse' WHEN 'ies' THEN 'ie' ELSE p.suffix END ELSE p.stem || {_choice(P.PLURALS)} END"),
        _step("w2", "w1", ("eed", "ed", "ing"), f"CASE WHEN x = 'eed' THEN 'e' WHEN p.suffix = 'eed' THEN p.stem || CASE WHEN m > 0 THEN 'ee' ELSE 'eed' END WHEN contains(shape, 'v') THEN {mended} ELSE x END"),
        _step("w3", "w2", ("y",), "p.stem || CASE WHEN contains(shape, 'v') THEN 'i' ELSE 'y' END"),
        _step("w4", "w3", P.DOUBLE, f"CASE WHEN m > 0 THEN p.stem || {_choice(P.DOUBLE)} ELSE x END"),
        _step("w5", "w4", P.SINGLE, f"CASE WHEN m > 0 THEN p.stem || {_choice(P.SINGLE)} ELSE x END"),
        _step("w6", "w5", P.LAST, "CASE WHEN m > 1 AND (p.suffix <> 'ion' OR regexp_matches(p.stem, '[st]$')) THEN p.stem ELSE x END"),
        _step("w7", "w6", ("e",), "CASE WHEN m > 1 OR (m = 1 AND NOT closed) THEN p.stem ELSE x END"),
        f"w8 AS (SELECT word, CASE WHEN ends_with(x, 'll') AND len(regexp_extract_all({SHAPE.format('x')}, 'v+c+')) > 1 THEN left(x, -1) ELSE x END AS x FROM w7)",
        "stems AS (SELECT word, CASE WHEN strlen(word) BETWEEN 3 AND 64 THEN x ELSE word END AS stem FROM w8)",
    ]
    return ", ".join(steps)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(translate(lower(translate({text}, '{P.MARKED}', '{P.PLAIN}')), '{P.MARKED}', '{P.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


@query("stems", "doc_memories", f"words AS (SELECT DISTINCT unnest({_tokens('value')}) AS word FROM doc_memories), {porter_sql('words')} SELECT word, stem FROM stems")
def stems(spark, sf):
    """The stem of every different word of all documents."""
    words = T.doc_memories(spark, sf).select(F.explode(P.stem_tokens(F.col("value"))).alias("word")).distinct()
    return words.select("word", P.porter(F.col("word")).alias("stem"))


def fragments(spark, sf) -> DataFrame:
    """Queries: every whole benchmark text, and (by negative number) four letters from inside a word of it, which seldom are a word."""
    q = T.queries(spark, sf)
    inner = F.substr(F.regexp_extract("query", "[a-z]{6,}", 0), F.lit(2), F.lit(4))
    return q.unionByName(q.select((-F.col("query_id") - 1).alias("query_id"), inner.alias("query")).where("query <> ''"))


TEXT_SEARCH = f"""asked AS (SELECT query_id, query FROM queries UNION ALL SELECT * FROM (SELECT -query_id - 1 AS query_id, substr(regexp_extract(query, '[a-z]{{6,}}'), 2, 4) AS query FROM queries) WHERE query <> ''),
 dt AS (SELECT key, unnest({_tokens("concat_ws(' ', key, value)")}) AS word FROM doc_memories), qt AS (SELECT query_id, unnest({_tokens('query')}) AS word FROM asked), words AS (SELECT word FROM dt UNION SELECT word FROM qt), {porter_sql('words')},
 len AS (SELECT key, count(*) AS dl FROM dt GROUP BY 1), corpus AS (SELECT (SELECT count(*) FROM doc_memories) AS n, (SELECT count(*) FROM dt) / (SELECT count(*) FROM doc_memories) AS avgdl),
 post AS (SELECT key, stem, count(*) AS tf FROM dt JOIN stems USING (word) GROUP BY ALL), df AS (SELECT stem, count(*) AS df FROM post GROUP BY 1), q AS (SELECT query_id, stem, count(*) AS qf FROM qt JOIN stems USING (word) GROUP BY ALL),
 s AS (SELECT query_id, key, round(sum(qf * CASE WHEN n - df > df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))), 6) AS score FROM q JOIN post USING (stem) JOIN df USING (stem) JOIN len USING (key), corpus GROUP BY ALL),
 f AS (SELECT query_id, key, 0.5::DOUBLE AS score FROM asked JOIN doc_memories ON contains(lower(key), lower(query)) OR contains(lower(value), lower(query)) WHERE query_id NOT IN (SELECT query_id FROM s)), u AS (SELECT * FROM s UNION ALL SELECT * FROM f) """


@query("text_search", "doc_memories queries", TEXT_SEARCH + RANKED.format("u", 5))
def text_search(spark, sf):
    return I.text_search(fragments(spark, sf), T.doc_memories(spark, sf), 5)


@query("index_search", "doc_memories queries", BM25 + ", w AS (SELECT query_id, key, round(score * (1 + 0.3 * importance + CASE WHEN is_verified THEN 0.2 ELSE 0.0 END), 6) AS score FROM s JOIN doc_memories USING (key)) " + RANKED.format("w", 5))
def index_search(spark, sf):
    """Documents indexed in two batches, then all queries by the index."""
    docs, path = T.doc_memories(spark, sf), f"{job_dir(spark)}/index-{uuid.uuid4().hex}"
    for b in range(2):
        I.append(docs.where(F.col("seq") % 2 == b), path, b)
    return I.index_search(spark, path, T.queries(spark, sf), docs, 5)


@query("ann_search")
def ann_search(spark, sf):
    """The five nearest by the inverted file, for every vector whose id is divisible by 50; its recall is tested against ``knn``."""
    queries, v = vectors(spark, sf)
    path = f"{job_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells = A.build(v, path, 5)
    return A.search(spark, path, cells, queries, 5)
