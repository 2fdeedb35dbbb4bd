"""Tables of the memory model, derived from the test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.operators.search import small

#: The fixed clock, 2024-02-01 00:00:00 UTC.
NOW = 1706745600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _cases(column: Column, values: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal for each event, in order of ``seq``."""
    k = F.get_json_object("props", "$.k").cast("int")
    verified = F.col("event_id") % 3 == 0
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    out = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), "user_id", F.lit(":"), k % 10).alias("key"),
        F.concat(F.lit("a"), F.col("event_id") % 4).alias("agent_id"),
        F.concat(F.lit("u"), "user_id").alias("session_id"),
        F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value"),
        F.least(F.lit(1.0), F.round(F.col("value") / 100.0, 4)).alias("importance"),
        verified.alias("is_verified"),
        F.when(verified, 0.8).otherwise(0.2).alias("verification_score"),
        _cases(F.col("event_type"), {"click": "working", "view": "episodic", "purchase": "procedural", "signup": "semantic"}, "spatial").alias("memory_type"),
        (k % 25).alias("access_count"),
        k.alias("k"),
        seconds(F.col("ts")).alias("created_at"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        (F.col("event_type") == "error").alias("_error"),
    )
    op = F.when(F.col("_error"), "delete").when(first, "create").otherwise("update")
    return out.withColumn("op_type", op).withColumns({"updated_at": F.col("created_at"), "last_accessed": F.col("created_at")}).drop("_error")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key."""
    out = commits(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    out = out.withColumn("_n", last).where("_n = 1").drop("_n")
    return out.withColumns(
        {
            "current_strength": F.lit(1.0),
            "ttl": F.when(F.col("k") % 7 == 0, F.lit(14 * 86400.0)),
            "invalid_at": F.lit(None).cast("double"),
            "conflict_id": F.when(F.col("k") % 50 == 0, F.col("key")),
        }
    )


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a0", 0.9), ("a1", 0.7), ("a2", 0.7), ("a3", 0.5)], "agent_id string, reliability double")


def agent_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = commits(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("agent_id", "key").orderBy(F.desc("seq")))
    return out.withColumn("_n", last).where("_n = 1").drop("_n")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("key").orderBy("seq"))
    return commits(spark, sf_dir).select(
        F.col("seq").alias("id"), "op_type", "key", "micros", "created_at", before.alias("before"), F.when(F.col("op_type") != "delete", F.col("value")).alias("after"), F.col("agent_id").alias("chain_id")
    )


def doc_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("d"), "doc_id").alias("key"),
        F.col("text").alias("value"),
        F.lit("semantic").alias("memory_type"),
        F.col("source").alias("session_id"),
        F.round((F.col("doc_id") % 100) / 100.0, 2).alias("importance"),
        (F.col("doc_id") % 3 == 0).alias("is_verified"),
        (F.col("doc_id") % 25).cast("int").alias("access_count"),
        "lang",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_truth(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, key): documents that hold a query's words; with ``pairs`` (query_id, key) only these are looked at."""
    docs, asked = doc_memories(spark, sf_dir).select("key", "value"), small(queries(spark, sf_dir))
    held = F.col("value").contains(F.col("query"))
    both = docs.join(asked, held) if pairs is None else docs.join(small(pairs.select("query_id", "key")), "key").join(asked, "query_id").where(held)
    return both.select("query_id", "key")


def kg_edges(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Edges customer → part → supplier → nation → region with types by number."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    edge = lambda df, a, b, t, w: df.select(a.alias("source"), b.alias("target"), F.lit(t).cast("int").alias("t") if isinstance(t, int) else t.cast("int").alias("t"), w.alias("w"))
    out = edge(lines, name("c", "o_custkey"), name("p", "l_partkey"), (F.col("l_orderkey") + F.col("l_linenumber")) % 5, 1 - F.col("l_discount"))
    if whole:
        supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
        out = out.unionByName(edge(lines, name("p", "l_partkey"), name("s", "l_suppkey"), (F.col("l_partkey") + F.col("l_suppkey")) % 5, 1 - F.col("l_tax")))
        out = out.unionByName(edge(supplier, name("s", "s_suppkey"), name("n", "s_nationkey"), 0, F.lit(1.0)))
        out = out.unionByName(edge(nation, name("n", "n_nationkey"), name("r", "n_regionkey"), 0, F.lit(1.0)))
    types = F.array(*[F.lit(x) for x in ("related_to", "causes", "contradicts", "supports", "temporal_before")])
    return out.groupBy("source", "target", types[F.col("t")].alias("relation_type")).agg(F.max(F.round("w", 2)).alias("weight"))


def kg_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer → part only."""
    return kg_edges(spark, sf_dir, False)


#: The same tables as DuckDB sees them, to be put before a query's SQL.
SQL = {
    "commits": """commits AS (SELECT *, CASE WHEN event_type = 'error' THEN 'delete' WHEN row_number() OVER (PARTITION BY key ORDER BY seq) = 1 THEN 'create' ELSE 'update' END AS op_type
 FROM (SELECT event_id AS seq, 'u' || user_id || ':' || (k % 10) AS key, 'a' || (event_id % 4) AS agent_id, 'u' || user_id AS session_id, '"' || event_type || '"' AS value,
 least(1.0, round(value / 100.0, 4)) AS importance, event_id % 3 = 0 AS is_verified, CASE WHEN event_id % 3 = 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS verification_score,
 CASE event_type WHEN 'click' THEN 'working' WHEN 'view' THEN 'episodic' WHEN 'purchase' THEN 'procedural' WHEN 'signup' THEN 'semantic' ELSE 'spatial' END AS memory_type,
 k % 25 AS access_count, k, epoch_us(ts) / 1e6 AS created_at, epoch_us(ts) / 1e6 AS updated_at, epoch_us(ts) / 1e6 AS last_accessed, epoch_us(ts) AS micros, event_type
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))""",
    "memories": """memories AS (SELECT * EXCLUDE (n), 1.0::DOUBLE AS current_strength, CASE WHEN k % 7 = 0 THEN 1209600.0::DOUBLE END AS ttl, NULL::DOUBLE AS invalid_at, CASE WHEN k % 50 = 0 THEN key END AS conflict_id
 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM commits) WHERE n = 1)""",
    "agents": "agents AS (SELECT * FROM (VALUES ('a0', 0.9::DOUBLE), ('a1', 0.7::DOUBLE), ('a2', 0.7::DOUBLE), ('a3', 0.5::DOUBLE)) AS t(agent_id, reliability))",
    "agent_beliefs": "agent_beliefs AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, key ORDER BY seq DESC) AS n FROM commits) WHERE n = 1)",
    "audit_log": """audit_log AS (SELECT seq AS id, op_type, key, micros, created_at, lag(value) OVER (PARTITION BY key ORDER BY seq) AS before, CASE WHEN op_type <> 'delete' THEN value END AS after, agent_id AS chain_id FROM commits)""",
    "doc_memories": "doc_memories AS (SELECT doc_id AS seq, 'd' || doc_id AS key, text AS value, 'semantic' AS memory_type, source AS session_id, round((doc_id % 100) / 100.0, 2) AS importance, doc_id % 3 = 0 AS is_verified, (doc_id % 25)::INT AS access_count, lang FROM documents)",
    "queries": "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "query_truth": "query_truth AS (SELECT query_id, key FROM doc_memories JOIN queries ON contains(value, query))",
    "kg_edges": """kg_edges AS (WITH li AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS (SELECT 'c' || o_custkey AS source, 'p' || l_partkey AS target, (l_orderkey + l_linenumber) % 5 AS t, 1 - l_discount AS w FROM li UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, (l_partkey + l_suppkey) % 5, 1 - l_tax FROM li
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0, 1.0 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0, 1.0 FROM nation)
 SELECT source, target, ['related_to', 'causes', 'contradicts', 'supports', 'temporal_before'][(t + 1)::INT] AS relation_type, max(round(w, 2)) AS weight FROM e GROUP BY ALL)""",
    "kg_sparse": """kg_sparse AS (SELECT 'c' || o_custkey AS source, 'p' || l_partkey AS target, ['related_to', 'causes', 'contradicts', 'supports', 'temporal_before'][((l_orderkey + l_linenumber) % 5 + 1)::INT] AS relation_type,
 max(round(1 - l_discount, 2)) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
}
NEEDS = {"memories": ["commits"], "agent_beliefs": ["commits"], "audit_log": ["commits"], "query_truth": ["doc_memories", "queries"]}


def with_tables(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` (its own CTEs after ``names``, then SELECT) with the named tables before it."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    head = ", ".join(SQL[n] for n in order)
    return f"WITH {'RECURSIVE ' * recursive}{head}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
