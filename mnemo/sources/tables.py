"""Readers and writers: memory tables, imports, exports, Markdown, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a memory table, in order.
MEMORIES = (
    "id string, key string, memory_type string, value string, metadata string, ccs_dimensions map<string,double>, source string, session_id string, created_at double, updated_at double, last_accessed double, "
    "access_count int, valid_at double, invalid_at double, ttl double, is_verified boolean, verification_score double, verification_method string, importance double, decay_rate double, current_strength double, "
    "conflict_id string, superseded_by string, agent_id string, seq bigint"
)
EXPORTED = ("key", "memory_type", "value", "metadata", "importance", "current_strength", "is_verified", "source", "created_at")
#: Words of a section's title that tell its type, tried in order (fixed values).
SECTIONS = {
    "rules": (("semantic", ("rule", "constraint", "policy", "format", "style")), ("procedural", ("example", "instruction", "process", "workflow", "step")), ("episodic", ("context", "decision", "note", "history", "session"))),
    "agents": (("semantic", ("rule", "constraint", "guideline", "policy")), ("procedural", ("process", "workflow", "step", "how", "instruction")), ("episodic", ("example", "history", "session", "note", "context"))),
}


def read_memories(spark: SparkSession, path: str, **jdbc: str) -> DataFrame:
    """A memory table from Parquet, with nulls for columns the files lack, or by JDBC when options for it are given.

    A large table is read by many tasks only with ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` among the options.
    """
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.schema(MEMORIES).parquet(path)


def read_import(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Rows to import, bad ones kept in ``_corrupt``; ``idx`` numbers nothing here, callers give one for default keys."""
    schema = "key string, value string, memory_type string, metadata string, importance double, source string, idx bigint, _corrupt string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path) if fmt == "json" else reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def import_memories(rows: DataFrame, default_type: str = "semantic", most_rejects: int = 20) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of rows with idx, key, value, memory_type, metadata, importance, source, _corrupt.

    Missing keys become ``imported:{idx}``; metadata that is no JSON becomes
    ``{}``; rows that could not be read, or have no value, are rejected and
    some of them listed.
    """
    bad = F.col("_corrupt").isNotNull() | F.col("value").isNull()
    known = F.col("memory_type").isin("episodic", "procedural", "semantic", "working", "spatial")
    entries = rows.where(~bad).select(
        F.coalesce(F.when(F.trim("key") != "", F.col("key")), F.concat(F.lit("imported:"), F.col("idx").cast("string"))).alias("key"),
        F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.to_json(F.struct("value"))).alias("value"),
        F.when(known, F.col("memory_type")).otherwise(default_type).alias("memory_type"),
        F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")).otherwise("{}").alias("metadata"),
        F.coalesce("importance", F.lit(1.0)).alias("importance"),
        F.coalesce("source", F.lit("import")).alias("source"),
        F.col("idx").alias("seq"),
    )
    return entries, rows.where(bad).orderBy("idx").limit(most_rejects)


def exported(memories: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest ``limit`` rows in the exported columns; those that a table lacks are null."""
    out = memories.orderBy(F.desc("created_at"), "key").limit(limit)
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(c) for c in EXPORTED])


def export_memories(memories: DataFrame, path: str, fmt: str = "json", limit: int = 1000) -> None:
    out = exported(memories, limit).write.mode("overwrite")
    out.json(path) if fmt == "json" else out.option("header", True).option("escape", '"').csv(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """Nodes, edges and, if given, their stats (``graph.graph_stats``) in folders of ``path``."""
    for name, df in (("nodes", nodes), ("edges", edges), ("stats", stats)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); ``graph.load_graph`` gives the index of entities as well."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def section_type(title: Column, style: str) -> Column:
    out = F.lit("semantic")
    for kind, words in reversed(SECTIONS[style]):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(title), F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def split_sections(docs: DataFrame, style: str = "rules") -> DataFrame:
    """(key, part, title, body, memory_type) of Markdown texts (key, text): a row per headed section, or one for all of it."""
    pattern = F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)\n?((?:(?!^#{1,6}[ \t])[^\n]*\n?)*)")
    titles, bodies = F.regexp_extract_all("text", pattern, F.lit(1)), F.regexp_extract_all("text", pattern, F.lit(2))
    sections = F.zip_with(titles, bodies, lambda t, b: F.struct(F.trim(t).alias("title"), F.trim(F.regexp_replace(b, r"\s+$", "")).alias("body")))
    whole = F.array(F.struct(F.lit("").alias("title"), F.trim("text").alias("body")))
    out = docs.select("key", F.posexplode(F.when(F.size(titles) > 0, sections).otherwise(whole)).alias("part", "s"))
    return out.select(F.concat("key", F.lit("#"), F.hex(F.xxhash64("s.title", "part"))).alias("key"), "part", "s.title", "s.body", section_type(F.col("s.title"), style).alias("memory_type"))


def explode_json_memories(docs: DataFrame) -> DataFrame:
    """(key, name, value, memory_type) of JSON texts (key, text): a row per entry of an object or item of a list, else one raw row."""
    parsed = F.try_parse_json("text")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    entry = lambda name, value, kind: F.struct(name.alias("name"), value.alias("value"), kind.alias("memory_type"))
    of_map = F.transform(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: entry(e["key"], e["value"], F.lit("semantic")))
    item_type = lambda v: F.coalesce(F.get_json_object(v, "$.type"), F.lit("episodic"))
    of_list = F.transform(F.from_json("text", "array<string>"), lambda v, i: entry(i.cast("string"), v, item_type(v)))
    raw = F.array(entry(F.lit("raw"), F.col("text"), F.lit("semantic")))
    return docs.select("key", F.inline(F.when(is_object, of_map).when(is_list, of_list).otherwise(raw)))


def assemble_export(memories: DataFrame, by: str, style: str = "markdown") -> DataFrame:
    """(by, document): memories grouped under their types, or as a JSON list; a document grows with its owner's memories."""
    if style == "json":
        item = F.struct("seq", F.to_json(F.struct("key", F.col("memory_type").alias("type"), "value", F.col("importance").alias("confidence"))).alias("j"))
        items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])
        return memories.groupBy(by).agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("document"))
    entry = F.concat(F.lit("### "), F.col("key"), F.lit("\n"), F.col("value"))
    parts = memories.groupBy(by, "memory_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"]), "\n").alias("t"))
    section = F.struct("memory_type", F.concat(F.lit("## "), F.col("memory_type"), F.lit("\n"), F.col("t")).alias("s"))
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), "\n").alias("document"))


def user_turn_corpus(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): a conversation's user turns in order, one line each."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("text"))


def snapshot(memories: DataFrame, chained: DataFrame, path: str, stamp: str) -> DataFrame:
    """Writes all entries under ``snapshot_ts`` and returns counts by type with the chains' last roots' hash."""
    from mnemo.operators.log import root_of_roots

    memories.withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("snapshot_ts").parquet(path)
    counts = memories.groupBy("memory_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(root_of_roots(chained).select("root"))).withColumn("snapshot_ts", F.lit(stamp))
