"""Queries over readers, writers and hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemo.functions import hooks
from mnemo.operators import graph as H
from mnemo.operators import upsert as U
from mnemo.plans import fixtures as T
from mnemo.plans.recall_queries import ENTITY
from mnemo.plans.registry import query
from mnemo.sources import tables as A
from mnemo.sources.durable import job_dir


@query("export_memories", "memories", "SELECT key, memory_type, value, round(importance, 6) AS importance, is_verified FROM memories ORDER BY created_at DESC, key LIMIT 1000")
def export_memories(spark, sf):
    return A.exported(T.memories(spark, sf)).select("key", "memory_type", "value", F.round("importance", 6).alias("importance"), "is_verified")


@query("import_memories", "memories", "SELECT CASE WHEN access_count % 3 = 0 THEN 'imported:' || seq ELSE key END AS key, value, CASE WHEN memory_type = 'view' THEN 'semantic' ELSE memory_type END AS memory_type, 'import' AS source FROM memories WHERE access_count <> 1")
def import_memories(spark, sf):
    m = T.memories(spark, sf)
    rows = m.select(
        F.when(F.col("access_count") % 3 != 0, F.col("key")).alias("key"), "value", "memory_type", F.lit("no json").alias("metadata"), "importance", F.lit(None).cast("string").alias("source"), F.col("seq").alias("idx"),
        F.when(F.col("access_count") == 1, "broken").alias("_corrupt"),
    )
    return A.import_memories(rows)[0].select("key", "value", "memory_type", "source")


@query("assemble_export", "memories", """p AS (SELECT session_id, memory_type, string_agg('### ' || key || chr(10) || value, chr(10) ORDER BY seq) AS t FROM memories GROUP BY ALL)
 SELECT session_id, string_agg('## ' || memory_type || chr(10) || t, chr(10) ORDER BY memory_type) AS document FROM p GROUP BY 1""")  # fmt: skip
def assemble_export(spark, sf):
    return A.assemble_export(T.memories(spark, sf), "session_id")


@query("split_sections", "memories", """d AS (SELECT session_id AS key, key AS name, value, seq FROM memories) SELECT key, count(*) AS sections, min(name || ' rules') AS first_title, 'semantic' AS kind FROM d GROUP BY 1""")
def split_sections(spark, sf):
    """Each session's memories written as Markdown under headings, and taken apart again."""
    part = F.concat(F.lit("## "), F.col("key"), F.lit(" rules\n"), F.col("value"))
    docs = T.memories(spark, sf).groupBy(F.col("session_id").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("text")).withColumnRenamed("k", "key")
    s = A.split_sections(docs).withColumn("key", F.substring_index("key", "#", 1))
    return s.groupBy("key").agg(F.count("*").alias("sections"), F.min("title").alias("first_title"), F.min("memory_type").alias("kind"))


@query("explode_json_memories", "", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value, 'semantic' AS memory_type FROM events")
def explode_json_memories(spark, sf):
    docs = T.table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("props").alias("text"))
    return A.explode_json_memories(docs).withColumnRenamed("key", "event_id")


@query("rebuild_entity_index", "doc_memories", ENTITY + "SELECT entity, key FROM ei")
def rebuild_entity_index(spark, sf):
    nodes, edges = H.ingest(T.doc_memories(spark, sf))
    return H.rebuild_index(nodes, edges)


@query("graph_reimport", "doc_memories", ENTITY + "SELECT entity, key FROM ei")
def graph_reimport(spark, sf):
    """The graph of all documents written, read again, and its index rebuilt."""
    path = f"{job_dir(spark)}/graph-{uuid.uuid4().hex}"
    A.export_graph(*H.ingest(T.doc_memories(spark, sf)), path)
    return H.load_graph(spark, path)[2]


@query("upsert_nodes", "kg_edges", "e AS (SELECT source AS name, relation_type AS k, max_by(target, seq) AS v FROM (SELECT *, row_number() OVER (ORDER BY source, target, relation_type) AS seq FROM kg_edges) GROUP BY ALL) SELECT name, 'node' AS node_type, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM e GROUP BY 1")
def upsert_nodes(spark, sf):
    e = T.kg_edges(spark, sf)
    order = F.struct("source", "target", "relation_type")
    rows = e.select(F.col("source").alias("name"), F.lit("node").alias("node_type"), F.create_map("relation_type", "target").alias("properties"), order.alias("seq"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return U.upsert_nodes(rows).select("name", "node_type", text.alias("properties"))


@query("remove_nodes", "kg_edges", "SELECT count(*) AS edges FROM kg_edges WHERE NOT starts_with(source, 'c1') AND NOT starts_with(target, 'c1')")
def remove_nodes(spark, sf):
    e = T.kg_edges(spark, sf)
    nodes = e.select(F.col("source").alias("name")).distinct()
    return U.remove_nodes(nodes, e, nodes.where("name like 'c1%'"))[1].agg(F.count("*").alias("edges"))


@query("remove_edges", "kg_edges", "SELECT source, target, relation_type FROM kg_edges WHERE relation_type <> 'causes'")
def remove_edges(spark, sf):
    e = T.kg_edges(spark, sf)
    return U.remove_edges(e, e.where("relation_type = 'causes'").select("source", "target", "relation_type")).select("source", "target", "relation_type")


@query("embed_documents")
def embed_documents(spark, sf):
    return T.doc_memories(spark, sf).select("key", hooks.embed(F.col("value")).alias("embedding"))
