"""Keyed merges of a store with a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that an update leaves as they were.
KEPT = ("id", "created_at", "source", "session_id", "valid_at", "invalid_at", "ttl")


def last_of_each(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, now: float, touch: bool = True) -> DataFrame:
    """``current`` with the last row of each incoming key merged in.

    Keys that exist keep ``KEPT``.  ``touch`` counts an access and sets the
    times to ``now``; without it rows are taken as they come.
    """
    new = last_of_each(incoming, "key")
    columns = current.columns
    old = current.select("key", F.struct(*columns).alias("o"))
    both = old.join(new.select("key", F.struct(*[c for c in columns if c in new.columns]).alias("n")), "key", "full")
    fresh = set(new.columns)

    def value(c: str):
        if c == "key":
            return F.col("key")
        if c not in fresh:
            return F.col(f"o.{c}")
        if touch and c == "access_count":
            return F.when(F.col("n").isNull(), F.col("o.access_count")).when(F.col("o").isNull(), F.col("n.access_count") + 1).otherwise(F.col("o.access_count") + 1)
        if touch and c in ("updated_at", "last_accessed"):
            return F.when(F.col("n").isNotNull(), F.lit(now)).otherwise(F.col(f"o.{c}"))
        held = F.col("n").isNull() | (F.col("o").isNotNull() if c in KEPT else F.lit(False))
        return F.when(held, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return both.select(*[value(c).alias(c) for c in columns])


def forget(current: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left without ``keys``, and a log row (key, before, deleted) for each of them."""
    left = current.join(keys, "key", "left_anti")
    log = keys.select("key").distinct().join(current.select("key", F.col("value").alias("before"), F.lit(True).alias("deleted")), "key", "left")
    return left, log.withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def commit_log(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A log row (seq, op_type, key, before, after) for each incoming row; repeated keys see each other in order."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("seq"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    held = current.select("key", F.col("value").alias("stored"), F.lit(True).alias("there"))
    rows = incoming.select("seq", "key", F.col("value").alias("after"), before.alias("earlier"), first.alias("first")).join(held, "key", "left")
    op = F.when(F.col("first") & F.col("there").isNull(), "create").otherwise("update")
    return rows.select("seq", op.alias("op_type"), "key", F.when(F.col("first"), F.col("stored")).otherwise(F.col("earlier")).alias("before"), "after")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Graph nodes (name, node_type, properties, seq) merged by name: the first type stays, the last of each property wins."""
    types = nodes.groupBy("name").agg(F.min_by("node_type", "seq").alias("node_type"))
    each = nodes.select("name", "seq", F.explode("properties").alias("k", "v")).groupBy("name", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = each.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    return types.join(maps, "name", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def remove_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``names`` (name), and edges that touch none of them."""
    gone = names.select("name")
    left = edges.join(gone.withColumnRenamed("name", "source"), "source", "left_anti").join(gone.withColumnRenamed("name", "target"), "target", "left_anti")
    return nodes.join(gone, "name", "left_anti"), left


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without those named by (source, target) or (source, target, relation_type)."""
    return edges.join(pairs, [c for c in ("source", "target", "relation_type") if c in pairs.columns], "left_anti")
