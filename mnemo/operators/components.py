"""Connected components by alternating star contraction: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.sources.durable import durable


#: Up to so many edges, a round's smallest neighbours (at most two rows an edge, each a pair of nodes) are broadcast.
SMALL_EDGES = 100_000
#: A round is written in a file for so many edges.
FILE_EDGES = 50_000


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large and one small star step over ``n`` edges (u, v), u > v; neither makes more edges."""
    small = n <= SMALL_EDGES
    table = F.broadcast if small else lambda df: df
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(table(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large if small else large.distinct()  # its shuffle serves both uses below; few edges are cheaper joined again
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    nearer = large.join(table(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = nearer.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return out.coalesce(1 + n // FILE_EDGES)


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every end of ``edges`` (u, v); the component is its smallest node.

    Each round contracts every neighbourhood onto its smallest node and is
    written to the shared folder, so lineage stays short; rounds grow with the
    logarithm of the longest path.  Only a count and a checksum reach the driver.
    Null ends and loops are dropped; a node that occurs only so is not returned.
    """
    held = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    held = durable(held)
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    was = mark(held)
    for _ in range(most_rounds):
        if not was[0]:
            break
        held = durable(_stars(held, was[0]))
        now = mark(held)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = held.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
