"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most four bits agree, in one of three
segments, but for at most one bit.  Each fingerprint is indexed under its
segments with one bit left out (64 keys), so that segment shares a key, which
an equality join finds and the whole fingerprints verify.

Only different fingerprints are indexed: copies fall together before.  Within
a key nothing emits all pairs: every fingerprint is first held against the
key's smallest and most frequent ones, those links are contracted, and only
fingerprints that are still in another component than the key's smallest one
are joined with the rest of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mnemo.llm.common import join_counted, spread
from mnemo.operators.components import connected_components
from mnemo.sources.durable import durable

BITS = 64


def simhash(text: str, span: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number; bytes split() takes exactly the white space meant here."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < span:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        starts = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:-span].tolist(), (starts[span:] - 1).tolist(), strict=True)]
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, span: int = 4, seed: int = 42) -> Column:
    """Fingerprint of each whole text; 0 for null and for texts without words."""

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t or "", span, seed) for t in texts], dtype="int64")

    return run(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def signatures(fp: Column, segments: int) -> list[Column]:
    """One key for each bit: the bit's segment without it, marked with the bit's number."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for b in range(high - low):
            short = F.shiftleft(F.shiftrightunsigned(part, b + 1), b).bitwiseOR(part.bitwiseAND(F.lit((1 << b) - 1)))
            out.append(short.bitwiseOR(F.lit((low + b) << 40)))
    return out


def near(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def link(fps: DataFrame, most: int = 4) -> DataFrame:
    """(fp, component) for every row of ``fps`` (fp, n), all fp different; the component is its smallest fingerprint."""
    segments = most // 2 + 1
    keyed = spread(fps).select("fp", "n", F.explode(F.array(*signatures(F.col("fp"), segments))).alias("key"))
    alike = Window.partitionBy("key")
    keyed = keyed.withColumns({"size": F.count("*").over(alike), "least": F.min("fp").over(alike), "top": F.max(F.struct("n", "fp")).over(alike)["fp"]})
    keyed = durable(keyed.where("size > 1").select("key", "fp", "size", "least", "top"))
    held_to = lambda end: keyed.select(F.col("fp").alias("u"), F.col(end).alias("v")).where((F.col("u") != F.col("v")) & near(F.col("u"), F.col("v"), most))
    first = held_to("least").unionByName(held_to("top"))
    stars = durable(connected_components(first))

    rest = keyed.where("size > 2").select("key", "fp", "least")
    named = rest.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = stars.select(F.col("node").alias("least"), F.col("component").alias("head"))
    named = named.join(heads, "least", "left").withColumn("outside", F.col("component") != F.coalesce("head", "least"))
    named = durable(named.select("key", "fp", "component", "outside"))
    a, b = named.where("outside").alias("a"), named.alias("b")
    crossing = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.component") != F.col("b.component"))
        & (~F.col("b.outside") | (F.col("a.fp") < F.col("b.fp")))
        & near(F.col("a.fp"), F.col("b.fp"), most),
    ).select(F.col("a.component").alias("u"), F.col("b.component").alias("v"))
    linked = connected_components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(crossing))
    return fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", most: int = 4) -> DataFrame:
    """One row (doc_id, text_hash, fp, component_id) for each row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint 0 and are linked
    like any other.  Repeated rows fall into one component.  A null doc_id is
    never the smallest unless its component has no other.  An empty table gives
    an empty one.
    """
    marked = durable(docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), fingerprint(F.col(text)).alias("fp")))
    fps = durable(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    linked = durable(fps.join(link(fps.select("fp", "n"), most), "fp").select("fp", F.col("n").alias("n_docs"), "first", "component"))
    # a component may hold a third of all fingerprints, and a fingerprint a third of all documents
    ids = durable(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = durable(join_counted(linked, ids, "component", most=0).select("fp", "component_id", F.col("n_docs").alias("n")))
    return join_counted(marked, named, "fp", most=0).select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", most: int = 4) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the one with the smallest doc_id stays."""
    return first_of_each(docs, near_duplicates(docs, text, most), "component_id", text)


def first_of_each(docs: DataFrame, marked: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Of each group ``by`` of ``marked`` (doc_id, text_hash, by) the row of ``docs`` with the smallest doc_id.

    The survivors' ids are found without texts; the texts are then joined on
    doc_id, which no group of copies makes uneven.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = marked.groupBy(by).agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    # the columns of docs go as one, so that theirs and those added here can't clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_of"))
    found = held.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash")))
    # rows that agree in both are one document more than once
    once = Window.partitionBy("_own", "_of").orderBy(F.lit(1))
    return found.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
