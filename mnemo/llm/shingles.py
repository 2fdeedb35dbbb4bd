"""Near-duplicates by word shingles: Jaccard similarity of the sets of five-word windows.

Candidates come from two sources, and all are verified by the exact similarity
of their whole sets.  The first are SimHash fingerprints of the sets, linked by
deletion-variant signatures as in ``simhash``: texts that differ little.  At a
similarity of 0.8 fingerprints lie about ten bits apart, too far for any
signature that is still selective, so a second source is needed for whole
results: 128 smallest hashes in 32 bands of four.  A pair at similarity 0.8 has
a band in common but for 5 in 10^8 cases, a pair above it more surely still.

Equal sets fall together before.  As in ``simhash``, a band's texts are first
held against its smallest and most frequent one, those links are contracted,
and only texts that are still in another component are joined with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mnemo.llm.common import join_counted
from mnemo.llm.simhash import BITS, first_of_each, link
from mnemo.operators.components import connected_components
from mnemo.sources.durable import durable

BANDS, DEEP = 32, 4
SPAN, LEAST = 5, 0.8
_ODD = np.random.default_rng(20).integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _ODD[: BANDS * DEEP, None]
#: With more texts than this outside its first one's component, a band's texts are paired by rare shingles.
CROWDED = 16
#: Words whose hashes a task keeps.
KNOWN_WORDS = 200_000
#: A text is compared with many others, so a task keeps its shingles, of texts with up to SHORT of them and KEPT in all.
SHORT, KEPT = 2_000, 400_000


def shingles(text: str, known: dict[bytes, int], span: int = SPAN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word windows; one of all words if there are fewer, none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 7)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(span, len(h))
    total = np.full(len(h) - wide + 1, wide, np.uint64)
    for k in range(wide):
        total += h[k : len(h) - wide + 1 + k] * _ODD[-1 - k]
    total ^= total >> np.uint64(31)
    return np.unique(total * _ODD[-40])


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    made = np.empty((BANDS * DEEP, min(len(found), 256)), np.uint64)
    for k in range(0, len(found), 256):
        part = found[k : k + 256]
        turned = np.multiply(part, _TURNS, out=made[:, : len(part)])
        np.minimum(least, turned.min(1), out=least)
    mixed = least ^ (least >> np.uint64(29))
    keys = (mixed.reshape(BANDS, DEEP) * _ODD[200 : 200 + DEEP]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[300]
    return keys.view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(found), 1 << 14):
        total += np.unpackbits(found[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<i8")[0])


def signed(text: Column) -> Column:
    """(set, size, fp, bands) of each whole text; null is like empty."""

    @pandas_udf("set long, size long, fp long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for texts in batches:
            rows = []
            for t in texts:
                found = shingles(t or "", known)
                rows.append((int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 9), np.uint64).view(np.int64)), len(found), fingerprint(found), bands(found)))
            yield pd.DataFrame(rows, columns=["set", "size", "fp", "bands"])

    return run(text)


def shingled(text: Column) -> Column:
    """The set of each whole text."""

    @pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}
        for texts in batches:
            yield pd.Series([shingles(t or "", known).view(np.int64) for t in texts], dtype=object)

    return run(text)


def similarity(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two texts' sets; 1 for two empty ones."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}
        held: dict[str, frozenset] = {}
        room = KEPT

        def found(text: str) -> frozenset | np.ndarray:
            nonlocal room
            if text in held:
                return held[text]
            own = shingles(text, known)
            if len(own) > SHORT:
                return own
            if len(own) + 1 > room:
                held.clear()
                room = KEPT
            held[text] = frozenset(own.tolist())
            room -= len(own) + 1
            return held[text]

        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                p, q = found(x or ""), found(y or "")
                both = shared(p, q)
                out.append(both / (len(p) + len(q) - both) if len(p) + len(q) else 1.0)
            yield pd.Series(out, dtype="float64")

    return run(a, b)


def shared(p: frozenset | np.ndarray, q: frozenset | np.ndarray) -> int:
    """How many shingles two texts have in common."""
    if isinstance(p, frozenset) and isinstance(q, frozenset):
        return len(p & q)
    p, q = (np.fromiter(x, np.uint64, len(x)) if isinstance(x, frozenset) else x for x in (p, q))
    return len(np.intersect1d(p, q, assume_unique=True))


def sharing_rare(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v, size_u, size_v, cu, cv) from different components of ``texts`` (set, size, component, t): all of similarity ``least``, and some others.

    A set's shingles are put in order from rare to frequent.  Similar sets have
    their first common shingle within the first ``size - least * size + 1`` of
    both, and after it enough for the overlap still needed.
    """
    rows = durable(texts.select("set", "size", "component", F.explode(shingled(F.col("t"))).alias("shingle")))
    counts = durable(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").withColumn("texts", F.col("n")))
    of_set = Window.partitionBy("set")
    alone = F.col("size") - F.count("*").over(of_set)  # shingles of no other text come first
    firsts = join_counted(rows, counts, "shingle").withColumn("place", alone + F.row_number().over(of_set.orderBy("texts", "shingle")))
    firsts = durable(firsts.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1).drop("texts"))
    tops = firsts.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("n"), F.count("*").alias("components"), F.max(F.struct("c", "component")).alias("most"))
    tops = durable(tops.where("components > 1").select("shingle", "n", F.col("most.component").alias("most")))
    firsts = durable(join_counted(firsts, tops, "shingle").withColumn("outside", F.col("component") != F.col("most")).drop("most"))
    a, b = firsts.where("outside").alias("a"), firsts.alias("b")
    apart = (F.col("a.component") != F.col("b.component")) & (~F.col("b.outside") | (F.col("a.set") < F.col("b.set")))
    rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) + 1
    enough = rest >= (F.col("a.size") + F.col("b.size")) * (least / (1 + least)) - 1e-6
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & apart & enough)
    return pairs.select(F.col("a.set").alias("u"), F.col("b.set").alias("v"), F.col("a.size").alias("size_u"), F.col("b.size").alias("size_v"), F.col("a.component").alias("cu"), F.col("b.component").alias("cv"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v, size_u, size_v): each set with the most frequent one among those whose fingerprints are linked to its own."""
    fps = durable(nodes.groupBy("fp").agg(F.sum("n").alias("n"), F.max(F.struct("n", "set", "size")).alias("top")))
    linked = durable(fps.join(link(fps.select("fp", "n")), "fp").select("fp", "component", "top"))
    heads = durable(linked.groupBy("component").agg(F.max("top").alias("head"), F.count("*").alias("n")))
    headed = linked.join(heads.where("n > 1").drop("n"), "component", "left").select("fp", F.coalesce("head", "top").alias("head"))
    pairs = nodes.join(headed, "fp").where(F.col("set") != F.col("head.set"))
    return durable(pairs.select(F.col("set").alias("u"), F.col("head.set").alias("v"), F.col("size").alias("size_u"), F.col("head.size").alias("size_v")))


def near_duplicates(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """One row (doc_id, text_hash, component) for each row of ``docs``; texts without words are alike."""
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = docs.select("doc_id", hashed.alias("text_hash"), signed(F.col(text)).alias("s"))
    marked = durable(marked.select("doc_id", "text_hash", F.col("s.set").alias("set"), F.col("s.size").alias("size"), F.col("s.fp").alias("fp"), F.col("s.bands").alias("bands")))
    nodes = durable(marked.groupBy("set", "size", "fp").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("bands").alias("bands")))
    alike_fp = by_fingerprint(nodes)
    keyed = nodes.select("set", "size", "n", F.explode("bands").alias("key"))
    alike, end = Window.partitionBy("key"), F.struct("set", "size")
    keyed = keyed.withColumns({"many": F.count("*").over(alike), "least": F.min(end).over(alike), "top": F.max(F.struct("n", "set", "size")).over(alike)})
    keyed = durable(keyed.where("many > 1").select("key", "set", "size", "many", "least", "top"))

    in_pairs = keyed.select("set").unionByName(alike_fp.select(F.explode(F.array("u", "v")).alias("set"))).distinct()
    of = nodes.join(in_pairs, "set").select("set", F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"))
    source = docs.select("doc_id", hashed.alias("_hash2"), F.col(text).alias("t"))
    texts = source.join(of, source["doc_id"].eqNullSafe(of["_id"]) & (source["_hash2"] == of["_hash"])).select("set", "t")
    texts = durable(texts.dropDuplicates(["set"]))

    def near(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (u, v, size_u, size_v and more) whose texts are similar, each once."""
        able = F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * least - 1e-9
        pairs = pairs.where(able).dropDuplicates(["u", "v"])
        a, b = texts.select(F.col("set").alias("u"), F.col("t").alias("tu")), texts.select(F.col("set").alias("v"), F.col("t").alias("tv"))
        return pairs.join(a, "u").join(b, "v").where(similarity(F.col("tu"), F.col("tv")) >= least - 1e-9).drop("tu", "tv")

    held_to = lambda e: keyed.where(F.col("set") != F.col(f"{e}.set")).select(F.col("set").alias("u"), F.col(f"{e}.set").alias("v"), F.col("size").alias("size_u"), F.col(f"{e}.size").alias("size_v"))
    stars = durable(connected_components(near(alike_fp.unionByName(held_to("least")).unionByName(held_to("top"))).select("u", "v")))

    rest = keyed.where("many > 2").select("key", "set", "size", F.col("least.set").alias("least"))
    named = rest.join(stars.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    heads = stars.select(F.col("node").alias("least"), F.col("component").alias("head"))
    named = named.join(heads, "least", "left").withColumn("outside", F.col("component") != F.coalesce("head", "least"))
    named = durable(named.select("key", "set", "size", "component", "outside"))
    held = named.groupBy("key").agg(F.count("*").alias("n"), F.count_if("outside").alias("out"))
    held = durable(held.where("out > 0").select("key", "n", (F.col("out") > CROWDED).alias("crowded")))
    named = durable(join_counted(named, held, "key"))
    crowd = named.where("crowded").select("set", "size", "component").dropDuplicates(["set"])
    few = named.where("not crowded")
    a, b = few.where("outside").alias("a"), few.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & (~F.col("b.outside") | (F.col("a.set") < F.col("b.set")))
    crossing = a.join(b, apart).select(F.col("a.set").alias("u"), F.col("b.set").alias("v"), F.col("a.size").alias("size_u"), F.col("b.size").alias("size_v"), F.col("a.component").alias("cu"), F.col("b.component").alias("cv"))
    links = near(crossing.unionByName(sharing_rare(texts.join(crowd, "set"), least))).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    linked = connected_components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
    return marked.join(linked.withColumnRenamed("node", "set"), "set", "left").select("doc_id", "text_hash", F.coalesce("component", "set").alias("component"))


def one_of_each(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the one with the smallest doc_id stays."""
    return first_of_each(docs, near_duplicates(docs, text, least), "component", text)
