"""Mixing sources to target weights.

Each source is cut into blocks of documents by a keyed hash, so a source that
holds a third of all rows is just a source with more blocks.  The words wanted
of a source become an exact number of block draws, in passes over its permuted
blocks.  A multivariate-hypergeometric splitting tree divides the draws among
output shards: every node halves its slots and draws how many of each source go
left, so shard quotas add up exactly at every level.  Each shard draws as many
blocks of a source as its quota says, a run of the source's permuted draws that
no other shard has; what the mix takes of a document is what the shards drew of
it.  Shards are shuffled by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import let, n_words, unit_interval
from mnemo.sources.durable import durable

#: Source tables of up to so many rows are broadcast (about 100 bytes each); larger ones are joined by shuffle.
SMALL_ROWS = 50_000
#: Rows of one group that a task puts in order, on average.
RANGE_ROWS = 10_000
#: Levels of the tree between two distributions of its nodes over tasks.
SPREAD = 6


def hypergeometric(pop: Column, good: Column, slots: Column, u: Column) -> Column:
    """The draw at ``u`` in [0, 1): how many of ``good`` among ``pop`` land in ``slots``.

    Inversion from the mode outwards by the ratio of neighbouring
    probabilities, over ten standard deviations each way (the mass beyond is
    under 1e-20).  The result always lies in the distribution's support.
    """
    p, k, n = (c.cast("double") for c in (pop, good, slots))
    shape = F.struct(
        F.greatest(F.lit(0.0), n + k - p).alias("lo"),
        F.least(n, k).alias("hi"),
        F.floor((n + 1) * (k + 1) / (p + 2)).cast("double").alias("mode"),
        (10 + 10 * F.sqrt(n * (k / F.greatest(p, F.lit(1.0))) * (1 - k / F.greatest(p, F.lit(1.0))))).alias("reach"),
    )

    def inner(s: Column) -> Column:
        mode = F.least(F.greatest(s["mode"], s["lo"]), s["hi"])
        return let(
            F.struct(mode.alias("m"), F.greatest(s["lo"], F.ceil(mode - s["reach"]).cast("double")).alias("a"), F.least(s["hi"], F.floor(mode + s["reach"]).cast("double")).alias("b")),
            choose,
        )

    def up(w: Column, x: Column) -> Column:
        return w * (k - x + 1) * (n - x + 1) / (x * (p - k - n + x))

    def down(w: Column, x: Column) -> Column:
        return w * (x + 1) * (p - k - n + x + 1) / ((k - x) * (n - x))

    def steps(first: Column, last: Column, by: int) -> Column:
        some = first <= last if by > 0 else first >= last
        return F.when(some, F.sequence(first.cast("long"), last.cast("long"), F.lit(by).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def choose(s: Column) -> Column:
        above, below = steps(s["m"] + 1, s["b"], 1), steps(s["m"] - 1, s["a"], -1)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        mass = lambda xs, ratio: F.aggregate(
            xs, start, lambda acc, x: let(ratio(acc["w"], x), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))), lambda acc: acc["sum"]
        )
        return let(
            F.struct((u * (1 + mass(above, up) + mass(below, down))).alias("v"), mass(above, up).alias("up")),
            lambda t: F.when(t["v"] < 1, s["m"])
            .when(t["v"] < 1 + t["up"], pick(above, up, t["v"] - 1, s["m"]))
            .otherwise(pick(below, down, t["v"] - 1 - t["up"], s["m"])),
        )

    def pick(xs: Column, ratio: Callable, v: Column, default: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        return F.aggregate(
            xs,
            start,
            lambda acc, x: let(
                ratio(acc["w"], x),
                lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.coalesce(acc["at"], F.when(acc["sum"] + w > v, x.cast("double"))).alias("at")),
            ),
            lambda acc: F.coalesce(acc["at"], default),
        )

    return let(shape, inner).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """Per source: its rank ``s`` (code points, null last), ``source_size``, ``n_docs`` and ``target``.

    ``weights`` repeat over the ranks.  Targets stop at ``most`` times the
    source's size; what that frees goes to the others by weight.  A source is
    capped exactly where filling all sources up to its own level takes no more
    than the total, so one ordered pass finds the level.  The table has a row
    per source, ordered as one list.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = by.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns({"w": F.get(F.array(*[F.lit(x) for x in weights]), (F.col("s") - 1) % len(weights)), "cap": F.col("source_size") * most})
    ranked = ranked.withColumn("level", F.col("cap") / F.col("w"))
    whole, upto = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({"total": F.sum("source_size").over(whole) * F.lit(share), "full": F.sum("cap").over(upto) + F.col("level") * (F.sum("w").over(whole) - F.sum("w").over(upto))})
    capped = F.col("full") <= F.col("total")
    left = F.col("total") - F.coalesce(F.sum(F.when(capped, F.col("cap"))).over(whole), F.lit(0))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(left / F.sum(F.when(~capped, F.col("w"))).over(whole) * F.col("w"))
    return ranked.select("source", "s", "source_size", "n_docs", target.cast("double").alias("target"))


def shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, shard, first, q): how many of each source's draws every shard gets, and where its run of them begins.

    ``draws`` has a row (s, q) per source; ``shards`` is a power of two.  A
    node is a row with the quota of each source and begins as the root alone;
    every few levels the nodes are dealt out, so that subtrees are tasks of
    their own.  A node's row grows with the number of sources only.
    """
    long = F.lit(0).cast("long")
    quota = F.sort_array(F.collect_list(F.struct("s", long.alias("first"), F.col("q").cast("long").alias("q"))))
    node = draws.where("q > 0").groupBy().agg(quota.alias("quota")).select(long.alias("shard"), "quota")
    for level in range(int(math.log2(shards))):
        if level and level % SPREAD == 0:
            node = node.repartition(min(1 << level, 1 << 2 * SPREAD), "shard")
        total = F.aggregate("quota", long, lambda n, x: n + x["q"])
        start = F.struct(F.col("total").alias("pop"), F.floor(F.col("total") / 2).cast("long").alias("slots"), F.array().cast("array<bigint>").alias("left"))

        def step(acc: Column, x: Column) -> Column:
            u = unit_interval(F.lit(seed), F.lit(level), F.col("shard"), x["s"])  # noqa: B023
            return let(
                hypergeometric(acc["pop"], x["q"], acc["slots"], u),
                lambda n: F.struct((acc["pop"] - x["q"]).alias("pop"), (acc["slots"] - n).alias("slots"), F.concat(acc["left"], F.array(n)).alias("left")),
            )

        node = node.withColumn("total", total).withColumn("left", F.aggregate("quota", start, step, lambda acc: acc["left"]))
        part = lambda first, q: F.zip_with("quota", "left", lambda x, n: F.struct(x["s"].alias("s"), first(x, n).alias("first"), q(x, n).alias("q")))
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), part(lambda x, n: x["first"], lambda x, n: n).alias("quota")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), part(lambda x, n: x["first"] + n, lambda x, n: x["q"] - n).alias("quota")),
        )
        node = node.select(F.inline(halves))
    return node.select("shard", F.inline("quota")).where("q > 0")


def in_order(rows: DataFrame, by: list[str], key: Column, value: str, n_rows: int) -> DataFrame:
    """``rows`` with ``r``, their number in order of the hash ``key`` within ``by``, and ``before``, the sum of ``value`` over those ahead.

    The hash's range is cut into parts of about ``RANGE_ROWS`` rows; parts are
    added up first, and rows only sorted inside a part, so that no group is
    one task.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_rows / RANGE_ROWS))))
    rows = rows.withColumn("_key", F.shiftrightunsigned(key, 2))
    rows = rows.withColumn("_part", F.shiftright("_key", 62 - bits))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    parts = parts.select(*by, "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_n"), F.coalesce(F.sum("v").over(ahead), F.lit(0)).alias("_v"))
    inside = Window.partitionBy(*by, "_part").orderBy("_key", "pass", "_block")
    out = rows.join(parts, [*by, "_part"])
    upto = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"r": F.col("_n") + F.row_number().over(inside) - 1, "before": F.col("_v") + upto - F.col(value)}).drop("_key", "_part", "_n", "_v")


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: int = 17, block_docs: int = 50, shard_blocks: int = 4, targets: DataFrame | None = None) -> DataFrame:
    """Every row of ``sized`` (doc_id, source, size, ...) with what the mix takes of it.

    Adds ``source_size``, ``target``, ``taken`` (words, repeats counted) and
    ``draws``: an array of (pass, shard, words, at), one entry for each shard's
    draw of the document.  A source's ``taken`` sum to its target rounded to
    whole words: the last block of its quota is cut at a document, and that
    document at a word.  Null sources form one source; rows of size 0 are in no
    draw; equal rows are interchangeable; an empty table gives an empty one.
    Added columns replace columns of the same names.
    """
    sized = sized.drop("source_size", "target", "taken", "draws", "s", "n_docs")
    sources = durable(targets if targets is not None else source_targets(sized, weights, most, share))
    n_sources, n_docs = sources.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    small = F.broadcast(sources) if n_sources <= SMALL_ROWS else sources
    blocks = F.greatest(F.ceil(F.col("n_docs") / block_docs), F.lit(1))
    right = small.withColumnRenamed("source", "_source")
    docs = sized.join(right, sized["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    docs = docs.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("_block", F.pmod(F.col("_key"), blocks))

    # quotas: a source's draws, as many of its permuted blocks, pass by pass, as its target needs
    n_blocks = n_docs // block_docs + n_sources
    sums = docs.groupBy("s", "_block").agg(F.sum("size").alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    sums = durable(sums.where("block_size > 0"))
    wanted = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    wanted = in_order(wanted, ["s", "pass"], F.xxhash64(F.lit(seed), "s", "pass", "_block"), "block_size", n_blocks)
    left = F.round("target").cast("long") - F.col("before") - F.col("pass") * F.col("source_size")
    wanted = durable(wanted.withColumn("words", F.least(F.col("block_size"), left)).where("words > 0").select("s", "_block", "pass", "words", "block_size"))

    # the tree divides them among shards, and each shard draws its run
    shards = 1 << max(0, math.ceil(math.log2(max(1, n_docs / block_docs / shard_blocks))))
    quotas = shard_quotas(wanted.groupBy("s").agg(F.count("*").alias("q")), shards, seed)
    turns = quotas.select("s", "shard", F.explode(F.sequence("first", F.col("first") + F.col("q") - 1)).alias("r"))
    permuted = in_order(wanted, ["s"], F.xxhash64(F.lit(seed + 1), "s", "pass", "_block"), "words", n_blocks * most)
    drawn = turns.join(permuted, ["s", "r"])
    drawn = drawn.groupBy("s", "_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "words", "block_size"))).alias("_draws"))

    inside = Window.partitionBy("s", "_block").orderBy("_key", "doc_id", "size")
    docs = docs.withColumn("_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    docs = docs.join(drawn, ["s", "_block"], "left")
    each = lambda d: F.when(d["words"] == d["block_size"], F.col("size")).otherwise(F.least(F.col("size"), F.greatest(F.lit(0), d["words"] - F.col("_before"))))
    draws = F.transform("_draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), each(d).cast("long").alias("words"), F.xxhash64(F.lit(seed), d["pass"], d["shard"], F.col("_key")).alias("at")))
    draws = F.filter(draws, lambda d: (d["words"] > 0))
    docs = docs.withColumn("draws", F.coalesce(draws, F.array().cast("array<struct<pass:int,shard:bigint,words:bigint,at:bigint>>")))
    docs = docs.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]))
    docs = docs.withColumn("target", F.coalesce("target", F.lit(0.0)))
    return docs.select(*[F.col(f"`{c}`") for c in sized.columns], "source_size", "target", "taken", "draws")


def sized_documents(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *columns)


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the drawn documents, repeats included, shard by shard and shuffled in each shard.

    A document that the mix cuts ends with its last taken word.  Null and blank
    texts are in no draw and don't come back; a document drawn more than once
    comes back as often.  Columns named like those of ``mix`` are kept as they
    are, and an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    out = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*rest).alias("_rest")), **options)
    out = out.select("doc_id", "source", "size", "_rest", F.explode("draws").alias("d"))
    text = F.when(F.col("d.words") < F.col("size"), first_words(F.col("_rest.text"), F.col("d.words"))).otherwise(F.col("_rest.text"))
    out = out.withColumn("_text", text).repartition("d.shard").sortWithinPartitions("d.shard", "d.at")
    new = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
