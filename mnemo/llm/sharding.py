"""Shards of near equal bytes by histogram sort.

Rows are ordered by a hash of their text and, among equal texts, by a hash of
the row.  Splitters between shards are found by counting: each round adds up,
over all rows, the exact bytes below evenly spaced probes of the key ranges that
still hold a splitter, and narrows each of them to the range between two probes.
A splitter settles where a probe's bytes come within the tolerance of its
share.  Probes fall between texts first, so equal texts stay in one shard unless
a shard's share ends inside so large a group of them.

Then rows move once, to their shard and a part of it.  Inside a shard they are
in order of another hash of the row, which no group of equal texts makes uneven.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.sources.durable import durable

#: Bits of a key's two halves, and bits that a round's probes tell apart.
KEY_BITS, PROBE_BITS = 60, 12
#: Rows that a task numbers, on average.
PART_ROWS = 5_000


@dataclass(frozen=True)
class Range:
    """Keys from (text, row) on: of one text if ``inside``, else of all rows; ``bits`` of them are open."""

    text: int = 0
    row: int = 0
    inside: bool = False
    bits: int = KEY_BITS

    @property
    def step(self) -> int:
        return 1 << (self.bits - PROBE_BITS)

    def holds(self) -> Column:
        low, open_ = (self.row, F.col("_row")) if self.inside else (self.text, F.col("_text"))
        here = (open_ >= low) & (open_ < low + (1 << self.bits))
        return (F.col("_text") == self.text) & here if self.inside else here

    def probe(self) -> Column:
        low, open_ = (self.row, F.col("_row")) if self.inside else (self.text, F.col("_text"))
        return F.shiftright(open_ - F.lit(low), self.bits - PROBE_BITS).cast("int")

    def start(self, digit: int) -> tuple[int, int]:
        """The key at a probe."""
        return (self.text, self.row + digit * self.step) if self.inside else (self.text + digit * self.step, 0)

    def narrowed(self, digit: int, least: int, most: int) -> Range | None:
        """The range from one probe to the next, whose texts' hashes lie between ``least`` and ``most``; None if no bits are left."""
        if not self.inside and least == most:
            return Range(text=least, inside=True)
        text, row = self.start(digit)
        out = replace(self, text=text, row=row, bits=self.bits - PROBE_BITS)
        return out if out.bits else None


def splitters(keyed: DataFrame, shards: int, weight: str, tolerance: float) -> list[tuple[int, int]]:
    """Keys at which the shards 1, 2, ... begin; ``keyed`` has _text, _row and ``weight``.

    A round brings at most 4,096 sums for each open range to the driver, of
    which there are fewer than shards.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    slack = total / shards * tolerance
    settled: dict[int, tuple[int, int]] = {}
    # of each splitter: the range that holds it, and the weight below that range
    where: dict[int, tuple[Range, int]] = {s: (Range(), 0) for s in range(1, shards)} if total else {}
    while where:
        ranges = list(dict.fromkeys(r for r, _ in where.values()))
        which = probe = F.lit(None).cast("int")
        for k, r in enumerate(ranges):
            which, probe = F.when(r.holds(), k).otherwise(which), F.when(r.holds(), r.probe()).otherwise(probe)
        counted = keyed.select("_text", weight, which.alias("range"), probe.alias("probe")).where("range is not null").groupBy("range", "probe")
        sums = counted.agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("_text").alias("least"), F.max("_text").alias("most")).collect()
        found: dict[int, list] = {}
        for row in sorted(sums, key=lambda x: (x["range"], x["probe"])):
            found.setdefault(row["range"], []).append(row)
        still = {}
        for s, (r, below) in where.items():
            share = s * total // shards
            for row in found[ranges.index(r)]:
                if below + row["w"] > share:
                    break
                below += row["w"]
            # the splitter's share ends in this row's probe: at its start, at its end, or inside
            before, after = share - below, below + row["w"] - share
            deeper = r.narrowed(row["probe"], row["least"], row["most"]) if row["n"] > 1 else None
            if min(before, after) <= slack or deeper is None:
                settled[s] = r.start(row["probe"] + (after < before))
            else:
                still[s] = (deeper, below)
        where = still
    return [settled[s] for s in sorted(settled)]


def shard_of(starts: list[tuple[int, int]]) -> Column:
    """The shard of a row: how many of the splitters lie at or below its key."""
    out = F.lit(0)
    for text, row in starts:
        out = out + F.when((F.col("_text") > text) | ((F.col("_text") == text) & (F.col("_row") >= row)), 1).otherwise(0)
    return out


def sharded(docs: DataFrame, shards: int = 24, law: str = "bytes", tolerance: float = 0.005, text: str = "text", keep: list[str] | None = None, seed: int = 29) -> DataFrame:
    """Rows of ``docs`` (all columns, or those to ``keep``) with size, text_crc32, law, shard and slot; columns of these names are replaced.

    ``law`` is ``bytes`` (a shard's sizes sum to its share, but for twice
    ``tolerance`` of it or one document) or ``rows`` (counts at most one apart).
    Size is a text's UTF-8 bytes plus 8; a null text is like an empty one.
    Repeated rows are told apart by their place in the input.  An empty table
    gives an empty one.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "law", "shard", "slot")]
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 64 - KEY_BITS)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_rest"),
        (F.octet_length(value).cast("long") + 8).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        hashed(value).alias("_text"),
        hashed(F.col("doc_id"), F.monotonically_increasing_id()).alias("_row"),
        F.lit(1).cast("long").alias("_one"),
    )
    rows = durable(rows)  # places in the input, and so keys, are settled
    starts = splitters(rows, shards, *(("size", tolerance) if law == "bytes" else ("_one", 0.0)))
    rows = rows.withColumn("shard", shard_of(starts))

    n = rows.count()
    bits = max(0, (n // (shards * PART_ROWS)).bit_length())
    rows = rows.withColumn("_at", hashed(F.col("_row"))).withColumn("_part", F.shiftright("_at", KEY_BITS - bits))
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    parts = parts.select("shard", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("shard", "_part").orderBy("_at", "_row", "_text", "size")
    out = rows.withColumn("_nth", F.row_number().over(inside)).join(parts, ["shard", "_part"])
    rest = [F.col(f"_rest.`{c}`").alias(c) for c in keep]
    return out.select(*rest, "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_ahead") + F.col("_nth") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options: object) -> None:
    """The documents as one folder for each shard, rows in order of slot within each file."""
    out = sharded(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
