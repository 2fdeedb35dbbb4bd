"""Embedding whitening from exact integer cross-products.

Vectors become integers.  A task takes the different ones in blocks, shifts
each dimension to begin at zero, and packs every bit of it across the block's
rows into 64-bit words, one row a bit.  The sum of products of two dimensions
is then a weighted sum of popcounts of ANDed planes, and exact.  Tasks hand over
one number for each pair of dimensions; their sums are centred as integers, and
only the centred matrix is made double and decomposed.

What meets on the driver is the matrix of a vector's dimensions: it does not
grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mnemo.sources.durable import durable

#: Rows whose bits are packed together, a multiple of 64.
BLOCK = 8_192
#: Steps of the integer grid in a unit.
GRID = 256
#: Sums are added up in two parts, each of which fits a decimal.
HALF = 1 << 64
#: Eigenvalues up to this share of the trace, for each dimension, are rounding.
NOTHING = 2.0**-50


def on_grid(vector: Column) -> Column:
    """A vector of finite numbers as integers; numbers beyond the range of a long are held at its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit, shift): the bit planes of ``block`` (rows, dimensions), in order of dimension and bit."""
    shift = block.min(0)
    own = block.astype(np.uint64) - shift.astype(np.uint64)
    deep = np.array([int(m).bit_length() for m in own.max(0)])
    words = np.zeros((int(deep.sum()), -(-len(block) // 64) * 8), np.uint8)
    first = np.cumsum(deep) - deep
    for b in range(int(deep.max(initial=0))):
        able = np.flatnonzero(deep > b)
        bits = np.packbits(((own[:, able] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        words[first[able] + b, : bits.shape[1]] = bits
    dimension = np.repeat(np.arange(len(deep)), deep)
    return words.view(np.uint64), dimension, np.arange(len(dimension)) - first[dimension], shift


def products(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the dimensions of ``block``, as Python's integers."""
    words, dimension, bit, shift = planes(block)
    wide, n = block.shape[1], len(block)
    shift = shift.astype(object)
    sums = np.zeros(wide, object)
    cross = np.zeros((wide, wide), object)
    if len(words):
        kind = np.int64 if 2 * int(bit.max()) + 2 + n.bit_length() < 62 else object
        weight = np.array([1 << int(b) for b in bit], kind)
        starts = np.flatnonzero(np.diff(dimension, prepend=-1))
        there = dimension[starts]
        sums[there] = np.add.reduceat(np.bitwise_count(words).sum(1, dtype=np.int64).astype(kind) * weight, starts).astype(object)
        counts = np.zeros((len(words), len(words)), np.int64)
        for k in range(len(words)):
            counts[k, k:] = np.bitwise_count(words[k] & words[k:]).sum(1, dtype=np.int64)
        counts += np.triu(counts, 1).T
        weighted = np.add.reduceat(counts.astype(kind) * weight, starts, axis=1)
        cross[np.ix_(there, there)] = np.add.reduceat(weighted * weight[:, None], starts, axis=0).astype(object)
    moved = shift[:, None] * sums[None, :]
    return sums + n * shift, cross + moved + moved.T + n * shift[:, None] * shift[None, :]


def _scatter(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
        held: list[np.ndarray] = []

        def add(rows: np.ndarray) -> None:
            nonlocal n, sums, cross
            s, c = products(rows)
            n, sums, cross = n + len(rows), sums + s, cross + c

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, wide))
            if sum(map(len, held)) >= BLOCK:
                rows = np.concatenate(held)
                whole = len(rows) // BLOCK * BLOCK
                for k in range(0, whole, BLOCK):
                    add(rows[k : k + BLOCK])
                held = [rows[whole:]]
        if held and sum(map(len, held)):
            add(np.concatenate(held))
        if not n:
            return
        i, j = np.triu_indices(wide)
        rows = [(-1, -1, n), *((-1, k, s) for k, s in enumerate(sums)), *zip(i.tolist(), j.tolist(), cross[i, j], strict=True)]
        a, b, v = zip(*rows, strict=True)
        high, low = (pa.array([Decimal(x) for x in part], pa.decimal128(38, 0)) for part in zip(*(divmod(int(x), HALF) for x in v), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), high, low], ["i", "j", "high", "low"])

    return run


@dataclass
class Fit:
    """Number and sums of the fit list, its ``components`` (dimension, component) and all eigenvalues, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def explained(self, k: int) -> float | None:
        return float(self.values[k]) / self.trace if self.trace > 0 else None


def fit(vectors: DataFrame, wide: int) -> Fit:
    """``vectors`` has one column, an array of ``wide`` integers without nulls; each row counts once."""
    tasks = vectors.mapInArrow(_scatter(wide), "i int, j int, high decimal(38,0), low decimal(38,0)")
    n, sums, cross = 0, [0] * wide, np.zeros((wide, wide), object)
    for i, j, high, low in tasks.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect():  # as many rows as pairs of dimensions
        v = int(high) * HALF + int(low)
        if i >= 0:
            cross[i, j] = cross[j, i] = v
        elif j >= 0:
            sums[j] = v
        else:
            n = v
    s = np.array(sums, object)
    centred = n * cross - s[:, None] * s[None, :]
    square = max(1, n * n)
    v = np.array([[int(x) / square for x in row] for row in centred], np.float64).reshape(wide, wide)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1], components[:, ::-1]
    largest = components[np.abs(components).argmax(0), np.arange(wide)] if wide else np.empty(0)
    trace = sum(int(x) for x in np.diag(centred)) / square
    values = np.where(values > NOTHING * wide * trace, values, 0.0)
    return Fit(n, sums, values, components * np.where(largest < 0, -1.0, 1.0), trace)


def projected(x: Column, f: Fit, most: int) -> Column:
    """(deviation, whitened) of a vector of integers: null where it exceeds a long, or where a component has no variance."""
    n, sums = f.n, f.sums
    onto = np.array([f.components[:, k] / np.sqrt(f.values[k]) if f.values[k] > 0 else np.full(len(sums), np.nan) for k in range(most)]).reshape(most, len(sums))

    @pandas_udf("deviation long, whitened array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = np.array(sums, object)
        top = max((abs(v) for v in sums), default=0)
        for xs in batches:
            rows = np.array(xs.tolist(), np.int64).reshape(len(xs), len(sums))
            least, largest = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
            far = n * max(abs(least), abs(largest)) + top
            exact = len(sums) * far * far < 1 << 63
            away = rows * np.int64(n) - s.astype(np.int64) if exact else rows.astype(object) * n - s
            deviation = [int(v) for v in (away * away).sum(1)]
            white = (away.astype(np.float64) / n) @ onto.T
            told = [[None if np.isnan(v) else float(v) for v in row] for row in white]
            yield pd.DataFrame({"deviation": pd.array([v if v < 1 << 63 else None for v in deviation], "Int64"), "whitened": told})

    return run(x)


def whiten(vectors: DataFrame, embedding: str = "embedding", most: int = 4) -> DataFrame:
    """Rows of ``vectors`` for each of the first ``most`` components: component, n, deviation, whitened, explained, identity_error beside ``vec_id``.

    Rows without a vector, or with a null or non-finite entry, are dropped, and
    so are vectors of another length than the most frequent one (the longest of
    several).  The model is fitted on the different vectors of integers, each
    once; repeated rows come back as often as they came.  Fewer dimensions give
    fewer components.  A component without variance (all vectors equal) has null
    ``whitened``; an empty table gives an empty one.  Further columns do not
    come back.
    """
    rows = vectors.select("vec_id", F.col(embedding).alias("v")).where(usable(F.col("v")))
    rows = rows.select("vec_id", on_grid(F.col("v")).alias("x"))
    length = rows.groupBy(F.size("x").alias("wide")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("wide")).first()
    wide = length["wide"] if length else 0
    rows = rows.where(F.size("x") == wide)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not wide:
        return rows.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {kinds}")
    different = durable(rows.select("x").distinct())
    f = fit(different, wide)
    most = min(most, wide)
    told = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(f.explained(k)).cast("double").alias("explained")) for k in range(most)])
    error = F.lit(identity_error(different.select(projected(F.col("x"), f, most)["whitened"].alias("w")), f, most)).cast("double")
    out = rows.select("vec_id", projected(F.col("x"), f, most).alias("p"), told.alias("told"))
    out = out.select("vec_id", "p.deviation", F.explode(F.arrays_zip("told", F.col("p.whitened").alias("whitened"))).alias("c"))
    return out.select("vec_id", F.col("c.told.component").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "c.whitened", F.col("c.told.explained").alias("explained"), error.alias("identity_error"))


def identity_error(white: DataFrame, f: Fit, most: int) -> float | None:
    """Largest absolute entry of the covariance of ``white`` (w) less the identity, over the components that have variance."""
    live = [k for k in range(most) if f.values[k] > 0]
    pairs = [(a, b) for a in live for b in live if a <= b]
    if not pairs:
        return None
    of = lambda k: F.get("w", F.lit(k))
    found = white.agg(*[F.covar_pop(of(a), of(b)) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for (a, b), c in zip(pairs, found, strict=True))
