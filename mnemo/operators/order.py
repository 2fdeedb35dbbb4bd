"""Order over all rows without one task that holds them: ranks and running sums by range partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.sources.durable import durable

#: ``monotonically_increasing_id`` is a partition's number above these bits, and a row's place in it below.
PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in order over all tasks and written so, with ``_range`` (ascending) and ``_place`` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(rows.select("*", F.shiftright("_id", PLACE_BITS).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place")).drop("_id"))


def before_ranges(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(_range, name): the sum of ``value`` over all earlier ranges; one row for each task."""
    sums = rows.groupBy("_range").agg(F.sum(value).alias("v"))
    return sums.select("_range", F.coalesce(F.sum("v").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's number from 1 in ``order``; ties are numbered in any order. ``order`` should end in a key."""
    rows = in_ranges(df, order)
    ahead = before_ranges(rows, F.lit(1), "_ahead")
    return rows.join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_ahead") + F.col("_place") + 1).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "until") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each in ``order``, itself included."""
    rows = in_ranges(df, order)
    ahead = before_ranges(rows, F.col(value), "_ahead")
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_inside")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
