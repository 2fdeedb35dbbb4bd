"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many rows may be broadcast whole (their rows are short).
BROADCAST_ROWS = 300_000
#: Keys with more rows than this are joined by broadcast, where there are few enough of them.
HOT_ROWS = 1_000

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all tasks, before rows are multiplied."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_counted(rows: DataFrame, table: DataFrame, key: str, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and in ``n`` how many of ``rows`` have it.

    A small ``table`` is broadcast.  Of a larger one the hot keys are, which no
    task then has to hold alone, and the others are joined by shuffle.  Keys
    are not null and each is in ``table``.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table.drop("n")), key)
    while (many := table.where(F.col("n") > hot).count()) > BROADCAST_ROWS:
        hot *= 8
    if not many:
        return rows.join(table.drop("n"), key)
    often = F.broadcast(table.where(F.col("n") > hot).drop("n"))
    seldom = table.where(F.col("n") <= hot).drop("n")
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))
