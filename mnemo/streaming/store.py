"""A store in buckets of keys, of which a batch rewrites only those it touches.

``data/batch=B/bucket=K`` holds bucket K as of batch B.  ``manifest/batch=B``
says, with a row for each bucket, which batch holds it; it is written last and
counts once Spark has marked it as done.  So a reader always sees whole batches;
a batch that is run again after its manifest changes nothing, and one that was
cut short before it, be it between store and log, is written over from the same
state as the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.upsert import commit_log, upsert
from mnemo.sources.durable import durable, written

BUCKETS = 64


def manifest(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """bucket -> batch that holds it, as of the newest batch (below ``before``); a row for each bucket."""
    done = [b for b in written(spark, f"{store}/manifest") if before is None or b < before]
    return {r["bucket"]: r["held_by"] for r in spark.read.parquet(f"{store}/manifest/batch={done[-1]}").collect()} if done else {}


def read_buckets(spark: SparkSession, store: str, held: dict[int, int]) -> DataFrame | None:
    paths = [f"{store}/data/batch={b}/bucket={k}" for k, b in sorted(held.items())]
    return spark.read.option("basePath", f"{store}/data").parquet(*paths).drop("batch", "bucket") if paths else None


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The store after its newest whole batch; None before the first."""
    return read_buckets(spark, store, manifest(spark, store))


def lookup(spark: SparkSession, store: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """Rows of a few keys; only their buckets are read."""
    asked = spark.createDataFrame([(k,) for k in keys], "key string").select("key", bucket("key", buckets).alias("bucket"))
    there = {r["bucket"] for r in asked.collect()}
    found = read_buckets(spark, store, {k: b for k, b in manifest(spark, store).items() if k in there})
    return found.where(F.col("key").isin(keys)) if found is not None else None


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucketed_writer(store: str, log: str, now: float, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch into the buckets of its keys and appends its log rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in written(spark, f"{store}/manifest"):
            return
        rows = durable(batch)
        keyed = rows.withColumn("bucket", bucket("key", buckets))
        touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most all buckets
        held = manifest(spark, store, batch_id)
        old = read_buckets(spark, store, {k: held[k] for k in touched if k in held})
        old = rows.limit(0) if old is None else old
        new = upsert(old, rows, now).withColumn("bucket", bucket("key", buckets))
        new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/batch={batch_id}")
        commit_log(old, rows).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        said = list((held | dict.fromkeys(touched, batch_id)).items())
        spark.createDataFrame(said, "bucket int, held_by long").coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/batch={batch_id}")

    return write


def stream_upsert(commits: DataFrame, store: str, log: str, checkpoint: str, now: float, buckets: int = BUCKETS):
    """A query that keeps the bucketed ``store`` and ``log`` up to date."""
    return commits.writeStream.foreachBatch(bucketed_writer(store, log, now, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> list[int]:
    """Removes the data that none of the last ``keep`` manifests names, and the manifests before them; returns the batches whose data went."""
    done = written(spark, f"{store}/manifest")
    needed = {b for m in done[-keep:] for b in manifest(spark, store, m + 1).values()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [b for b in written(spark, f"{store}/data") if b not in needed and done and b <= done[-1]]
    for b in gone:
        fs.delete(path(f"{store}/data/batch={b}"), True)
    for m in done[:-keep]:
        fs.delete(path(f"{store}/manifest/batch={m}"), True)
    return gone
