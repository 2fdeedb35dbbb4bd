"""Streams with named state give what their batch twins give, and go on after a restart."""

import pytest
from pyspark.sql import functions as F

from mnemo.operators import log as L
from mnemo.operators import revise as R
from mnemo.streaming import stateful as S

LOG = "id long, op_type string, key string, micros long, before string, after string, chain_id string"
COMMIT = "seq long, key string, session_id string, value string, importance double, created_at double, is_verified boolean"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    S.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def log(spark, low, high):
    return spark.createDataFrame([(i, "update", f"k{i % 4}", i * 10, None, str(i), f"c{i % 3}") for i in range(low, high)], LOG)


def commits(spark, low, high):
    return spark.createDataFrame([(i, f"k{i * 7 % 5}", f"s{i % 2}", "abc"[i * 3 % 3 if i % 4 else 1], (i * 37 % 100) / 100, float(i * 600), i % 3 == 0) for i in range(low, high)], COMMIT)


def run(spark, df, tmp_path, mode="append"):
    """One run to the end of what is there; rows go to files, so later runs add to them."""
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def test_a_restarted_chain_has_no_gap(spark, tmp_path):
    read = lambda: S.stream_chain(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for low, high in ((0, 20), (15, 40), (40, 70)):  # five rows come twice
        log(spark, low, high).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, read(), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = L.build_chain(log(spark, 0, 70)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_revisions_over_restarts(spark, tmp_path):
    for low, high in ((0, 25), (25, 60)):
        commits(spark, low, high).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, S.stream_revise(spark.readStream.schema(COMMIT).parquet(f"{tmp_path}/in")), tmp_path)
    want = R.revise(commits(spark, 0, 60))[1].select("key", "seq", "decision")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("key", "seq", "decision").collect())) == sorted(map(tuple, want.collect()))
