"""Streams give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from mnemo.operators import revise as R
from mnemo.operators import upsert as U
from mnemo.operators import working as W
from mnemo.streaming import jobs as J

SCHEMA = "seq long, key string, session_id string, value string, importance double, created_at double, updated_at double, last_accessed double, access_count int, op_type string, ts timestamp"
DATA = [(i, f"k{i * 7 % 5}", f"s{i % 2}", "abc"[i * 3 % 3 if i % 4 else 1], (i * 37 % 100) / 100, float(i * 600), float(i), float(i), i % 3, "update") for i in range(60)]


@pytest.fixture(scope="module")
def commits(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('commits')}/in"
    df = spark.createDataFrame(DATA, SCHEMA.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_seconds("created_at"))
    for k in range(3):
        df.where(F.floor(F.col("seq") / 20) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def run(spark, df, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_upsert(spark, commits, tmp_path):
    q = J.stream_upsert(read(spark, commits, 10), f"{tmp_path}/store", f"{tmp_path}/log", f"{tmp_path}/cp", 1e6)
    q.awaitTermination(180)
    batch = spark.read.schema(SCHEMA).parquet(commits)
    got = spark.read.parquet(f"{tmp_path}/store/v=0")
    want = U.upsert(batch.limit(0), batch, 1e6)
    assert sorted(map(str, got.select("key", "value").collect())) == sorted(map(str, want.select("key", "value").collect()))
    assert spark.read.parquet(f"{tmp_path}/log").count() == 60


def test_revise(spark, commits, tmp_path):
    got = run(spark, J.stream_revise(read(spark, commits, 10).select("seq", "key", "value", "importance")), tmp_path)
    batch = spark.read.schema(SCHEMA).parquet(commits).withColumn("is_verified", F.lit(False))
    want = R.revise(batch)[1]
    assert sorted(map(tuple, got.select("key", "seq", "decision").collect())) == sorted(map(tuple, want.select("key", "seq", "decision").collect()))


def test_newest_wins_in_any_order(spark, commits, tmp_path):
    got = run(spark, J.stream_newest_wins(read(spark, commits).select("key", "created_at", "seq", "value")), tmp_path, "update")
    last = got.groupBy("key").agg(F.max_by("value", "created_at").alias("value"))
    batch = spark.read.schema(SCHEMA).parquet(commits)
    want = batch.groupBy("key").agg(F.max_by("value", "created_at").alias("value"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_working_memory(spark, commits, tmp_path):
    columns = ["session_id", "seq", "key", "importance", "created_at"]
    got = run(spark, J.stream_working_memory(read(spark, commits, 10).select(columns), 2), tmp_path)
    want = W.replay_working_memory(spark.read.schema(SCHEMA).parquet(commits), 2)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_metrics_and_sessions(spark, commits, tmp_path):
    got = run(spark, J.stream_op_metrics(read(spark, commits, 10), "1 hour", "0 seconds"), tmp_path)
    assert sum(r.n for r in got.collect()) >= 48 and {r.n for r in got.collect()} == {6}
    closed = run(spark, J.stream_sessions(read(spark, commits, 10), "5 minutes", "0 seconds", 1), tmp_path / "s")
    assert all(r.entries == 1 for r in closed.collect()) and closed.count() >= 50


def test_expiry_by_event_time(spark, commits, tmp_path):
    entries = read(spark, commits).select("key", "ts", F.when(F.col("key") == "k0", 60.0).otherwise(1e9).alias("ttl"), F.lit(None).cast("double").alias("invalid_at"))
    assert {r.key for r in run(spark, J.stream_expiry(entries, "0 seconds"), tmp_path).collect()} == {"k0"}


def test_recent_accesses_of_each_key(spark, commits, tmp_path):
    got = run(spark, J.stream_recent(read(spark, commits, 10)), tmp_path).select("key", F.unix_timestamp("at").alias("at"), "n").collect()
    ended = max(r[0] for r in DATA) * 600 - 600  # the watermark
    want = {(r[1], r[0] * 600 + late, 1) for r in DATA for late in range(10, 70, 10) if r[0] * 600 + late <= ended}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_evicted_entries_go_to_the_callback(spark):
    batch = spark.createDataFrame([("s", 1, "a", None, 1), ("s", 2, "b", "a", 1), ("t", 3, "c", "x", 1), ("t", 4, "d", None, 2)], "session_id string, seq long, key string, evicted string, held int")
    got = []
    J.consolidate_with(lambda df: got.extend(df.collect()))(batch, 0)
    assert sorted((r.session_id, r.evicted) for r in got) == [("s", "a"), ("t", "x")]
    J.consolidate_with(lambda df: got.extend(df.collect()))(batch.limit(0), 1)
    assert len(got) == 2
