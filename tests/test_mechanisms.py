"""Interval joins, combinable folds, appended chains, the bucketed store, ranks and percentiles without one task."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import log as L
from mnemo.operators import order as O
from mnemo.operators import predicates as P
from mnemo.operators import scores as C
from mnemo.operators import upsert as U
from mnemo.operators import working as W
from mnemo.plans import fixtures as T
from mnemo.sources.durable import written
from mnemo.streaming import store as B

LOG = "id long, op_type string, key string, micros long, before string, after string, chain_id string"


def made_log(n, seed=1, keys=12, span=10**6):
    rng = random.Random(seed)
    return [(i, rng.choice(("create", "update", "update", "delete", "snapshot")), f"k{rng.randrange(keys)}", rng.randrange(span), None, rng.choice(('"1"', '"2"', None)), f"c{rng.randrange(3)}") for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().toString()


# many times


@pytest.mark.parametrize("n_times,span", [(1, 10**6), (7, 10**6), (300, 10**6), (300, 310), (50, 10**12)])
def test_states_at_many_times(spark, n_times, span):
    rng = random.Random(n_times)
    log = made_log(400, span=span)
    times = sorted({rng.randrange(-span // 10, span + span // 10) for _ in range(n_times)})
    df = spark.createDataFrame(log, LOG)
    got = {tuple(r) for r in L.states_at(df, spark.createDataFrame([(t,) for t in times] * 2 + [(None,)], "micros long")).collect()}
    want = set()
    for t in times:
        last = {}
        for i, op, key, at, _, after, _ in log:
            if op != "snapshot" and at <= t:
                last[key] = (op, after)
        want |= {(t, k, after) for k, (op, after) in last.items() if op != "delete"}
    assert got == want


def test_states_at_without_times_or_changes(spark):
    df, none = spark.createDataFrame(made_log(20), LOG), spark.createDataFrame([], "micros long")
    assert L.states_at(df, none).count() == 0
    assert L.states_at(df.limit(0), spark.createDataFrame([(5,)], "micros long")).count() == 0


def test_ten_million_times_make_no_nested_loop(spark):
    times = spark.range(10_000_000).selectExpr("id * 3 AS micros")
    found = L.states_at(spark.createDataFrame(made_log(50, span=3 * 10**7), LOG), times)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_blocks_cover_exactly(spark):
    cases = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)]
    df = spark.createDataFrame(cases, "a long, b long")
    for levels in (0, 3, 5):
        for r in df.select("a", "b", L.blocks(F.col("a"), F.col("b"), levels).alias("x")).collect():
            inside = sorted(p for x in r.x for p in range(x.block << x.level, (x.block + 1) << x.level))
            assert inside == list(range(r.a, r.b)) and len(r.x) <= 2 * levels + max(0, (r.b - r.a) >> levels)


# heat


def walked(rows):
    out = {}
    for key, at, _, importance in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        h, t = out.get(key, (0.0, at))
        h = h * W.COOLING ** ((at - t) / 3600)
        out[key] = (max(0.0, min(1.0, h + W.GAIN * max(0.1, importance if importance is not None else 0.1))), at)
    return out


def test_heat_is_that_of_a_walk(spark):
    rng = random.Random(2)
    rows = [(f"k{int(rng.expovariate(0.4))}", float(rng.randrange(10**6)), i, rng.choice((None, rng.random(), rng.random() * 4))) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, created_at double, seq long, importance double")
    for parts, batch in ((1, 10_000), (7, 10_000), (5, 13)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.key: (r.heat, r["at"]) for r in W.heat(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = walked(rows)
        assert got.keys() == want.keys() and all(abs(got[k][0] - h) < 1e-9 and got[k][1] == t for k, (h, t) in want.items())
    assert W.heat(df.limit(0)).count() == 0


def test_heat_of_one_key_with_a_million_accesses(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'k' AS key", "CAST(id * 40 AS DOUBLE) AS created_at", "id AS seq", "(id % 11) / 100D AS importance")
    h, t = 0.0, 0.0
    for i in range(n):
        h = min(1.0, h * W.COOLING ** ((i * 40 - t) / 3600) + W.GAIN * max(0.1, (i % 11) / 100))
        t = i * 40
    r = W.heat(df).first()
    assert abs(r.heat - h) < 1e-9 and r["at"] == t


def test_hot_sessions_has_rows(spark):
    rows = [(f"s{s}", f"k{s}{i}", 0.9 if s < 2 and i == 0 else 0.1) for s in range(4) for i in range(8 - s)]
    got = W.hot_sessions(spark.createDataFrame(rows, "session_id string, key string, heat double")).collect()
    assert {(r.session_id, r.usage, r.hot) for r in got} == {("s0", 1.0, 1), ("s1", 0.875, 1)}


# chains


def test_appended_chains_equal_one_build(spark, tmp_path):
    log = spark.createDataFrame(made_log(90), LOG)
    path = f"{tmp_path}/chain"
    for b, (low, high) in enumerate([(0, 30), (20, 60), (60, 60), (60, 90)]):  # the second one repeats rows, the third has none
        for _ in range(2):
            L.append_chain(log.where(f"id >= {low} and id < {high}"), path, b)
    got, want = L.stored_chain(spark, path), L.build_chain(log)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert all(r.valid for r in L.verify_chain(got).collect())
    heads = spark.read.parquet(f"{path}/heads/batch=3")
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, L.chain_heads(want).collect()))


def test_an_append_that_was_cut_short_is_made_anew(spark, tmp_path):
    log = spark.createDataFrame(made_log(60), LOG)
    path = f"{tmp_path}/chain"
    L.append_chain(log.where("id < 30"), path, 0)
    L.append_chain(log.where("id >= 30 and id < 40"), path, 1)
    os.remove(f"{path}/heads/batch=1/_SUCCESS")  # rows are there, heads are not whole
    assert written(spark, f"{path}/heads") == [0] and L.stored_chain(spark, path).count() == 30
    L.append_chain(log.where("id >= 30"), path, 1)
    assert sorted(r.root_hash for r in L.stored_chain(spark, path).collect()) == sorted(r.root_hash for r in L.build_chain(log).collect())


# the bucketed store

COMMIT = "seq long, key string, session_id string, value string, importance double, created_at double, updated_at double, last_accessed double, access_count int"


def commits(spark, low, high, keys=30):
    return spark.createDataFrame([(i, f"k{i * 7 % keys}", f"s{i % 2}", f"v{i}", 0.5, float(i), float(i), float(i), 0) for i in range(low, high)], COMMIT)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store, log = f"{tmp_path}/store", f"{tmp_path}/log"
    write = B.bucketed_writer(store, log, 1e6, 16)
    write(commits(spark, 0, 200), 0)
    few = commits(spark, 200, 202)
    write(few, 1)
    touched = {r[0] for r in few.select(B.bucket("key", 16)).distinct().collect()}
    held = B.manifest(spark, store)
    assert {k for k, b in held.items() if b == 1} == touched and len(touched) <= 2 < len(held)
    assert {d for d in os.listdir(f"{store}/data/batch=1") if d.startswith("bucket")} == {f"bucket={k}" for k in touched}
    want = U.upsert(U.upsert(few.limit(0), commits(spark, 0, 200), 1e6), few, 1e6)
    assert rows_of(B.current(spark, store)) == rows_of(want)
    one = B.lookup(spark, store, ["k3"], 16)
    assert [r.key for r in one.collect()] == ["k3"] and len(one.inputFiles()) < len(B.current(spark, store).inputFiles())


@pytest.mark.parametrize("step", ["data", "log", "manifest"])
def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path, step):
    """The batch is run again whole, or after a stop behind ``step`` before its manifest."""
    store, log = f"{tmp_path}/store", f"{tmp_path}/log"
    write = B.bucketed_writer(store, log, 1e6, 8)
    write(commits(spark, 0, 40), 0)
    write(commits(spark, 30, 60), 3)
    want, told = rows_of(B.current(spark, store)), rows_of(spark.read.parquet(f"{log}/batch=3"))
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    gone = {"data": [f"{store}/manifest/batch=3", f"{log}/batch=3"], "log": [f"{store}/manifest/batch=3"], "manifest": []}[step]
    for p in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
    if gone:
        assert rows_of(B.current(spark, store)) != want  # readers still see the batch before
    write(commits(spark, 30, 60), 3)
    assert rows_of(B.current(spark, store)) == want and rows_of(spark.read.parquet(f"{log}/batch=3")) == told
    write(commits(spark, 60, 61), 4)
    assert written(spark, f"{store}/manifest") == [0, 3, 4]
    whole = rows_of(B.current(spark, store))
    B.vacuum(spark, store, 1)
    assert rows_of(B.current(spark, store)) == whole and written(spark, f"{store}/manifest") == [4]


def test_stream_into_the_bucketed_store(spark, tmp_path):
    for k in range(3):
        commits(spark, 20 * k, 20 * k + 20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        q = B.stream_upsert(spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/log", f"{tmp_path}/cp", 1e6, 8)
        q.awaitTermination(180)
        assert q.exception() is None
    want = commits(spark, 0, 60).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))
    got = B.current(spark, f"{tmp_path}/store")
    assert sorted(map(tuple, got.select("key", "value", F.col("access_count").cast("long")).collect())) == sorted(map(tuple, want.collect()))


# order


def test_ranks_and_sums_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice((None, *range(6))), rng.randrange(100), "mine") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, x int, v long, rank string")
    order = [F.col("x").asc_nulls_last(), F.desc("i")]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    ranked = O.global_rank(df, order)
    assert {r.i: r["rank"] for r in ranked.collect()} == {r[0]: k for k, r in enumerate(want, 1)}
    total, sums = 0, {}
    for r in want:
        total += r[2]
        sums[r[0]] = total
    assert {r.i: r.until for r in O.running_sum(df, order, "v").collect()} == sums
    assert O.global_rank(df.limit(0), order).count() == 0 == O.running_sum(df.limit(0), order, "v").count()


def test_canonical_order_over_all_rows_is_no_single_task(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    m = T.memories(spark, sf).withColumns({"canonical": F.col("k") % 9 == 0, "priority": F.lit("high")})
    got = P.canonical_order(m, T.NOW)
    assert "SinglePartition" not in plan(got).split("== Physical Plan ==")[1].split("Window")[0]
    one = P.canonical_order(m.withColumn("one", F.lit(1)), T.NOW, ["one"])
    assert sorted(map(tuple, got.select("key", "rank").collect())) == sorted(map(tuple, one.select("key", "rank").collect()))


def test_percentiles_by_selection(spark):
    rng = random.Random(6)
    rows = [(op, rng.choice((1.5, 2.5, rng.random()))) for op in ("a", "a", "a", "b", "c") for _ in range(rng.randrange(1, 400))] + [(None, 3.0), (None, 1.0)]
    got = {r.operation: (r.n, r.p50, r.p95) for r in C.latency_summary(spark.createDataFrame(rows, "operation string, elapsed_ms double")).collect()}
    want = {}
    for op in {r[0] for r in rows}:
        v = sorted(x for o, x in rows if o == op)
        want[op] = (len(v), v[min(len(v) - 1, math.floor(len(v) * 0.5))], v[min(len(v) - 1, math.floor(len(v) * 0.95))])
    assert got == want
