"""Reasons of checks, rollback logs, heat in the working set, metadata edges, strategies and watermarks in streams."""

import json

import pytest
from pyspark.sql import functions as F

from mnemo.operators import graph as H
from mnemo.operators import log as L
from mnemo.operators import predicates as P
from mnemo.operators import revise as R
from mnemo.operators import search as I
from mnemo.operators import working as W
from mnemo.streaming import jobs as J

LOG = "id long, op_type string, key string, micros long, before string, after string, chain_id string"


def test_rollback_needs_objects_and_is_logged(spark):
    whole, bare = '{"memory_type": "semantic"}', '{"a": 1}'
    log = spark.createDataFrame([(1, "create", "a", 10, None, whole, "x"), (2, "update", "a", 20, whole, bare, "x"), (3, "create", "b", 20, None, "[1]", "x")], LOG)
    assert not L.rejects_rollback(log, 10, ("memory_type",))
    assert L.rejects_rollback(log, 20, ("memory_type",)) and not L.rejects_rollback(log, 20)
    plan = L.rollback(L.state_at(log, 20), log, 10)
    rows = {r.key: r for r in L.rollback_log(plan, 10, 30).collect()}
    assert (rows["a"].op_type, rows["a"].before, rows["a"].after) == ("update", bare, whole)
    assert (rows["b"].op_type, rows["b"].after) == ("delete", None)
    assert json.loads(rows["__system"].after) == {"created": 0, "updated": 1, "deleted": 1} and json.loads(rows["__system"].before) == {"target_micros": 10}


def test_forged_first_row_leaves_the_genesis_root(spark):
    log = spark.createDataFrame([(1, "create", "a", 10, None, "1", "x"), (2, "update", "a", 20, "1", "2", "x")], LOG)
    chained = L.build_chain(log)
    forged = L.verify_chain(chained.withColumn("after", F.when(F.col("id") == 1, "9").otherwise(F.col("after")))).first()
    assert (forged.current_root, forged.root_mismatch, forged.first_error) == (L.GENESIS, True, 1)
    fine = L.verify_chain(chained).first()
    assert (fine.current_root, fine.root_mismatch) == (fine.stored_root, False)


def test_gate_follows_conflict_marks(spark):
    schema = "key string, value string, created_at double, ttl double, invalid_at double, current_strength double, verification_score double, conflicts_with string"
    rows = [("a", "1", 0.0, None, None, 1.0, 0.9, "b"), ("b", "2", 0.0, None, None, 1.0, 0.9, "none"), ("c", "3", 0.0, None, None, 1.0, 0.9, None), ("d", "4", 0.0, None, None, 1.0, 0.1, "d")]
    beliefs = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "key string, value string")
    got = {r.key: (r.status, r.reason) for r in P.verification_gate(spark.createDataFrame(rows, schema), beliefs, 10.0).collect()}
    assert got == {"a": ("CONFLICT", "conflicts with b"), "b": ("CONFLICT", "conflicts with b"), "c": ("PASS", None), "d": ("CONFLICT", "conflicts with d")}


def test_transition_names_lost_keys_before_rules(spark):
    schema = "g string, key string, value string, memory_type string, importance double, current_strength double, verification_score double, is_verified boolean"
    row = lambda g, k, ok, v='"x"': (g, k, v, "semantic", 0.5, 1.0, 0.5, ok)
    before = spark.createDataFrame([row("p", "a", True), row("q", "a", False), row("r", "a", True)], schema)
    after = spark.createDataFrame([row("p", "a", False, "{bad"), row("q", "a", False, "{bad"), row("r", "a", True)], schema)
    got = {r.g: (r.valid, r.lost, r.failed_rules) for r in P.transition_report(before, after, "g").collect()}
    assert got == {"p": (False, 1, []), "q": (False, 0, ["TYPE_SAFETY"]), "r": (True, 0, [])}


def plain_replay(events, slots):
    held, out = {}, []
    for session, seq, key, importance, at, heat, used in events:
        warm = {k: min(1.0, h * 0.95 ** (max(0.0, at - since) / 3600)) for k, (_, _, h, since) in held.items()}
        gone = None
        if used:
            if key in held:
                own = held[key][0]
                held[key] = (own, at, min(1.0, warm[key] + 0.2 * max(0.1, own)), at)
        else:
            if key not in held and len(held) >= slots:
                worth = {k: held[k][0] / max(1.0, at - held[k][1]) + 0.25 * warm[k] for k in held}
                gone = min(worth, key=lambda k: (worth[k], k))
                held.pop(gone)
            held[key] = (importance, at, heat, at)
        out.append((session, seq, key, gone, len(held)))
    return out


EVENTS = [("s", i, f"k{i * 5 % 7}", (i * 37 % 11) / 10, 900.0 * i, (i % 3) / 4, i % 4 == 1) for i in range(60)]
EVENT = "session_id string, seq long, key string, importance double, created_at double, heat double, used boolean"


def test_heat_decides_who_leaves(spark):
    want = plain_replay(EVENTS, 3)
    assert [tuple(r) for r in W.replay_working_memory(spark.createDataFrame(EVENTS, EVENT), 3).orderBy("seq").collect()] == want
    cold = plain_replay([(*e[:5], 0.0, False) for e in EVENTS], 3)
    assert [r[3] for r in want] != [r[3] for r in cold]


def run(spark, df, tmp_path, mode):
    name = f"checks_{abs(hash(str(tmp_path))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def stream(spark, df, path, parts):
    for k in range(parts):
        df.where(F.floor(F.col("seq") * parts / 60) == k).coalesce(1).write.mode("append").parquet(path)
    files = sorted((r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()))
    assert len(files) == parts
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_heat_outlives_batches(spark, tmp_path):
    got = run(spark, J.stream_working_memory(stream(spark, spark.createDataFrame(EVENTS, EVENT), f"{tmp_path}/in", 3), 3), tmp_path, "append")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_replay(EVENTS, 3)))


@pytest.mark.parametrize("strategy", R.STRATEGIES)
def test_streamed_revision_by_each_strategy(spark, tmp_path, strategy):
    rows = [(f"k{i % 4}", i, "abc"[i * 7 % 3], None if i % 13 == 0 else (i * 37 % 100) / 100, float(i * 7 % 20), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq long, value string, importance double, created_at double, is_verified boolean")
    got = run(spark, J.stream_revise(stream(spark, df, f"{tmp_path}/in", 3), strategy), tmp_path, "append")
    want = R.revise(df, strategy)[1]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select("key", "seq", "decision").collect())


def test_newest_wins_behind_a_watermark(spark, tmp_path):
    rows = [(f"k{i // 10}", float(i if i % 10 else i + 5), i, f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, created_at double, seq long, value string").withColumn("ts", F.timestamp_seconds("created_at"))
    got = run(spark, J.stream_newest_wins(stream(spark, df, f"{tmp_path}/in", 3), "10 minutes"), tmp_path, "update")
    last = got.groupBy("key").agg(F.max_by("value", "created_at").alias("value"), F.max("stale").alias("stale"))
    assert {r.key: r.value for r in last.collect()} == {f"k{k}": f"v{k * 10 + 9}" for k in range(6)}
    assert all(0 < r.stale < 10 for r in last.collect())


def test_metadata_names_edges(spark):
    meta = ['{"relations": [["causes", "b"], {"target": "c", "strength": 0.9}, {"target": "", "type": "x"}, 7, ["one"], {"target": "z", "strength": 0}]}', '{"relations": "no list"}', "{bad", None]
    m = spark.createDataFrame([(f"m{i}", x) for i, x in enumerate(meta)], "key string, metadata string")
    assert sorted(tuple(r) for r in H.metadata_edges(m).collect()) == [("m0", "b", "causes", 0.5, 0), ("m0", "c", "related_to", 0.9, 1)]
    edges = spark.createDataFrame([("m0", "d", "supports", 0.4, 1)], "source string, target string, relation_type string, weight double, edge_seq long")
    assert [r.target for r in H.with_metadata_edges(edges, m).orderBy("edge_seq").collect()] == ["d", "b", "c"]


def test_a_callers_reranker_is_used(spark):
    df = spark.createDataFrame([(1, "a", "q", "long text", 0.0), (1, "b", "q", "q", 0.0)], "query_id long, key string, query string, value string, score double")
    assert I.rerank_overlap(df).orderBy("rank").first().key == "b"
    assert I.rerank_overlap(df, lambda q, v: F.length(v) / 10).orderBy("rank").first().key == "a"
