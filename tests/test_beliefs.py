import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import agents as A
from mnemo.operators import revise as R

SCHEMA = "seq long, key string, value string, importance double, created_at double, is_verified boolean"


def walk(rows, strategy):
    held, out = {}, []
    for seq, key, value, importance, at, verified in sorted(rows):
        own = max(0.0, min(1.0, importance))
        old = held.get(key)
        if old is None:
            held[key], decision = (value, importance, at, verified, own), "new"
        elif old[0] == value:
            decision = "same"
        else:
            more = importance >= old[1]
            ok = {"entrenchment": importance >= old[4], "recency": at >= old[2], "importance": more, "verification": verified if verified != old[3] else more}[strategy]
            decision = "accepted" if ok else "rejected"
            if ok:
                held[key] = (value, importance, at, verified, max(old[4], own))
        out.append((key, seq, decision))
    return sorted(out)


@pytest.mark.parametrize("strategy", R.STRATEGIES)
def test_replay_is_a_walk_in_any_partitioning(spark, strategy):
    rng = random.Random(3)
    data = [(i, f"k{rng.randrange(5)}", rng.choice("abc"), round(rng.random() * 1.4 - 0.2, 2), float(rng.randrange(50)), rng.random() < 0.4) for i in range(200)]
    want = walk(data, strategy)
    for n in (1, 7):
        rng.shuffle(data)
        got = R.revise(spark.createDataFrame(data, SCHEMA).repartition(n), strategy)[1]
        assert sorted(map(tuple, got.select("key", "seq", "decision").collect())) == want


def test_best_candidate_wins(spark):
    df = spark.createDataFrame([(1, "db", "localhost", 0.2, 1.0, False), (2, "db", "staging", 0.5, 2.0, False), (3, "db", "prod", 0.9, 3.0, False)], SCHEMA)
    out = R.resolve_candidates(df, "entrenchment").where("winner").first()
    assert (out.value, out.conflicts_resolved) == ("prod", 2)
    old = df.withColumn("created_at", -F.col("created_at"))
    assert R.resolve_candidates(old, "recency").where("winner").first().value == "localhost"


def test_expand_and_contract(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.5, 1.0, False), (2, "a", "x", 0.5, 2.0, False), (3, "a", "y", 0.7, 3.0, False)], SCHEMA)
    last, marked = R.expand(df)
    assert last.first().value == "y" and [r.conflict for r in marked.orderBy("seq").collect()] == [False, False, True]
    left, log = R.contract(R.load_beliefs(last), last.select("key"))
    assert left.isEmpty() and log.first().entrenchment == 0.7


BELIEFS = [("alice", "db", "postgres", 1.0, 1), ("bob", "db", "postgres", 2.0, 2), ("carol", "db", "mysql", 3.0, 3), ("alice", "os", "linux", 1.0, 4), ("bob", "os", "bsd", 1.0, 5)]
TRUST = [("alice", 0.9), ("bob", 0.7), ("carol", 0.5)]


def test_agents(spark):
    beliefs = spark.createDataFrame(BELIEFS, "agent_id string, key string, value string, created_at double, seq long")
    trust = spark.createDataFrame(TRUST, "agent_id string, reliability double")
    assert {(r.key, r.value) for r in A.consensus(beliefs, trust).collect()} == {("db", "postgres"), ("os", "linux")}
    merged = A.merge(beliefs, trust, spark.createDataFrame([("alice", "carol")], "a string, b string"))
    assert {(r.key, r.value, r.conflict, r.copied) for r in merged.collect()} == {("db", "postgres", True, False), ("os", "linux", False, True)}
    pulled = A.pull(beliefs, spark.createDataFrame([("alice",)], "agent_id string"))
    assert {(r.key, r.value) for r in pulled.collect()} == {("db", "mysql")}
    newer = spark.createDataFrame([("bob", "db", "sqlite", 2.0, 9), ("bob", "os", "plan9", 4.0, 10)], beliefs.schema)
    assert {(r.key, r.value) for r in A.push(beliefs, newer).where("agent_id = 'bob'").collect()} == {("db", "postgres"), ("os", "plan9")}
    diverged = A.divergence(beliefs.where("agent_id = 'alice'"), beliefs.where("agent_id = 'carol'"))
    assert {(r.key, r.status) for r in diverged.collect()} == {("db", "conflict"), ("os", "missing_in_b")}


def test_vector_clocks(spark):
    clocks = spark.createDataFrame([({"a": 1}, {"a": 2}), ({"a": 2}, {"b": 1}), ({}, {}), ({"a": 2, "b": 1}, {"a": 1})], "x map<string,bigint>, y map<string,bigint>")
    assert [r[0] for r in clocks.select(A.vclock_compare(F.col("x"), F.col("y"))).collect()] == ["before", "concurrent", "equal", "after"]
    assert clocks.select(A.vclock_merge(F.col("x"), F.col("y"))).collect()[3][0] == {"a": 2, "b": 1}
