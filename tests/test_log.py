import hashlib

from pyspark.sql import functions as F

from mnemo.operators import log as L

SCHEMA = "id long, op_type string, key string, micros long, before string, after string, chain_id string"
LOG = [
    (1, "create", "a", 10, None, '"1"', "x"),
    (2, "create", "b", 10, None, '"1"', "y"),
    (3, "update", "a", 20, '"1"', '"2"', "x"),
    (4, "delete", "b", 30, '"1"', None, "y"),
    (5, "create", "c", 40, None, None, "x"),
    (6, "snapshot", "a", 50, None, None, "x"),
]


def chain(rows):
    root, out = "0" * 64, {}
    for i, op, key, at, before, after, _ in rows:
        own = hashlib.sha256(":".join([op, key, str(at), before or "None", after or "None"]).encode()).hexdigest()
        root = hashlib.sha256(f"{root}:{own}".encode()).hexdigest()
        out[i] = root
    return out


def test_chain_is_that_of_a_walk(spark):
    built = {r.id: r.root_hash for r in L.build_chain(spark.createDataFrame(LOG, SCHEMA).repartition(3)).collect()}
    assert built == chain([r for r in LOG if r[6] == "x"]) | chain([r for r in LOG if r[6] == "y"])
    assert L.root_of_roots(L.build_chain(spark.createDataFrame(LOG, SCHEMA))).first().chains == 2


def test_tampering_is_found_at_its_first_row(spark):
    chained = L.build_chain(spark.createDataFrame(LOG, SCHEMA))
    assert {r.chain_id: r.valid for r in L.verify_chain(chained).collect()} == {"x": True, "y": True}
    forged = chained.withColumn("after", F.when(F.col("id") == 3, '"9"').otherwise(F.col("after")))
    assert {r.chain_id: (r.valid, r.first_error) for r in L.verify_chain(forged).collect()} == {"x": (False, 3), "y": (True, None)}


def test_states_diff_and_rollback(spark, rows):
    log = spark.createDataFrame(LOG, SCHEMA)
    assert rows(L.state_at(log, 10)) == [("a", '"1"'), ("b", '"1"')]
    assert rows(L.state_at(log, 45)) == [("a", '"2"'), ("c", None)]
    times = spark.createDataFrame([(5,), (10,), (25,), (45,)], "micros long")
    want = sorted((t, *r) for t in (5, 10, 25, 45) for r in map(tuple, L.state_at(log, t).collect()))
    assert sorted(map(tuple, L.states_at(log, times).collect()), key=str) == sorted(want, key=str)
    assert [(r.key, r.status) for r in L.diff(log, 10, 45).orderBy("key").collect()] == [("a", "modified"), ("b", "removed"), ("c", "added")]
    current = L.state_at(log, 45)
    plan = L.rollback(current, log, 10)
    assert [(r.key, r.action) for r in plan.orderBy("key").collect()] == [("a", "update"), ("b", "create"), ("c", "delete")]
    assert rows(L.apply_plan(current, plan)) == rows(L.state_at(log, 10))
    assert not L.rejects_rollback(log, 45)
    assert L.rejects_rollback(log.withColumn("after", F.lit("{no json")), 45)


def test_late_arrivals_by_id(spark, rows):
    """A later id with an earlier time wins from its own time on."""
    log = spark.createDataFrame([(1, "create", "a", 30, None, '"1"', "x"), (2, "update", "a", 20, '"1"', '"2"', "x")], SCHEMA)
    times = spark.createDataFrame([(25,), (35,)], "micros long")
    assert rows(L.states_at(log, times)) == [(25, "a", '"2"'), (35, "a", '"2"')]
    assert rows(L.state_at(log, 35)) == [("a", '"2"')]


def test_history_is_newest_first(spark):
    assert [(r.id, r["rank"]) for r in L.history(spark.createDataFrame(LOG, SCHEMA), 2).where("key = 'a'").orderBy("rank").collect()] == [(6, 1), (3, 2)]
