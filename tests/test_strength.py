import math
import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions import strength as S
from mnemo.operators import forgetting as G
from mnemo.operators import working as W

NOW = 1_000_000_000.0
MEMORY = "key string, memory_type string, current_strength double, importance double, verification_score double, access_count int, created_at double, updated_at double, last_accessed double"


def strength(spark, *values):
    df = spark.createDataFrame([values], "s double, t string, d double, i double, v double, a int")
    return df.select(S.new_strength(*map(F.col, "stdiva")).alias("r")).first().r


def test_decay_formula(spark):
    assert strength(spark, 0.8, "semantic", 0.0, 0.1, 0.0, 0).strength == 0.8
    fresh = strength(spark, 1.0, "semantic", 5.0, 0.1, 0.0, 0)
    assert fresh.strength == pytest.approx(math.exp(-0.005 * 5)) and fresh.phase == "exponential"
    late = strength(spark, 1.0, "working", 4.0, 0.1, 0.0, 0)
    assert late.strength == pytest.approx(math.exp(-0.05) * 4**-0.5) and late.phase == "power_law"
    assert strength(spark, 1.0, "episodic", 30.0, 0.95, 0.9, 0).ltp == "full"
    assert strength(spark, 1.0, "nonsense", 5.0, 0.1, 0.0, 0).strength == fresh.strength


def test_pass_prunes_and_keeps_last_access(spark):
    rows = [("old", "working", 0.4, 0.1, 0.0, 0, NOW - 86400 * 60, 0.0, 0.0), ("new", "working", 0.9, 0.1, 0.0, 0, NOW - 60, 0.0, NOW - 60)]
    out = G.decay_pass(spark.createDataFrame(rows, MEMORY), NOW).collect()
    assert [r.key for r in out] == ["new"] and out[0].last_accessed == NOW - 60 and out[0].updated_at == NOW
    assert tuple(G.decay_counts(spark.createDataFrame(rows, MEMORY), NOW).first()) == (2, 1, 1)


def test_preview_falls_and_stops(spark):
    p = spark.createDataFrame([("a", "working", 0.1, 0.0, 0)], "id string, memory_type string, importance double, verification_score double, access_count int")
    values = [r.strength for r in G.decay_preview(p, 90).orderBy("day").collect()]
    assert values[0] == 1.0 and values == sorted(values, reverse=True) and len(values) < 91


def test_protection(spark):
    df = spark.createDataFrame([("a", "semantic", 0.9, 0), ("b", "procedural", 0.1, 10), ("c", "semantic", 0.1, 10), ("d", "semantic", 0.1, 20)], "key string, memory_type string, importance double, access_count int")
    assert {r.key for r in df.where(S.is_protected()).collect()} == {"a", "b", "d"}


def test_salted_top_k_is_the_plain_one(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") % 100).alias("v"), "id")
    plain = G.top_per_group(df, "g", [F.desc("v"), F.col("id")], 7)
    salted = G.top_per_group(df, "g", [F.desc("v"), F.col("id")], 7, salts=8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_heat_folds_in_order(spark):
    rng = random.Random(1)
    data = [("k", i, float(i * 1800 + rng.randrange(900)), rng.random()) for i in range(30)]
    h, t = 0.0, None
    for _, _, at, importance in data:
        h *= 0.95 ** (((at - t) / 3600) if t is not None else 0)
        h, t = max(0.0, min(1.0, h + 0.2 * max(0.1, importance))), at
    rng.shuffle(data)
    got = W.heat(spark.createDataFrame(data, "key string, seq long, created_at double, importance double").repartition(5)).first()
    assert got.heat == pytest.approx(h)


def test_working_memory_keeps_its_slots(spark):
    data = [("s", i, f"k{i % 5}", (i * 37 % 11) / 10, float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "session_id string, seq long, key string, importance double, created_at double")
    out = W.replay_working_memory(df, slots=3).orderBy("seq").collect()
    held = {}
    for (_, _, key, importance, at), r in zip(data, out, strict=True):
        gone = None
        if key not in held and len(held) == 3:
            gone = min(held, key=lambda k: (held[k][0] / max(1.0, at - held[k][1]), k))
            del held[gone]
        held[key] = (importance, at)
        assert (r.key, r.evicted, r.held) == (key, gone, len(held))


def test_pairs_over_bucket_borders(spark):
    data = [("s", "a", 3599.0), ("s", "b", 3601.0), ("s", "c", 7300.0), ("t", "a", 3600.0), ("s", "d", 3000.0)]
    got = G.co_access_pairs(spark.createDataFrame(data, "session_id string, key string, created_at double"), 3600.0)
    want = {(x[0], *sorted((x[1], y[1]))) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and abs(x[2] - y[2]) < 3600}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
