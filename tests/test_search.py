import random
import time

import pytest

from mnemo.operators import log as L
from mnemo.operators import revise as R
from mnemo.operators import search as I
from mnemo.sources import durable


def test_nearest_of_equal_vectors_have_the_smallest_keys(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(39, -1, -1)] + [(100 + k, [0.0, float(k)]) for k in range(5)], "key long, embedding array<double>").repartition(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    for metric in ("l2", "cosine"):
        got = {(r.query_id, r.rank): r.key for r in I.knn(q, df, 3, metric).collect()}
        assert [got[1, r] for r in (1, 2, 3)] == [0, 1, 2] and got[2, 1] == 101 and len(got) == 6
    assert I.knn(q.limit(0), df, 3).count() == 0 and I.knn(q, df.limit(0), 3).count() == 0


def test_blocks_of_queries_change_nothing(spark):
    rng = random.Random(1)
    row = lambda: [round(rng.random(), 1) for _ in range(3)]
    v = spark.createDataFrame([(f"k{i}", row()) for i in range(300)], "key string, embedding array<double>")
    q = spark.createDataFrame([(i, row()) for i in range(40)], "query_id long, embedding array<double>")
    run = lambda **x: sorted(map(tuple, I.knn(q, v, 4, **x).collect()))
    got = run()
    assert got == run(block_bytes=100) and len(got) == 160
    vectors, asked = {r.key: r.embedding for r in v.collect()}, {r.query_id: r.embedding for r in q.collect()}
    for i, x in asked.items():
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, 6), k) for k, y in vectors.items())[:4]
        assert [(d, k) for n, k, d, _ in sorted(got, key=lambda r: r[3]) if n == i] == near


def test_tokens_inside_words_are_found(spark):
    docs = spark.createDataFrame([("d1", "Theatre of the_absurd, x", 0.5), ("d2", "heat " + "z" * 30_000, 0.1), ("d3", None, 0.0), ("d4", "", 0.2)], "key string, value string, importance double")
    q = spark.createDataFrame([(1, "the eat zzzzz"), (2, "absurd d4"), (3, "!?"), (4, None)], "query_id long, query string")
    got = {(r.query_id, r.key): r.score for r in I.lexical_rank(q, docs).collect()}
    assert got == {(1, "d1"): 2.05, (1, "d2"): 2.01, (2, "d1"): 1.05, (2, "d4"): 1.02}
    fallback = I.keyword_search(spark.createDataFrame([(1, "e of the_a")], "query_id long, query string"), docs.withColumnRenamed("importance", "i"), 5)
    assert [(r.key, r.score) for r in fallback.collect()] == [("d1", pytest.approx(fallback.first().score))]


def test_one_long_chain_and_one_long_history(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("id", "'update' AS op_type", "'k' AS key", "id AS micros", "CAST(NULL AS STRING) AS before", "CAST(id AS STRING) AS after", "'c' AS chain_id")
    start = time.perf_counter()
    assert L.verify_chain(L.build_chain(rows)).first().valid
    proposals = spark.range(n).selectExpr("'k' AS key", "id AS seq", "CAST(id % 3 AS STRING) AS value", "(id % 7) / 10 AS importance", "CAST(id AS DOUBLE) AS created_at", "id % 2 = 0 AS is_verified")
    beliefs, decisions = R.revise(proposals, "recency")
    assert beliefs.first().seq == n - 1 and decisions.where("decision = 'accepted'").count() == n - 1
    assert time.perf_counter() - start < 60


def test_tables_need_a_shared_folder_and_can_be_dropped(spark):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    with pytest.raises(ValueError):
        durable.shared_dir(type("S", (), {"conf": Conf()})())
    df = durable.durable(spark.range(3))
    assert df.count() == 3
    durable.drop_tables(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()
