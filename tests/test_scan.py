"""Rankings over all documents write to disk what grows with the results, not with documents times queries."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import scan as K
from mnemo.operators import search as I
from mnemo.plans import catalog

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghij"


@pytest.fixture(scope="module")
def tables(spark):
    """(docs, queries): 6000 documents over a small vocabulary, so that nearly each holds a word of each query; copies among them."""
    rng = random.Random(7)
    words = [a + b + c for a in LETTERS for b in LETTERS for c in LETTERS]
    text = lambda n: " ".join(rng.choice(words[:300]) for _ in range(n))
    bodies = [text(30) for _ in range(200)]
    rows = [(f"d{i}", bodies[i % 200] if i % 3 else f"Xay {text(30)}", i % 100 / 100, i % 3 == 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "key string, value string, importance double, is_verified boolean").repartition(4).cache()
    asked = spark.createDataFrame([(i, f"Xay {text(12)}") for i in range(40)], "query_id long, query string").cache()
    docs.count(), asked.count()
    return docs, asked


def shuffled(spark, run) -> int:
    """Bytes that ``run`` writes for shuffles."""
    sc = spark.sparkContext
    lists = lambda: sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))
    before = {(s.stageId(), s.attemptId()) for s in lists()}
    run()
    return sum(s.shuffleWriteBytes() for s in lists() if (s.stageId(), s.attemptId()) not in before)


def lexical_by_hand(docs, asked, k):
    import re

    rows = {r.key: (f"{r.key} {r.value}".lower(), r.importance) for r in docs.collect()}
    out = []
    for q in asked.collect():
        tokens = set(re.findall("[a-z0-9_]+", q.query.lower()))
        found = [(-round(n + 0.1 * imp, 6), key) for key, (t, imp) in rows.items() if (n := sum(w in t for w in tokens))]
        out += [(q.query_id, key, -s, r) for r, (s, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_lexical_rank(spark, tables):
    docs, asked = tables
    got = []
    assert shuffled(spark, lambda: got.extend(I.lexical_rank(asked, docs, 5).collect())) < 200_000
    assert sorted((r.query_id, r.key, r.score, r["rank"]) for r in got) == lexical_by_hand(docs, asked, 5)
    # all of them without a limit, and null importance as no score, which comes last
    few = docs.limit(50).unionByName(spark.createDataFrame([("none", "Xay", None, None)], docs.schema))
    every = I.lexical_rank(asked, few)
    assert every.count() > 50 * 20 and every.where("score IS NULL").select("key").distinct().collect() == [("none",)]
    last = every.groupBy("query_id").agg(F.max_by("key", "rank").alias("key"))
    assert last.where("key <> 'none'").count() == 0


def test_adequacy_shuffles_only_the_texts_of_results(spark, tables):
    docs, asked = tables
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, tries = [], []
        assert shuffled(spark, lambda: got.extend(I.recall_adequacy(asked, I.lexical_rank(asked, docs, 1), docs).collect())) < 400_000
        assert shuffled(spark, lambda: tries.extend(I.recall_reflective(asked, lambda x: I.lexical_rank(x, docs, 3), docs, 1, 0.95).collect())) < 1_200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    texts = {r.key: f"{r.key} {r.value}".lower() for r in docs.collect()}
    best = {q: key for q, key, _, _ in lexical_by_hand(docs, asked, 1)}
    for r in got:
        tokens = set(next(q.query for q in asked.collect() if q.query_id == r.query_id).lower().split())
        assert r.adequacy == pytest.approx(sum(t in texts[best[r.query_id]] for t in tokens) / len(tokens), abs=1e-6)
    assert {r.query_id for r in tries} == set(best)


def bm25_by_hand(docs, asked, k):
    import math
    import re
    from collections import Counter

    rows = docs.collect()
    found = {r.key: Counter(re.findall("[a-z0-9]{2,}", (r.value or "").lower())) for r in rows}
    weight = {r.key: 1 + 0.3 * r.importance + 0.2 * r.is_verified for r in rows}
    mean = sum(map(Counter.total, found.values())) / len(rows)
    df = Counter(t for c in found.values() for t in c)
    out = []
    for q in asked.collect():
        terms = Counter(re.findall("[a-z0-9]{2,}", q.query.lower()))
        part = lambda c, t, n: n * math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        scores = [(-round(weight[key] * sum(part(c, t, n) for t, n in terms.items() if t in c), 6), key) for key, c in found.items() if any(t in c for t in terms)]
        out += [(q.query_id, key, -s, r) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_bm25_search(spark, tables):
    docs, asked = tables
    got = []
    assert shuffled(spark, lambda: got.extend(I.bm25_search(asked, docs, 5).collect())) < 200_000
    got, want = sorted((r.query_id, r.key, r.score, r["rank"]) for r in got), bm25_by_hand(docs, asked, 5)
    assert [(q, k, r) for q, k, _, r in got] == [(q, k, r) for q, k, _, r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.1e-6)


def test_blocks_of_queries_and_parts_of_documents_change_nothing(spark, tables, monkeypatch):
    docs, asked = tables
    few = docs.limit(300)
    run = lambda: [sorted(map(tuple, f(asked, few, 3).collect())) for f in (I.bm25_search, I.lexical_rank)]
    want = run()
    monkeypatch.setattr(K, "blocks", lambda terms, size=60, f=K.blocks: f(terms, size))
    assert run() == want and all(len(w) == 120 for w in want)
    best = K.Best(2, 2)
    for a in range(0, 400_000, 50_000):  # cut on the way
        best.add(np.tile([0, 1], 25_000), np.repeat(np.arange(a, a + 50_000) // 2 % 7, 1).astype(float), lambda at: np.array([f"k{i:06}" for i in at], object))
    assert best.n < 200_000 and list(best.cut()[1]) == [6.0] * 4


def test_keyword_search_shuffles_little(spark, tables):
    docs, asked = tables
    more = asked.unionByName(spark.createDataFrame([(99, "zz%$ 9 "), (98, None)], asked.schema))
    got = []
    assert shuffled(spark, lambda: got.extend(I.keyword_search(more, docs, 5).collect())) < 300_000
    assert len(got) == 5 * 40 and {r["rank"] for r in got} == set(range(1, 6))


def plan_of(spark, name: str) -> str:
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_reranked_memories_are_not_numbered_in_one_task(spark):
    assert "dense_rank" not in plan_of(spark, "rerank_decay")


def test_truth_is_looked_up_for_the_results_only(spark):
    assert "NestedLoop" not in plan_of(spark, "retrieval_eval")
