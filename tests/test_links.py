"""Links of memories against plain pairs, and what they cost on disk."""

import random

from mnemo.operators import graph as H
from mnemo.operators.links import links
from test_scan import shuffled


def made(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(f"E{rng.randrange(1 + rng.randrange(60))}", f"k{k}", k // 2 * 2) for k in range(n) for _ in range(rng.randrange(6))]
    return spark.createDataFrame(rows, "entity string, key string, seq long"), set(rows)


def plain(rows):
    by = {}
    for e, k, s in rows:
        by.setdefault(e, []).append((k, s))
    return sorted({(a, b) for held in by.values() for a, s in held for b, t in held if s > t})


def test_links_are_all_pairs_once(spark, rows):
    index, held = made(spark, 300)
    want = plain(held)
    for size in (10**6, 97):
        assert rows(links(index, size)) == want
    twice = index.unionByName(spark.createDataFrame([("E1", "k7", 900)], index.schema))  # a key with two numbers
    assert rows(links(twice)) == plain(held | {("E1", "k7", 900)})
    assert links(index.limit(0)).count() == 0
    few = H.cross_memory_links(index, 20)
    assert 0 < few.count() < len(want)


def test_no_link_is_shuffled(spark):
    index, _ = made(spark, 3000)
    index = index.cache()
    n = []
    assert shuffled(spark, lambda: n.append(H.cross_memory_links(index).count())) < 300_000 and n[0] > 700_000
