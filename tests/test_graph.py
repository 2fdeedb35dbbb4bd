import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions import strength as S
from mnemo.functions import text as X
from mnemo.operators import graph as H
from mnemo.operators.components import connected_components
from mnemo.plans import fixtures as T

EDGES = "source string, target string, relation_type string, weight double, edge_seq long"


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_entities_and_pairs(spark):
    df = spark.createDataFrame([("The Django app uses Python. Anaché This Django x",), ("host = local, port: 80",)], "t string")
    assert df.select(X.entities(F.col("t"))).first()[0] == ["Django", "Python"]
    assert [tuple(x) for x in df.select(X.key_values(F.col("t"))).collect()[1][0]] == [("host", "local"), ("port", "80")]


def test_contradictions_and_walks(spark):
    e = spark.createDataFrame([("a", "b", "supports", 1.0, 1), ("a", "b", "contradicts", 1.0, 2), ("b", "c", "contradicts", 1.0, 3), ("c", "a", "causes", 1.0, 4)], EDGES)
    assert {(r.source, r.kind) for r in H.contradictions(e).collect()} == {("a", "relation_conflict"), ("b", "direct_contradiction")}
    got = H.traverse(e, spark.createDataFrame([("a",)], "node string"), 5)
    assert {(r.node, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_activation_keeps_first_visit(spark):
    e = spark.createDataFrame([("a", "x", "r", 0.9, 1), ("b", "x", "r", 1.0, 2), ("x", "y", "r", None, 3), ("y", "z", "r", 0.1, 4)], EDGES)
    seeds = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 1.0, 2)], "query_id long, node string, score double, seed_seq long")
    got = {r.node: (round(r.score, 6), r.hops, ">".join(r.path)) for r in H.spread_activation(e, seeds, least=0.05).collect()}
    assert got == {"a": (1.0, 0, "a"), "b": (1.0, 0, "b"), "x": (0.45, 1, "a>x"), "y": (0.05625, 2, "a>x>y")}
    summed = {r.node: round(r.score, 6) for r in H.spread_activation(e, seeds, least=0.05, combine="sum").collect()}
    assert summed["x"] == 0.95


def test_blind_spots(spark):
    e = spark.createDataFrame([("a", "b", "r", 1.0, 1), ("a", "c", "r", 1.0, 2), ("x", "y", "r", 1.0, 3), ("y", "x", "r", 1.0, 4)], EDGES)
    nodes = spark.createDataFrame([(n, 0.0 if n == "a" else 86400.0 * 100, None) for n in "abcxy"], "name string, updated_at double, conflict_id string")
    kinds = {}
    for r in H.blind_spots(nodes, e, 86400.0 * 100).collect():
        kinds.setdefault(r.kind, set()).add(r.node)
    assert kinds == {"orphan": {"b", "c"}, "shallow": {"a", "x", "y"}, "stale": {"a"}, "isolated": {"x", "y"}}


def test_shared_entities_link_later_to_earlier(spark):
    m = spark.createDataFrame([("m1", "Django and Python here", 1), ("m2", "Python with Django there", 2), ("m3", "Nothing", 3)], "key string, value string, seq long").withColumn("memory_type", F.lit("semantic")).withColumn("importance", F.lit(0.5))
    index = H.entity_index(m)
    assert [tuple(r) for r in H.cross_memory_links(index).collect()] == [("m2", "m1")]
    q = spark.createDataFrame([(1, "Django Python Nothing Else")], "query_id long, query string")
    assert {(r.key, r.boost) for r in H.entity_overlap_boost(q, index).collect()} == {("m1", 0.4), ("m2", 0.4), ("m3", 0.2)}
    nodes, edges = H.ingest(m)
    assert {tuple(r) for r in H.rebuild_index(nodes, edges).collect()} == {tuple(r) for r in index.select("entity", "key").collect()}


def walked(edges, seeds, decay=0.5, hops=3, least=0.1):
    """Activation by a plain walk: {node: (score, hops, path)} of one query's seeds in order."""
    onward = {}
    for source, target, _, weight, _ in sorted(edges, key=lambda e: e[4]):
        onward.setdefault(source, []).append((target, weight if weight and weight > 0 else 0.5))
    out = {n: (s, 0, [n]) for n, s in seeds}
    frontier = list(seeds)
    for h in range(1, hops + 1):
        found = []
        for node, score in frontier:
            for target, strength in onward.get(node, []):
                if target not in out and (s := score * decay**h * strength) >= least:
                    out[target] = (s, h, [*out[node][2], target])
                    found.append((target, s))
        frontier = found
    return out


@pytest.fixture(scope="module")
def web(spark):
    """Memories of the smallest tables, edges drawn among them, and seeds of twelve queries with ties."""
    memories = T.memories(spark, "/root/testdata/sf0.001")
    keys = sorted(r.key for r in memories.select("key").collect())[:60]
    rng = random.Random(4)
    edges = [(rng.choice(keys), rng.choice(keys), "r", rng.choice([None, 0.0, 0.3, 0.6, 0.9, 1.0]), i) for i in range(400)]
    seeds = [(q, k, rng.choice([0.5, 0.8, 1.0])) for q in range(12) for k in rng.sample(keys, 7)]
    return memories, edges, seeds


def test_activation_is_that_of_a_plain_walk(spark, web):
    _, edges, seeds = web
    rows = [(q, k, s, i) for i, (q, k, s) in enumerate(seeds)]
    got = {}
    for r in H.spread_activation(spark.createDataFrame(edges, EDGES), spark.createDataFrame(rows, "query_id long, node string, score double, seed_seq long"), least=0.02).collect():
        got.setdefault(r.query_id, {})[r.node] = (pytest.approx(r.score), r.hops, list(r.path))
    assert got == {q: walked(edges, [(k, s) for n, k, s in seeds if n == q], least=0.02) for q in range(12)}
    assert max(x[1] for one in got.values() for x in one.values()) >= 2


def test_graph_recall_is_that_of_a_plain_walk(spark, web):
    memories, edges, seeds = web
    strength = {r.key: r.strength for r in memories.select("key", S.entry_strength(T.NOW)["strength"].alias("strength")).collect()}
    want = set()
    for q in range(12):
        first = sorted(((k, s) for n, k, s in seeds if n == q), key=lambda x: (-x[1], x[0]))[:5]
        top = sorted(walked(edges, first).items(), key=lambda x: (-round(x[1][0], 9), x[0]))[:10]
        best = sorted((-round(score * (0.5 + 0.5 * strength[k]), 6), k) for k, (score, _, _) in top)[:5]
        want |= {(q, k, n) for n, (_, k) in enumerate(best, 1)}
    asked = spark.createDataFrame(seeds, "query_id long, key string, importance double")
    got = H.graph_recall(asked, memories, spark.createDataFrame(edges, EDGES), T.NOW)
    assert {(r.query_id, r.key, r.rank) for r in got.collect()} == want
    assert H.graph_recall(asked.limit(0), memories, spark.createDataFrame(edges, EDGES), T.NOW).count() == 0
