from pyspark.sql import functions as F

from mnemo.operators import predicates as P
from mnemo.operators import scores as C
from mnemo.operators import search as I
from mnemo.operators import upsert as U
from mnemo.sources import tables as A


def test_upsert_keeps_what_it_should(spark):
    schema = "key string, id string, value string, created_at double, updated_at double, last_accessed double, access_count int, session_id string, seq long"
    old = spark.createDataFrame([("a", "i1", "1", 1.0, 1.0, 1.0, 3, "s1", 1), ("b", "i2", "1", 1.0, 1.0, 1.0, 0, "s1", 2)], schema)
    new = spark.createDataFrame([("a", "i9", "2", 9.0, 9.0, 9.0, 0, "s9", 3), ("a", "i9", "3", 9.0, 9.0, 9.0, 0, "s9", 4), ("c", "i3", "1", 9.0, 9.0, 9.0, 0, "s9", 5)], schema)
    got = {r.key: r for r in U.upsert(old, new, 100.0).collect()}
    assert (got["a"].id, got["a"].value, got["a"].created_at, got["a"].access_count, got["a"].session_id, got["a"].updated_at) == ("i1", "3", 1.0, 4, "s1", 100.0)
    assert got["b"].updated_at == 1.0 and got["c"].id == "i3" and got["c"].access_count == 1
    assert {r.key: r.access_count for r in U.upsert(old, new, 100.0, touch=False).collect()} == {"a": 0, "b": 0, "c": 0}
    log = [(r.seq, r.op_type, r.before, r.after) for r in U.commit_log(old, new).orderBy("seq").collect()]
    assert log == [(3, "update", "1", "2"), (4, "update", "2", "3"), (5, "create", None, "1")]


def test_keys_and_text(spark):
    keys = ["ok:key-1.x", "", "../x", "a b", "x" * 257, None]
    df = spark.createDataFrame([(k, '"v"') for k in keys] + [("k", "{bad")], "k string, v string")
    errors = [r[0] for r in df.select(P.key_error(F.col("k"), F.col("v"))).collect()]
    assert errors == [None, "empty key", "path in key", "bad key", "bad key", "empty key", "value is no JSON"]
    t = spark.createDataFrame([("  <b>x</b> JavaScript:y\x00 ",)], "t string")
    assert t.select(P.sanitize_text(F.col("t"))).first()[0] == "x y"


def test_sections_and_json(spark):
    docs = spark.createDataFrame([("f", "# Intro\nhello\n\n## Rules\n- a\n- b\n## Instructions\ndo"), ("g", "no heading")], "key string, text string")
    got = [(r.part, r.title, r.body, r.memory_type) for r in A.split_sections(docs).orderBy(F.substring_index("key", "#", 1), "part").collect()]
    assert got == [(0, "Intro", "hello", "semantic"), (1, "Rules", "- a\n- b", "semantic"), (2, "Instructions", "do", "procedural"), (0, "", "no heading", "semantic")]
    js = spark.createDataFrame([("o", '{"a": 1, "b": "x"}'), ("l", '[{"type": "semantic", "v": 1}, 2]'), ("r", "raw {")], "key string, text string")
    assert {(r.key, r.name, r.memory_type) for r in A.explode_json_memories(js).collect()} == {("o", "a", "semantic"), ("o", "b", "semantic"), ("l", "0", "semantic"), ("l", "1", "episodic"), ("r", "raw", "semantic")}


def test_files_come_back(spark, tmp_path):
    m = spark.createDataFrame([(f"k{i}", "semantic", '{"a": "x, \\"y\\""}', 1.0, float(i)) for i in range(5)], "key string, memory_type string, value string, importance double, created_at double")
    for fmt in ("json", "csv"):
        A.export_memories(m, f"{tmp_path}/{fmt}", fmt, 3)
        back = A.read_import(spark, f"{tmp_path}/{fmt}", fmt)
        assert back.count() == 3 if fmt == "json" else back.count() == 3
    entries, rejects = A.import_memories(A.read_import(spark, f"{tmp_path}/json"))
    assert {r.key for r in entries.collect()} == {"k4", "k3", "k2"} and rejects.count() == 0
    nodes, edges = spark.range(3), spark.range(2)
    A.export_graph(nodes, edges, f"{tmp_path}/g")
    assert [x.count() for x in A.import_graph(spark, f"{tmp_path}/g")] == [3, 2]


def test_memory_tables_are_read_in_their_columns(spark, tmp_path):
    spark.createDataFrame([("k", "v", 0.5, "mine"), (None, None, None, None)], "key string, value string, importance double, extra string").write.parquet(f"{tmp_path}/m")
    got = A.read_memories(spark, f"{tmp_path}/m")
    assert got.schema == spark.createDataFrame([], A.MEMORIES).schema
    assert sorted((r.key or "", r.value, r.importance, r.ttl, r.ccs_dimensions) for r in got.collect()) == [("", None, None, None, None), ("k", "v", 0.5, None, None)]


def test_ranking(spark):
    docs = spark.createDataFrame([("a", "spark joins tables", 0.5, False), ("b", "spark", 0.5, False), ("c", "nothing", 0.5, True)], "key string, value string, importance double, is_verified boolean")
    q = spark.createDataFrame([(1, "spark tables"), (2, "zzz")], "query_id long, query string")
    assert [(r.query_id, r.key) for r in I.bm25_search(q, docs, 5).orderBy("query_id", "rank").collect()] == [(1, "a"), (1, "b")]
    one = I.rrf([(I.bm25_search(q, docs, 5), 1.0)]).orderBy(F.desc("score")).first()
    assert one.key == "a" and one.score == 1 / 61
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1])], "key long, embedding array<double>")
    near = I.knn(v.where("key = 2").withColumnRenamed("key", "query_id"), v, 2)
    assert [r.key for r in near.orderBy("rank").collect()] == [2, 3]


def test_abbreviations_budgets_sessions(spark):
    from mnemo.functions import text as X

    q = spark.createDataFrame([("deploy the db deployment",)], "q string")
    assert q.select(X.expand_abbreviations(F.col("q"))).first()[0] == "deploy deployment the db database deployment"
    assert "recall" in q.select(X.expand_query(F.lit("memory x"))).first()[0]
    r = spark.createDataFrame([(1, 1000, "greedy", "generic", None), (2, 0, "nope", "coding", ["semantic"])], "request_id long, budget long, strategy string, task_type string, missing_types array<string>")
    got = {(x.request_id, x.memory_type): x.tokens for x in C.allocate_budget(r).collect()}
    assert got[1, "episodic"] == 400 and got[2, "semantic"] == 0 and got[2, "procedural"] == int(2048 * 0.45 / 1.1)
    m = spark.createDataFrame([(f"k{i}", "word " * 3, "s1" if i < 6 else None, 0.1 * i, float(i)) for i in range(8)], "key string, value string, session_id string, importance double, created_at double").withColumn("memory_type", F.lit("episodic"))
    out = C.summarize_sessions(m).collect()
    assert [(r.session_id, r.entries) for r in out] == [("s1", 6)] and out[0].summary.count("|") == 4
