import re
from collections import Counter

from pyspark.sql import functions as F

from mnemo.llm import mixing, quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = W.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark, odd, words):
    texts = [words(n) + "\n" + words(6) * 2 for n in (0, 3, 30, 200)] + ["a b c d e f " * 5, "a b c d e x a b c d e y", "l1\nl1\n\nl2 #$\nl1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in quality.judge(df).collect():
        assert tuple(r[n] for n in names) == base(r.text), r.text[:50] if r.text else None
        assert not (r.base_failed and r.kept)
    out = quality.judge(odd)
    assert out.columns.count("kept") == 1 and "extra" in out.columns and out.count() == 9
    assert quality.judge(odd.limit(0)).count() == 0


def test_lines_are_cut_before_documents(spark, words):
    line = lambda i: f"{words(9).capitalize()} number {i}."
    menu = "Home | News | Sport | Contact | About us | Login"
    rows = [(1, "\n".join([line(i) for i in range(8)] + [menu, "Accept cookies to go on."])), (2, "\n".join(f"{w} | {w}a | {w}b | {w}c" for w in words(9).split())), (3, "\n".join(line(i) for i in range(3)))]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and menu not in out[1].clean_text and "cookies" not in out[1].clean_text and out[1].clean_text.count("number") == 8
    assert not out[2].kept and out[3].kept and out[3].clean_text == rows[2][1]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.n_chars == len(r.text) for r in kept.collect()} == {1: True, 3: True}


def fill(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mix_meets_targets(spark):
    rows = [(i, "hot", 1 + i * 7 % 50) for i in range(3000)] + [(5000 + i, s, 1 + i % 9) for s in ("a", "tiny", None, "ü") for i in range({"tiny": 3}.get(s, 400))] + [(9000, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    out = mixing.mix(df, block_docs=50, shard_blocks=4).collect()
    want, taken = fill(sizes), {}
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(3), block_docs=50, shard_blocks=4)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in out)
    shards = Counter(d.shard for r in out for d in r.draws)
    assert len(shards) > 8


def test_what_is_taken_is_what_the_shards_draw(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0], 1 + i * 7 % 50) for i in range(2000)], "doc_id long, source string, size long")
    run = lambda: sorted((r.doc_id, r.taken, tuple(d.shard for d in r.draws)) for r in mixing.mix(df, block_docs=20, shard_blocks=4).collect())
    want, tree = run(), mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda draws, shards, seed: draws.select("s", F.lit(0).alias("shard"), F.lit(0).alias("first"), "q"))
    flat = run()
    assert [x[:2] for x in flat] == [x[:2] for x in want] and flat != want
    # shards that draw nothing take nothing
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: tree(*a).where("shard % 2 = 0"))
    half = run()
    assert {s for x in half for s in x[2]} == {s for x in want for s in x[2] if s % 2 == 0} and sum(x[1] for x in half) < 0.7 * sum(x[1] for x in want)
    # runs of a shard in order are those of parts put in order
    monkeypatch.setattr(mixing, "shard_quotas", tree)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    assert run() == want


def test_quotas_are_exact_at_every_level(spark):
    q = spark.createDataFrame([(i, 50 + 13 * i) for i in range(1, 9)] + [(9, 1)], "s int, q long")
    rows = mixing.shard_quotas(q, 16, 5).collect()
    total = Counter()
    for r in rows:
        total[r.s] += r.q
    assert total == {r.s: r.q for r in q.collect()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.s, r.shard)):
        assert r.first == ends.get(r.s, 0)
        ends[r.s] = r.first + r.q
    assert sorted((r.s, r.shard, r.q) for r in mixing.shard_quotas(q, 1024, 5).collect())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.q
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_draws_follow_the_hypergeometric(spark):
    u = (F.col("id") + 0.5) / 4000
    got = Counter(r[0] for r in spark.range(4000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(10), u)).collect())
    from math import comb

    for k in range(9):
        assert abs(got[k] / 4000 - comb(8, k) * comb(12, 10 - k) / comb(20, 10)) < 1e-3
    edges = spark.range(50).select(mixing.hypergeometric(F.lit(5), F.lit(5), F.lit(3), F.lit(0.99)), mixing.hypergeometric(F.lit(5), F.lit(0), F.lit(3), F.lit(0.5))).distinct().collect()
    assert [tuple(r) for r in edges] == [(3, 0)]


def test_mixed_documents_and_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(W.findall(r.text or "")) for r in out.collect()) > 0
    sized = mixing.mix(mixing.sized_documents(odd, "extra", "n_words"), block_docs=1).collect()
    assert len(sized) == 9 and {r.extra for r in sized} == {"x"} and sum(r.taken for r in sized) == sum(r["size"] for r in sized) == sum(len(W.findall(r.text or "")) for r in odd.collect())
    assert {r["size"] for r in sized if not r.draws} >= {0} and all(r.taken == sum(d.words for d in r.draws) for r in sized)
    assert mixing.mix(mixing.sized_documents(odd.limit(0))).count() == 0
    t = spark.createDataFrame([("  a b\n c  d ", 3), ("a", 1)], "t string, n int")
    assert [r[0] for r in t.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b\n c", "a"]
