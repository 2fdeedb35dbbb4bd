import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemo.llm import repeats, shingles, simhash


def components(fps, most=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for c in [rng.getrandbits(64) for _ in range(3)]:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)}
    chain = rng.getrandbits(64)
    for _ in range(30):  # a long chain of links with nothing else in common
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps] + [0]
    got = {r.fp: r.component for r in simhash.link(spark.createDataFrame([(f, 1 + f % 3) for f in set(signed)], "fp long, n long")).collect()}
    assert got == components(set(signed))


def test_fingerprints(spark, words):
    import xxhash

    def plain(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [None, "", " ", "One", "One two THREE É", words(40), words(300).upper() + " é", "a a a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.h for r in df.select("i", simhash.as_hex(simhash.fingerprint(F.col("t"))).alias("h")).collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(texts)}


def test_one_of_each_group_stays(spark, odd, words):
    base = [words(120) for _ in range(6)]
    rows = [(i, base[i % 6] if i < 40 else base[i % 6] + " extra") for i in range(60)] + [(100, words(120)), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_duplicates(docs).collect()
    first = {}
    for r in sorted(out, key=lambda r: r.doc_id):
        assert first.setdefault(r.component_id, r.doc_id) == r.component_id
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert kept == sorted(first)
    assert simhash.one_of_each(odd).columns == odd.columns
    assert simhash.one_of_each(odd).where("doc_id = 6").count() == 1
    assert simhash.near_duplicates(odd).count() == 9 and simhash.near_duplicates(odd.limit(0)).count() == 0


def similar(texts, least):
    """Pairs and components of all pairs of texts, by sets of the windows themselves."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent, pairs = list(range(len(texts))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9:
                pairs.append((j, i))
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return pairs, [find(i) for i in range(len(texts))]


def test_pipeline_near_copies_are_those_of_all_pairs(spark, words):
    """Recall and precision against brute force around similarity 0.8; 4 of 64 bits miss most of these."""
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = words(rng.randint(30, 250)).split()
        texts.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "  ", "one", "One", "two words", *[words(100) for _ in range(20)]]
    pairs, want = similar(texts, 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    far = [(simhash.simhash(texts[i]), simhash.simhash(texts[j])) for i, j in pairs if texts[i] and texts[j]]
    assert sum(((a ^ b) & (2**64 - 1)).bit_count() > 4 for a, b in far) > 20
    groups = {}
    for r in shingles.near_duplicates(df).collect():
        groups.setdefault(r.component, set()).add(r.doc_id)
    expected = {}
    for i, c in enumerate(want):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(expected)


def test_texts_around_one_passage_are_paired_by_rare_shingles(spark, words, monkeypatch):
    """Many texts share a passage and half of their shingles; those more alike are linked as all pairs say, without all pairs."""
    rng = random.Random(13)
    passage, texts = words(60), []
    for i in range(160):
        texts.append(passage + " " + words(rng.randint(12, 50)))
        if i % 4 == 0:
            more = texts[-1].split()
            more[rng.randrange(len(more))] = "other"
            texts.append(" ".join(more) + " " + words(rng.randint(0, 9)))
    pairs, want = similar(texts, 0.8)
    asked = []
    whole = shingles.sharing_rare

    def noted(rows, least):
        asked.append((rows.count(), whole(rows, least)))
        return asked[-1][1]

    monkeypatch.setattr(shingles, "sharing_rare", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in shingles.near_duplicates(df).collect():
        groups.setdefault(r.component, set()).add(r.doc_id)
    expected = {}
    for i, c in enumerate(want):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    ((n, found),) = asked
    assert n > 100 and found.dropDuplicates(["u", "v"]).count() < n * n / 20

    ids = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "set long, component long, t string")
    alone = ids.withColumn("size", F.size(shingles.shingled(F.col("t"))).cast("long"))
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in whole(alone, 0.8).collect()}
    assert {(min(p), max(p)) for p in pairs} <= got


def test_pipeline_near_copies_of_odd_rows(spark, odd):
    assert shingles.near_duplicates(odd).count() == 9 and shingles.near_duplicates(odd.limit(0)).count() == 0
    out = shingles.one_of_each(odd)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "6", "7", "None"]


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1)) if len(d) else 0
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"group_runs": 60, "anchor_runs": 3}])
def test_repeats_byte_for_byte(spark, words, limits):
    rng = random.Random(8)
    passages = [words(60) for _ in range(5)]
    texts = []
    for _ in range(70):
        t = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 100)
            t += rng.choice(passages)[a : a + rng.randint(100, 320)] + words(rng.randint(0, 20))
        texts.append(t)
    texts += [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 900, texts[3], texts[3], "ab" * 300, "é" * 150 + words(10), "é" * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **limits).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeats_of_odd_rows(spark, odd):
    out = repeats.remove_repeats(odd.where("doc_id is null or doc_id <> 5"), with_text=True)
    assert out.count() == 8 and "extra" in out.columns and {r.doc_id: r.kept for r in out.collect()}[6] == "same text"
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_sorted_strings_and_deceived_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    size = rng.integers(0, 100, 500)

    def check():
        s = repeats.Sorted(data, start, size)
        strings = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
        assert [strings[i] for i in s.order] == sorted(strings)
        for k in range(1, 500):
            p, q = strings[s.order[k - 1]], strings[s.order[k]]
            n = next((j for j, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
            assert s.common[k] == n

    check()
    monkeypatch.setattr(repeats.Hashes, "of", lambda self, a, b: (b - a).astype(np.uint64))
    check()


def test_shared_shingles_of_short_and_long_texts():
    """However a task holds them, two texts have the same shingles in common."""
    from mnemo.llm.shingles import shared

    p, q = np.arange(0, 90, 2, dtype=np.uint64) + np.uint64(1 << 63), np.arange(0, 90, 3, dtype=np.uint64) + np.uint64(1 << 63)
    kept = [frozenset(x.tolist()) for x in (p, q)]
    assert {shared(a, b) for a in (p, kept[0]) for b in (q, kept[1])} == {15}
    assert shared(frozenset(), q) == 0 and shared(p[:0], kept[1]) == 0
