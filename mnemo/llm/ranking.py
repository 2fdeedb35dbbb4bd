"""Ranked lexical search: every item of a query table against all documents, by integer scores.

Documents are read once for a block of items and keep only the counts of the
block's terms.  A task turns its documents, a segment at a time, into posting
lists.  For an item it first adds up the short lists, term by term, into one
list of accumulators.  That list then takes part, with its largest sum as its
bound, in a walk by document over the long lists: lists whose bounds together
stay under the worst held score bring no candidates and are only probed, from
the highest bound down, for candidates that can still get in.  Documents are
walked in ranges, so that each step is one array operation.

Every task keeps an item's best documents over all its segments, which makes its
bound rise; only those meet.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import ascii_lower
from mnemo.sources.durable import durable

#: A term: a run of digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of item and term that go to the tasks at once.
BLOCK_TERMS = 500_000
#: Documents whose lists a task holds at once, and about how many postings.
SEGMENT, SEGMENT_POSTINGS = 8_192, 2_000_000
#: Lists of up to so many documents are added up first, the others walked in ranges of so many documents.
SHORT, RANGE = 256, 2_048

#: Bytes of UTF-8 to blanks, letters A-Z to small ones, the rest as it is.
_BYTES = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _counted(wanted: list[str]):
    """Per document: n, and the numbers and counts of those of its terms that are ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(wanted)}
        for batch in batches:
            lengths, found, counts, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                own = text.as_py().translate(_BYTES).split()
                held = [(number[t], c) for t, c in Counter(own).items() if t in number]
                lengths.append(len(own))
                found += [t for t, _ in held]
                counts += [c for _, c in held]
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Segment:
    """Posting lists of some documents, numbered in order of doc_id."""

    def __init__(self, ids: np.ndarray, last: np.ndarray, n: np.ndarray, sizes: np.ndarray, found: np.ndarray, counts: np.ndarray, n_docs: int, n_words: int):
        order = np.lexsort((ids, last))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.last = ids[order], last[order]
        m = 100 - 50 + (50 * n * n_docs) // n_words
        docs = np.repeat(place, sizes)
        impact = (1_000_000_000 * counts) // (1000 * counts + 20 * np.repeat(m, sizes))
        by = np.lexsort((docs, found))
        self.docs, self.impact = docs[by], impact[by]
        self.terms, self.first = np.unique(found[by], return_index=True)
        self.end = np.append(self.first[1:], len(by))
        self.best = np.maximum.reduceat(self.impact, self.first) if len(by) else np.empty(0, np.int64)

    def lists(self, wanted: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, weight) of the lists that there are for ``wanted`` terms of positive weight."""
        at = np.searchsorted(self.terms, wanted)
        there = (at < len(self.terms)) & (weight > 0)
        there[there] = self.terms[at[there]] == wanted[there]
        return at[there], weight[there]


class Best:
    """The best documents of an item so far: highest score, then smallest doc_id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.last = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def bar(self) -> int:
        """What a score has to reach; at it the doc_id decides."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, last: np.ndarray) -> None:
        score, ids, last = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.last, last)))
        order = np.lexsort((ids, last, -score))[: self.k]
        self.score, self.ids, self.last = score[order], ids[order], last[order]


def search(segment: Segment, wanted: np.ndarray, weight: np.ndarray, best: Best, short: int = SHORT, wide: int = RANGE) -> int:
    """Adds a segment's documents to ``best``; returns how many candidates were looked at."""
    at, weight = segment.lists(wanted, weight)
    first, end = segment.first[at], segment.end[at]
    lists, bounds = [], []
    brief = end - first <= short
    if brief.any():
        sums = np.zeros(len(segment.ids), np.int64)
        for a, b, w in zip(first[brief], end[brief], weight[brief], strict=True):
            sums[segment.docs[a:b]] += w * segment.impact[a:b]
        docs = np.flatnonzero(sums)
        if len(docs):
            lists.append((docs, sums[docs], 1))
            bounds.append(int(sums.max()))
    for k in np.flatnonzero(~brief):
        lists.append((segment.docs[first[k] : end[k]], segment.impact[first[k] : end[k]], int(weight[k])))
        bounds.append(int(weight[k] * segment.best[at[k]]))
    order = np.argsort(bounds, kind="stable")
    lists, upto = [lists[k] for k in order], np.cumsum([bounds[k] for k in order]).tolist()
    seen = 0
    for low in range(0, len(segment.ids), wide):
        bar = best.bar
        weak = 0  # lists whose bounds together stay under the bar
        while weak < len(lists) and upto[weak] < bar:
            weak += 1
        if weak == len(lists):
            break
        score = np.zeros(min(wide, len(segment.ids) - low), np.int64)
        for docs, impact, w in lists[weak:]:
            a, b = np.searchsorted(docs, (low, low + wide))
            score[docs[a:b] - low] += w * impact[a:b]
        alive = np.flatnonzero(score)
        score = score[alive]
        seen += len(alive)
        for k in range(weak - 1, -1, -1):
            able = score + upto[k] >= bar
            alive, score = alive[able], score[able]
            if not len(alive):
                break
            docs, impact, w = lists[k]
            near = np.searchsorted(docs, alive + low)
            hit = near < len(docs)
            hit[hit] = docs[near[hit]] == alive[hit] + low
            score[hit] += w * impact[near[hit]]
        able = score >= bar
        if able.any():
            best.add(score[able], segment.ids[alive[able] + low], segment.last[alive[able] + low])
    return seen


def _ranked(items: list[tuple[int | None, np.ndarray, np.ndarray]], n_docs: int, n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[tuple[np.ndarray, ...]] = []

        def search_held() -> None:
            segment = Segment(*[np.concatenate(x) for x in zip(*held, strict=True)], n_docs, n_words)
            for (_, wanted, weight), b in zip(items, best, strict=True):
                search(segment, wanted, weight, b)
            held.clear()

        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            found, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            last = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            a = 0
            while a < len(ids):  # a segment's postings stay bounded, however long texts are
                b = min(len(ids), a + SEGMENT, max(a + 1, int(np.searchsorted(ends, ends[a] + SEGMENT_POSTINGS))))
                held.append((ids[a:b], last[a:b], n[a:b], np.diff(ends[a : b + 1]), found[ends[a] : ends[b]], counts[ends[a] : ends[b]]))
                if sum(len(h[0]) for h in held) >= SEGMENT or sum(len(h[4]) for h in held) >= SEGMENT_POSTINGS:
                    search_held()
                a = b
        if held:
            search_held()
        for (item, _, _), b in zip(items, best, strict=True):
            if len(b.score):
                ids = pa.array(b.ids, pa.int64(), mask=b.last)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(b.score, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text).

    A term counts once in an item; rows of one item_id, a null one too, are one
    item.  Null and empty texts have no terms: such documents are in no result
    and no count, such items get no rows.  Equal scores go by doc_id, null last;
    repeated documents are ranked each.  Without documents or items the result is
    empty.  Further columns do not come back.

    Items go to the tasks in blocks of ``block_terms`` terms; each block reads
    the documents once and is written before the next one begins.
    """
    pairs = durable(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct())
    blocks = max(1, -(-pairs.count() // block_terms))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    best = None
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        wanted = sorted({r["term"] for r in part})
        counted = durable(source.mapInArrow(_counted(wanted), "doc_id long, n long, terms array<int>, counts array<long>").where("n > 0"))
        n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(wanted), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most the block's terms
            weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        number = {t: i for i, t in enumerate(wanted)}
        own: dict[int | None, list[int]] = {}
        for r in part:
            own.setdefault(r["item_id"], []).append(number[r["term"]])
        asked = [(item, np.array(sorted(t), np.int64), weight[sorted(t)]) for item, t in own.items()]
        found = durable(counted.mapInArrow(_ranked(asked, n_docs, n_words, k), "item_id long, doc_id long, score long"))
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
     sized AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
     corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sized),
     tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
     items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
     scored AS (
        SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
        FROM items JOIN w USING (term) JOIN tf USING (term) JOIN sized USING (r), corpus GROUP BY item_id, r),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
