"""Removal of passages that occur more than once, byte-exact.

A byte goes when it lies in a string of ``length`` bytes that also starts
somewhere else.  Sorting all suffixes of a corpus is out of reach, so suffixes
are sorted only where a repeat can begin:

1. Every window of ``length`` bytes owns one anchor, its ``grain``-byte string
   of smallest hash (leftmost among equals).  Equal windows own equal anchors
   at equal offsets, so only windows of equal anchors can be equal.  An anchor
   row stands for a run of windows and carries a digest of all their bytes.
2. Anchors are counted by that digest (BLAKE2, 128 bits, for which no two
   strings with one digest are known, so that it stands for the bytes).  Runs
   found twice are repeats as a whole; runs whose anchor occurs once are none.
   What is left are runs that share an anchor with a different run: the edges
   of repeats.
3. Their bytes are brought together in groups of bounded size.  In each, the
   strings right and left of the anchors are sorted by a merge sort whose
   comparisons find the common extension by binary search over prefix
   polynomial hashes; neighbours' extensions are verified byte by byte.  Two
   windows at one offset are equal when no shorter extension lies between
   them in either order.
4. An anchor with very many runs is dealt out over several groups.  Windows
   that meet no equal in their group are then counted over all groups by hash.

Documents with one text are one text with copies.  Nothing is dealt by a key
that grows with the number of copies but for counts, which are combined before
they move, and joins whose hot keys Spark may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mnemo.sources.durable import durable

LENGTH, GRAIN = 200, 50
#: Positions in a piece of text fit in so many bits beside a hash.
PIECE_BITS = 20
#: Runs in one group on average, and of one anchor in a group at most.
GROUP_RUNS, ANCHOR_RUNS = 12_000, 20_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes of all prefixes of some bytes; any part's hash follows from two of them."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data)
        up, down = self._cache.get(which, (np.zeros(0), np.zeros(0)))
        if len(up) <= n:
            size = max(1 << 16, n + n // 8 + 1)
            base = int(_BASES[which])
            self._cache[which] = up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        self.down = down
        self.prefix = np.zeros(n + 1, np.uint64)
        own = self.prefix[1:]
        own[:] = data
        own += np.uint64(1)
        own *= up[:n]
        np.cumsum(own, out=own)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.down[a]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


def runs(data: bytes, length: int = LENGTH, grain: int = GRAIN) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, key, rough) for each run of windows with one anchor.

    ``first`` to ``last`` are window starts, ``key`` is the anchor's hash and
    ``rough`` one of all bytes of the run, equal where they are.
    """
    n, width = len(data), length - grain + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(np.frombuffer(data, np.uint8))
    at = np.arange(n - grain + 1)
    keys = _mixed(hashes.of(at, at + grain))
    mask = np.uint64((1 << PIECE_BITS) - 1)
    step = (1 << PIECE_BITS) - 2 * length
    owners = []
    for low in range(0, n - length + 1, step):
        part = keys[low : min(low + step, n - length + 1) + width - 1]
        least = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < width:
            least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
        owners.append((least & mask).astype(np.int64) + low)
    owner = np.concatenate(owners)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:], len(owner)] - 1
    anchor = owner[first]
    rough = _mixed(hashes.of(first, last + length) + _mixed((last - first).astype(np.uint64)))
    return first, last, anchor, keys[anchor], rough


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, inverse, count) of the different rows of a digest table; half a digest decides unless two rows share it."""
    _, at, back, n = np.unique(found[:, 0], return_index=True, return_inverse=True, return_counts=True)
    if (found[at[back], 1] != found[:, 1]).any():
        _, at, back, n = np.unique(found, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return at, back.ravel(), n


def digests(data: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Two 64-bit columns: the digest of each run's bytes."""
    digest = hashlib.blake2b
    parts = [digest(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


#: What names a text: two hashes of 64 bits each.
TEXT = ["text_id", "text_two"]
ANCHORS = "text_id long, text_two long, anchor long, key long, whole long, second long, n long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows of whole texts; runs that a text has twice or more are one row."""
    for batch in batches:
        parts = []
        for one, two, text in zip(batch["text_id"].to_pylist(), batch["text_two"].to_pylist(), batch["text"], strict=True):
            data = text.as_buffer().to_pybytes()
            first, last, anchor, key, _ = runs(data)
            if len(anchor):
                found = digests(data, first, last)
                at, _, n = distinct(found)
                parts.append((np.full(len(at), one), np.full(len(at), two), anchor[at], key[at].view(np.int64), found[at, 0], found[at, 1], n))
            if len(parts) >= 500:
                yield _batch(parts)
                parts = []
        if parts:
            yield _batch(parts)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], [x.split()[0] for x in ANCHORS.split(", ")])


EDGES = "text_id long, text_two long, spans array<int>, part long, many boolean, bytes binary, first int, place int, single boolean"
#: What is known of an anchor: it occurs once; its run is found once among others; its run is one of several and found more than once.
ALONE, SINGLE, PARTNER = 0, 1, 2


def _edges(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text the spans of whole repeated runs, and the bytes of runs at the edges of repeats."""
        for batch in batches:
            rows: list[tuple] = []
            for one, two, text, n_copies, listed in zip(*[batch[c].to_pylist() for c in TEXT], batch["text"], batch["n_copies"].to_pylist(), batch["listed"], strict=True):
                data = text.as_buffer().to_pybytes()
                first, last, anchor, _, rough = runs(data, length)
                if not len(first):
                    continue
                known = {x["anchor"]: x for x in listed.as_py() or ()}  # one text's list at a time
                code = np.array([known[a]["code"] if a in known else -1 for a in anchor.tolist()])
                # of runs that the text has more than once, one is listed
                _, back, n = np.unique(rough, return_inverse=True, return_counts=True)
                often = n[back] > 1
                if often.any():
                    some = np.flatnonzero(often)
                    _, back, n = distinct(digests(data, first[some], last[some], length))
                    often[some] = n[back] > 1
                full = (code < 0) | (code == PARTNER) | often | (n_copies > 1)
                spans = np.stack([first[full], last[full] + length], 1).astype(np.int32)
                if len(spans):
                    rows.append((one, two, merged(spans).ravel(), None, None, None, None, None, None))
                for i in np.flatnonzero(code > ALONE).tolist():
                    x = known[int(anchor[i])]
                    rows.append((one, two, None, x["part"], x["many"], data[first[i] : last[i] + length], first[i], anchor[i] - first[i], bool(code[i] == SINGLE and n_copies == 1)))
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in EDGES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans with those that touch or overlap joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    start = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[start, 0], reach[np.r_[start[1:], len(spans)] - 1]], 1)


class Sorted:
    """Strings of one buffer (start, size) in order, with the extension each has in common with the one before."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.data, self.start, self.size = data, start, size
        self.hashes = Hashes(data)
        self.reach = int(size.max(initial=0))
        self.order = self._sorted(len(start))
        self.common = np.zeros(len(start), np.int64)
        a, b = self.order[:-1], self.order[1:]
        self.common[1:] = self._extension(a, b)
        self._verify()
        del self.hashes

    def _extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings ``a`` and ``b``, by binary search over hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.size[a], self.size[b])
        sa, sb = self.start[a], self.start[b]
        for _ in range(self.reach.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(sa, sa + middle) == self.hashes.of(sb, sb + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string ``a`` comes before ``b``; a prefix comes first."""
        k = self._extension(a, b)
        end = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[a] + k, end)], self.data[np.minimum(self.start[b] + k, end)]
        ended_a, ended_b = k == self.size[a], k == self.size[b]
        return np.where(ended_a, ~ended_b, ~ended_b & (x < y))

    def _sorted(self, n: int) -> np.ndarray:
        """Merge sort from below: in each round all pairs of runs are merged at once, by each string's place in the other run."""
        order, width = np.arange(n), 1
        while width < n:
            at = np.arange(n)
            pair = at // (2 * width) * (2 * width)
            left = at < pair + width
            low = np.where(left, np.minimum(pair + width, n), pair)
            high = np.where(left, np.minimum(pair + 2 * width, n), np.minimum(pair + width, n))
            base = low.copy()
            for _ in range(width.bit_length() + 1):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                mine, other = order[open_], order[middle]
                # equal strings keep their order: those of the left run come first
                after = np.where(left[open_], self._less(other, mine), ~self._less(mine, other))
                low[open_] = np.where(after, middle + 1, low[open_])
                high[open_] = np.where(after, high[open_], middle)
            own = np.where(left, at - pair, at - pair - width)
            out = np.empty_like(order)
            out[pair + own + low - base] = order
            order, width = out, 2 * width
        return order

    def _verify(self) -> None:
        """Neighbours' extensions byte by byte; where a hash deceived, everything is sorted by its bytes."""
        for k in range(1, len(self.order), 1024):
            a, b = self.order[k - 1 : k + 1023], self.order[k : k + 1024]
            a = a[: len(b)]
            step = np.arange(self.reach)
            end = len(self.data) - 1
            x = self.data[np.minimum(self.start[a][:, None] + step, end)]
            y = self.data[np.minimum(self.start[b][:, None] + step, end)]
            inside = step < self.common[k : k + len(b)][:, None]
            nxt = self.common[k : k + len(b)]
            more = np.minimum(self.size[a], self.size[b]) > nxt
            ahead = np.minimum(nxt, max(self.reach - 1, 0))
            rows = np.arange(len(b))
            if ((x != y) & inside).any() or (more & (x[rows, ahead] >= y[rows, ahead])).any():
                strings = [self.data[s : s + n].tobytes() for s, n in zip(self.start, self.size, strict=True)]
                self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
                for i in range(1, len(strings)):
                    p, q = strings[self.order[i - 1]], strings[self.order[i]]
                    self.common[i] = next((j for j, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
                return

    def classes(self, least: int) -> np.ndarray:
        """A number for each string; equal where two have ``least`` bytes in common (if they are so long)."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < least)
        return out


FOUND = "text_id long, text_two long, a int, b int, one long, two long"


def _resolve(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Repeated windows among the runs of one group, as spans, and the open windows of anchors dealt over several groups."""
        parts = [x.as_buffer().to_pybytes() for x in table["bytes"]]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(parts), np.uint8)
        place, first = table["place"].to_numpy().astype(np.int64), table["first"].to_numpy().astype(np.int64)
        single, many = table["single"].to_numpy(zero_copy_only=False), table["many"].to_numpy(zero_copy_only=False)
        named = [table[c].to_numpy() for c in TEXT]
        right = Sorted(data, begin + place, size - place)
        left = Sorted(data[::-1].copy(), len(data) - begin - place, place)
        hit = np.zeros(len(data), bool)
        open_rows: list[np.ndarray] = []
        n = len(parts)
        for offset in range(int(place.max(initial=0)) + 1):
            # windows that start ``offset`` bytes before the anchor
            member = np.flatnonzero((offset <= place) & (place - offset + length <= size))
            if not len(member):
                continue
            both = right.classes(length - offset)[member] * (n + 1) + left.classes(offset)[member]
            _, head, back, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            got = member[twice & single[member]]
            hit[begin[got] + place[got] - offset] = True
            still = many[member] & np.where(twice, np.isin(np.arange(len(member)), head), True)
            rest = member[still]
            if len(rest):
                open_rows.append(np.stack([rest, place[rest] - offset]))
        starts = np.flatnonzero(hit)
        of = np.searchsorted(begin, starts, side="right") - 1
        where = first[of] + starts - begin[of]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (where[1:] != where[:-1] + 1)]) if len(starts) else starts
        ends = np.r_[new[1:], len(starts)] - 1 if len(starts) else starts
        out = [where[new], where[ends] + length]
        rest, at = np.concatenate(open_rows, 1) if open_rows else np.zeros((2, 0), np.int64)
        low = begin[rest] + at
        one, two = (_mixed(Hashes(data, k).of(low, low + length)).view(np.int64) if len(low) else low for k in (0, 1))
        nothing = pa.nulls(len(new), pa.int64())
        columns = [
            *[pa.array(np.r_[x[of[new]], x[rest]], pa.int64()) for x in named],
            pa.array(np.r_[out[0], first[rest] + at].astype(np.int32)),
            pa.array(np.r_[out[1], first[rest] + at + length].astype(np.int32)),
            pa.chunked_array([nothing, pa.array(one)]).combine_chunks(),
            pa.chunked_array([nothing, pa.array(two)]).combine_chunks(),
        ]
        return pa.Table.from_arrays(columns, [*TEXT, "a", "b", "one", "two"])

    return run


KEPT = "n_removed long, n_spans long, kept_sha256 string, kept string"


def cut(text: Column, spans: Column, with_text: bool = False) -> Column:
    """What is left of a text without its byte spans (a flat list of starts and ends in any order)."""

    @pandas_udf(KEPT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for t, x in zip(texts, lists, strict=True):
                data = (t or "").encode()
                s = merged(np.array(x, np.int64).reshape(-1, 2)) if x is not None and len(x) else np.zeros((0, 2), np.int64)
                ends = np.r_[0, s[:, 1]].tolist()
                kept = b"".join(data[a:b] for a, b in zip(ends, [*s[:, 0].tolist(), len(data)], strict=True))
                rows.append((int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])

    return run(text, spans)


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False, group_runs: int = GROUP_RUNS, anchor_runs: int = ANCHOR_RUNS) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, ``kept``.

    Null and empty texts have no bytes; texts shorter than 200 bytes lose none.
    Repeated rows of at least 200 bytes lose all.  ``kept`` drops the bytes of
    a character cut in two.  Texts are told apart by two 64-bit hashes.  On the
    test tables about five of six removed bytes lie in runs that step 2 finds;
    what is sorted are the edges.  Texts move twice: once with the places of
    their edges, once with the spans found.  Columns of ``docs`` with the added names are replaced; an empty
    table gives an empty one.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", text]
    held = [c for c in docs.columns if c not in made]
    name = [F.xxhash64(whole).alias("text_id"), F.xxhash64(F.lit(7), whole).alias("text_two")]
    named = docs.select(*name, whole.alias("text"))
    texts = named.groupBy(*TEXT).agg(F.first("text").alias("text"), F.count("*").alias("n_copies"))

    anchors = named.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, ANCHORS)
    counted = durable(anchors.groupBy("key", "whole", "second").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in (*TEXT, "anchor")]).drop("whole", "second"))
    shared = counted.groupBy("key").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
    state = counted.join(shared, "key", "left").where("n = 1 or n_runs is not null")
    n_edges = shared.agg(F.coalesce(F.sum("n_runs"), F.lit(0))).first()[0]
    salt = F.pmod(F.xxhash64(*TEXT, "anchor"), F.ceil(F.col("n_runs") / anchor_runs))
    listed = state.select(
        *TEXT,
        F.struct(
            "anchor",
            F.when(F.col("n_runs").isNull(), ALONE).when(F.col("n") == 1, SINGLE).otherwise(PARTNER).alias("code"),
            F.pmod(F.xxhash64("key", salt), F.lit(max(1, -(-n_edges // group_runs)))).alias("part"),
            (F.col("n_runs") > anchor_runs).alias("many"),
        ).alias("x"),
    )
    listed = listed.groupBy(*TEXT).agg(F.collect_list("x").alias("listed"))
    edges = durable(texts.join(listed, TEXT, "left").where(F.octet_length("text") >= LENGTH).mapInArrow(_edges(LENGTH), EDGES))

    found = durable(edges.where("bytes is not null").groupBy("part").applyInArrow(_resolve(LENGTH), FOUND))
    open_ = found.where("one is not null")
    dup = open_.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = found.where("one is null").select(*TEXT, F.array("a", "b").alias("spans"))
    pairs = pairs.unionByName(open_.join(dup, ["one", "two"]).select(*TEXT, F.array("a", "b").alias("spans")))
    spans = edges.where("spans is not null").select(*TEXT, "spans").unionByName(pairs)
    spans = spans.groupBy(*TEXT).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    done = texts.join(spans, TEXT, "left").select(*TEXT, cut(F.col("text"), F.col("spans"), with_text).alias("k")).select(*TEXT, "k.*")
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.octet_length(whole).cast("long").alias("n_bytes"), *name)
    out = rows.join(done, TEXT).drop(*TEXT)
    return out if with_text else out.drop("kept")
