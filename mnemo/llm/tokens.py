"""Token counts of byte-level BPE vocabularies with word ends.

Pre-tokens that were not met yet are held as one ragged array of symbol ids;
in each round every sequence merges its pair of lowest rank, all sequences at
once, and those without a pair leave with their number of symbols.  Long
sequences, which would take a round for each merge, are merged rank by rank
instead: the places of a rank's pair are kept, and only the neighbours of what
was merged are looked at again.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NONE = np.iinfo(np.int64).max
#: Characters of white space by Unicode's property.
SPACE = "\t-\r \x85\xa0  -     　"
#: Characters of words whose counts a worker keeps; it starts anew beyond. Counts never depend on it.
CACHE = 4_000_000
#: Bytes from which a word is long.
LONG = 256
#: Letters and numbers of Unicode 16 that Python's tables (15) lack, and where lower-case letters lie from those of Unicode 16 and 17 (fixed values).
LATER_LETTERS = "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
LATER_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
#: Characters taken together, so that a batch of long texts needs no more memory than one of short ones.
PART = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Splitter:
    """``findall`` of a pattern whose letters and numbers are those of one version of Unicode, whatever ``regex`` knows."""

    def __init__(self, pattern: str) -> None:
        pattern = pattern.replace(r"\s", SPACE)
        every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        own, odd = {}, set()
        for kind, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)):
            extra = set(re.findall(f"[{later}]", "".join(every)))
            mine = {c for c in every if c in extra or unicodedata.category(c)[0] == kind}
            odd |= mine ^ set(regex.findall(rf"\p{{{kind}}}", "".join(every)))
            own[kind] = ranges(mine)
        exact = pattern
        for kind, chars in own.items():
            exact = exact.replace(rf"\p{{{kind}}}", chars)
        self.fast, self.exact = regex.compile(pattern).findall, re.compile(exact).findall
        self.high = regex.compile(f"[{min(odd, default=chr(0x10FFFF))}-\U0010ffff]").search
        self.odd = re.compile(f"[{ranges(odd)}]").search if odd else lambda text: None

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if self.high(text) and self.odd(text) else self.fast(text)


def ranges(chars: set[str]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks, self.merged = codes[order], order.astype(np.int64), merged
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = Splitter(split["pattern"]["Regex"])
        self.space = regex.compile(f"[{SPACE}]+")
        self.known: dict[str, int] = {}
        self.held = 0

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special strings in it, each one token."""
        parts = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for part in parts:
            # lower() would end words in a final sigma
            part = self.space.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            out += self.split(part if part.isascii() else part.translate(LATER_LOWER))
        return out, len(parts) - 1

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all bytes of some words, and each word's number of them."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(size)
        ids[ends - 1] = self.last[flat[ends - 1]]
        return ids, size

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    def merge_long(self, words: list[str]) -> np.ndarray:
        """As ``merge``, for long words: ranks in order over all of them, each at its places only."""
        ids, size = self.symbols(words)
        n = len(ids)
        owner = np.repeat(np.arange(len(size)), size)
        count = size.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.cumsum(size) - 1] = -1
        before[np.cumsum(size) - size] = -1
        rank = np.full(n, NONE)
        first = np.flatnonzero(after >= 0)
        rank[first] = self.rank(ids[first], ids[first + 1])
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist() if len(at) else (), np.split(at, cuts) if len(at) else (), strict=True):
                if r not in places:
                    heapq.heappush(queue, r)
                places.setdefault(r, []).append(part)

        keep(first)
        while queue:
            r = heapq.heappop(queue)
            at = places.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            # a run of one pair over itself, as in aaa, merges from the left
            begins = np.r_[True, after[at[:-1]] != at[1:]]
            index = np.arange(len(at))
            left = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            right = after[left]
            beyond = after[right]
            ids[left] = self.merged[r]
            after[left] = beyond
            some = beyond >= 0
            before[beyond[some]] = left[some]
            rank[right] = NONE
            np.subtract.at(count, owner[left], 1)
            ahead = before[left]
            near = np.unique(np.concatenate([left, ahead[ahead >= 0]]))
            right = after[near]
            rank[near] = np.where(right >= 0, self.rank(ids[near], ids[right]), NONE)
            keep(near)
        return count

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of symbols left of each word after all merges."""
        ids, size = self.symbols(words)
        owner = np.repeat(np.arange(len(size)), size)
        count = size.copy()
        while len(ids) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.rank(ids[:-1], ids[1:]), NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            length = np.diff(np.r_[starts, len(ids)])
            chosen = (rank == np.repeat(best, length)[:-1]) & (rank < NONE)
            if not chosen.any():
                break
            # a run of one pair over itself, as in aaa, merges from the left
            index = np.arange(len(chosen))
            before = np.maximum.accumulate(np.where(chosen, -1, index))
            chosen &= (index - before) % 2 == 1
            left = np.flatnonzero(chosen)
            ids[left] = self.merged[rank[left]]
            stay = np.ones(len(ids), bool)
            stay[left + 1] = False
            count -= np.bincount(owner[left], minlength=len(count))
            stay &= np.repeat(best < NONE, length)
            ids, owner = ids[stay], owner[stay]
        return count

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        met = set().union(*[w for w, _ in split])
        new = [w for w in met if w not in self.known]
        self.held += sum(map(len, new))
        if self.held > CACHE:
            self.known.clear()
            new, self.held = list(met), sum(map(len, met))
        short = [w for w in new if len(w) < LONG]
        for words, merge in ((short, self.merge), ([w for w in new if len(w) >= LONG], self.merge_long)):
            if words:
                self.known.update(zip(words, merge(words).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, w)) + n for w, n in split]


@functools.cache
def counter(name: str) -> Counter:
    return Counter(public_tokenizers.path(name))


def parts(texts: list[str], most: int = PART) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters; a longer text is a run of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def n_tokens(text: Column, name: str = "word_bpe_49k.json") -> Column:
    """Number of tokens of each whole text, 0 for null; special strings in a text are one token each."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = counter(name)
        for texts in batches:
            whole = [t or "" for t in texts]
            yield pd.Series([n for part in parts(whole) for n in tokenizer.counts(part)], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, text: str = "text", name: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null or empty text has none; rows are counted one by one, so repeated
    rows agree and an empty table gives an empty one.  Columns of ``docs`` with
    these names are replaced.
    """
    held = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = docs.select(*held, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text), name).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
