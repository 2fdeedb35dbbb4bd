"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position
its output links name all pieces that end there, and the best way to reach the
position is kept.  For unigram models the best is the highest sum of scores.
For BPE models (the file here) a score says which merge comes first, not how
likely a piece is, and the sum of scores gives other pieces than the library;
there, a piece may follow another exactly if merging their joined text gives
back these two, and exactly one piece can end at each position that the
encoding reaches.
"""

from __future__ import annotations

import array
import functools
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from sentencepiece import sentencepiece_model_pb2 as proto

BLANK = "▁"
#: Judged pairs, and characters of encoded chunks, kept by a worker; it starts anew beyond. Results never depend on it.
CACHE, CACHE_CHARS = 200_000, 4_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Known(dict):
    """Chunks and their ids; a chunk that is not there is encoded when asked for."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]) -> None:
        self.encode = encode
        self.held = 0

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        # a chunk counts for more than its characters, so short ones are bounded too
        self.held += len(chunk) + 16
        if self.held > CACHE_CHARS:
            self.clear()
            self.held = len(chunk) + 16
        self[chunk] = ids = self.encode(chunk)
        return ids


class Pieces:
    """A model file's pieces.  Its text rules must be: as it is, a blank put before, blanks kept."""

    def __init__(self, path: str) -> None:
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("a model with text rules that are not handled here")
        self.bpe = model.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        if {USER, UNUSED} & set(self.kind):
            raise ValueError("a model with user-defined or unused pieces, which are not handled here")
        self.score = [p.score for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.characters = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        self.plain = re.compile(f"[{''.join(map(re.escape, sorted(self.characters)))}]*").fullmatch
        self.longest_run = max((len(p) for p in self.id if not p.strip(BLANK)), default=1)
        #: A chunk is what no piece crosses: blanks and the word after them, or its parts if letters never share a piece with other marks.
        odd = "".join(re.escape(c) for c in sorted(self.characters) if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha())
        apart = re.compile(rf"{BLANK}*(?:[^\W\d_{BLANK}{odd}]+|(?:[^\w{BLANK}]+|[\d_{odd}]+)+)|{BLANK}+").findall
        coarse = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        crossed = lambda split: any(len(split(p)) > 1 for p in self.id)
        self.chunks = apart if not crossed(apart) else coarse if not crossed(coarse) else lambda text: [text]
        self.plain_ids = np.array([k == NORMAL for k in self.kind])
        self.byte_ids = np.array([k == BYTE for k in self.kind])
        self.known = Known(self.chunk)
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}

    # merges of BPE models

    def merged(self, text: str) -> list[str]:
        """The symbols of a short text by merging the best pair again and again; the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            joined = [self.id.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
            best = max((self.score[i] for i in joined if i is not None), default=None)
            if best is None:
                break
            at = next(k for k, i in enumerate(joined) if i is not None and self.score[i] == best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def edge(self, i: int) -> tuple[list, list]:
        """The symbols at the right and at the left end of a piece while it is merged, each with its merge's score."""
        if i not in self.edges:
            symbols, right, left = list(self.pieces[i]), [], []
            while True:
                joined = [self.id.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
                best = max((self.score[j] for j in joined if j is not None), default=None)
                if best is None:
                    right.append((symbols[-1], -np.inf))
                    left.append((symbols[0], -np.inf))
                    break
                at = next(k for k, j in enumerate(joined) if j is not None and self.score[j] == best)
                if at + 2 == len(symbols):
                    right.append((symbols[-1], best))
                if at == 0:
                    left.append((symbols[0], best))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.edges[i] = right, left
        return self.edges[i]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges of the text of ``a`` and ``b`` end in these two: no merge over their border comes first."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            (right, left), x, y, apart = (self.edge(a)[0], self.edge(b)[1]), 0, 0, True
            while apart:
                (s, s_score), (t, t_score) = right[x], left[y]
                over = self.id.get(s + t)
                if over is not None and self.score[over] > s_score and self.score[over] >= t_score:
                    apart = False
                elif x + 1 == len(right) and y + 1 == len(left):
                    break
                elif s_score >= t_score:
                    x += 1
                else:
                    y += 1
            self.pairs[key] = apart
        return self.pairs[key]

    # the single pass

    def path(self, text: str) -> list[int]:
        """Pieces of a text of known characters, by the best piece that ends at each position."""
        n = len(text)
        came: list[int | None] = [None] * (n + 1)
        came[0] = -1
        if self.bpe:
            judged = self.pairs.get
            for end, (i, length) in self.automaton.iter(text):
                # no second piece can end where one does
                if came[end + 1] is None and (last := came[end + 1 - length]) is not None:
                    if last < 0 or (known if (known := judged(last << 32 | i)) is not None else self.follows(last, i)):
                        came[end + 1] = i
        else:
            sums = [0.0] + [-np.inf] * n
            for end, (i, length) in self.automaton.iter(text):
                if (total := sums[end + 1 - length] + self.score[i]) > sums[end + 1]:
                    sums[end + 1], came[end + 1] = total, i
        out, at = [], n
        while at > 0 and (i := came[at]) is not None:
            out.append(i)
            at -= self.size[i]
        if at:  # merges whose order is not that of their scores: done one by one
            return [self.id[s] for s in self.merged(text)]
        return out[::-1]

    def blanks(self, n: int) -> list[int]:
        """A run of blanks: merges of equal score go from the left."""
        full, rest = divmod(n, self.longest_run)
        return [self.id[BLANK * self.longest_run]] * full + [self.id[s] for s in self.merged(BLANK * rest)]

    def chunk(self, text: str) -> tuple[int, ...]:
        word = text.lstrip(BLANK)
        runs = len(text) - len(word)
        out: list[int] = []
        if self.bpe and (runs > 1 or not word):
            # pieces of blanks have the lowest score, so the word takes its blank first
            body = self.chunk(BLANK + word) if word else ()
            alone = bool(body) and self.pieces[body[0]] != BLANK
            return (*self.blanks(runs - 1 if alone else runs), *(body if alone or not body else body[1:]))
        if self.plain(text):
            return tuple(self.path(text))
        for part in self.segments(text):
            if part[0] in self.characters:
                out += self.path(part)
            else:
                out += [self.bytes[b] for b in part.encode()] if self.bytes else [self.unknown]
        return tuple(out)

    def segments(self, text: str) -> list[str]:
        """Runs of known characters, and each other character by itself (a run of them without byte pieces)."""
        out: list[str] = []
        was = None
        for c in text:
            now = c in self.characters
            if out and now == was and (now or not self.bytes):
                out[-1] += c
            else:
                out.append(c)
            was = now
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.chunks(BLANK + text.replace(" ", BLANK)))))

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        if self.plain_ids[ids].all() if len(ids) else True:
            return self.decode_plain(ids)
        raw = b"".join(
            bytes([int(self.pieces[i][1:-1], 16)]) if self.kind[i] == BYTE else self.pieces[i].encode() if self.kind[i] == NORMAL else b" \xe2\x81\x87 " if i == self.unknown else b""
            for i in ids
        )
        return self.shown(raw.decode(errors="replace"))

    def decode_plain(self, ids: list[int]) -> str:
        """The same for ids of ordinary pieces only."""
        return self.shown("".join(map(self.pieces.__getitem__, ids)))

    def shown(self, text: str) -> str:
        text = text.replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@functools.cache
def pieces(name: str) -> Pieces:
    return Pieces(public_tokenizers.path(name))


ENCODED = "ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean"


def encode(text: Column, name: str = "piece_bpe_32k.model") -> Column:
    """A struct for each whole text: ids, their number, how many are bytes, and whether decoding gives the text back.

    Null and empty texts have no ids.  A text with the character U+2581 is the
    one kind that does not come back: it decodes to a blank, as in the library.
    """

    @arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(name)
        for texts in batches:
            flat, ends, n_bytes, back = array.array("i"), [0], [], []
            for value in texts:  # one Python string at a time
                t = value.as_py() or ""
                ids = model.encode(t)
                ids_array = np.array(ids, np.int32)
                plain = bool(model.plain_ids[ids_array].all())
                flat.extend(ids)
                ends.append(len(flat))
                n_bytes.append(0 if plain else int(model.byte_ids[ids_array].sum()))
                back.append((model.decode_plain(ids) if plain else model.decode(ids)) == t)
            offsets = np.array(ends, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            columns = [lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(n_bytes, pa.int64()), pa.array(back, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["ids", "n_tokens", "n_byte_tokens", "round_trip"])

    return run(text)


def decode(ids: Column, name: str = "piece_bpe_32k.model") -> Column:
    """The text of each list of ids, null for null."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(name)
        for lists in batches:
            yield pd.Series([None if x is None else model.decode(list(x)) for x in lists], dtype=object)

    return run(ids)


def encoded(docs: DataFrame, text: str = "text", name: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with the fields of ``encode``; its columns of the same names are replaced. An empty table gives an empty one."""
    made = ["ids", "n_tokens", "n_byte_tokens", "round_trip"]
    held = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*held, encode(F.col(text), name).alias("_e")).select(*held, "_e.*")
