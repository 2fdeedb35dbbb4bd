"""License scans by template markup.

Templates are license wordings with optional regions, ``<<optional>> ...
<</optional>>``, and replaceable ones, ``<<any N>>`` (up to N tokens).  Each is
compiled into a token automaton; a place in a text is accepted when the
mandatory wording matches exactly from there.  Simulation starts only where a
text has a template's first token, in texts that hold one of its rare words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([not (c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) for c in range(256)])

#: Phrases of the base rule and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

GPL_END = (
    " <<any 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details you should have received a copy of the gnu general public license along with <<any 6>> "
    "if not <<optional>>see http www gnu org licenses<</optional>> <<optional>>see https www gnu org licenses<</optional>> "
    "<<optional>>write to the free software foundation inc <<any 12>> usa<</optional>>"
)
BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
BSD_END = (
    "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: label, rare word that every match has, wording (public license texts and notices; fixed values).
TEMPLATES = (
    ("mit", "license", "<<optional>>this <<any 2>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> mit license"),
    ("apache-2.0", "license", "licensed under the <<optional>>terms of the<</optional>> apache license <<optional>>version<</optional>> 2 0"),
    ("gpl-3.0", "license", "<<optional>>this <<any 2>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 3 <<optional>>of the license<</optional>>"),
    ("gpl-2.0", "license", "<<optional>>this <<any 2>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 2 <<optional>>of the license<</optional>>"),
    ("cc-by-nc-4.0", "cc", "licensed under <<optional>>a<</optional>> cc by nc 4 0 <<optional>>license<</optional>>"),
    ("cc-by-sa-4.0", "cc", "licensed under <<optional>>a<</optional>> cc by sa 4 0 <<optional>>license<</optional>>"),
    ("cc-by-4.0", "cc", "licensed under <<optional>>a<</optional>> cc by 4 0 <<optional>>license<</optional>>"),
    ("cc-by-4.0", "attribution", "licensed under a creative commons attribution 4 0 international license"),
    (
        "apache-2.0", "license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-2.0-or-later", "redistribute",
        "<<any 6>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 2 of the license or <<optional>>at your option<</optional>> any later version" + GPL_END,
    ),
    (
        "gpl-3.0-or-later", "redistribute",
        "<<any 6>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or <<optional>>at your option<</optional>> any later version" + GPL_END,
    ),
    (
        "mit", "sublicense",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<any 4>> and associated documentation files "
        "the <<any 2>> to deal in the <<any 2>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the <<any 2>> and to permit persons to whom the <<any 2>> is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the <<any 2>> "
        "the <<any 2>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall <<any 12>> be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the <<any 2>> or the use or other dealings in the <<any 2>>",
    ),
    (
        "isc", "permission",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<any 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<any 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd-2-clause", "redistributions", BSD_START + BSD_END),
    (
        "bsd-3-clause", "redistributions",
        BSD_START + "<<optional>>3<</optional>> neither the name of <<any 12>> nor the names of <<any 6>> contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission " + BSD_END,
    ),
)


class Automaton:
    """A template's states: ``moves[s]`` has (token or None for any, next), ``skips[s]`` the states reached without a token."""

    def __init__(self, label: str, rare: str, wording: str) -> None:
        self.label, self.rare = label, rare.encode()
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.mandatory = 0
        opened: list[int] = []
        at = 0
        for optional, closed, anything, word in re.findall(r"(<<optional>>)|(<</optional>>)|<<any (\d+)>>|([^\s<>]+)", wording):
            if optional:
                opened.append(at)
            elif closed:
                self.skips[opened.pop()].append(at)
            elif anything:
                end = self._state() if not int(anything) else None
                ways = [at]
                for _ in range(int(anything)):
                    step = self._state()
                    self.moves[ways[-1]].append((None, step))
                    ways.append(step)
                end = ways[-1] if end is None else end
                for s in ways[:-1]:
                    self.skips[s].append(end)
                at = end
            else:
                to = self._state()
                self.moves[at].append((word.encode(), to))
                at = to
                self.mandatory += not opened
        self.end = at
        self.start = self.closed({0})
        first = {t for s in self.start for t, _ in self.moves[s]}
        self.first = None if None in first else first

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def step(self, states: frozenset[int], token: bytes) -> frozenset[int]:
        return self.closed({to for s in states for t, to in self.moves[s] if t is None or t == token})

    def match(self, tokens: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at ``start``."""
        states, end = self.start, None
        for k in range(start, len(tokens)):
            states = self.step(states, tokens[k])
            if not states:
                break
            if self.end in states:
                end = k + 1
        return end


@functools.cache
def automata() -> list[Automaton]:
    return [Automaton(*t) for t in TEMPLATES]


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
    data = (text or "").encode().lower()
    if not data:
        return 0, 0, None, None, "", "", 0.0
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    n_words = int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    possible = [a for a in automata() if a.rare in data]
    if not possible and b"license" not in data and not (b"cc" in data and b"by" in data):
        return n_words, 0, None, None, "", "", 0.0
    tokens = _WORD.findall(data)
    places, base = [], set()
    at: dict[bytes, list[int]] = {}
    for i, t in enumerate(tokens):
        at.setdefault(t, []).append(i)
    for phrase, label in PHRASES:
        words = phrase.encode().split()
        found = [i for i in at.get(words[0], ()) if tokens[i : i + len(words)] == words]
        places += found
        base |= {label} if found else set()
    matched, longest = set(), 0
    for a in possible:
        if a.rare in at:
            starts = range(len(tokens)) if a.first is None else (i for t in a.first for i in at.get(t, ()))
            if any(a.match(tokens, i) is not None for i in starts):
                matched.add(a.label)
                longest = max(longest, a.mandatory)
    score = max(0.5 * bool(base), min(1.0, 0.75 + longest / 200) if matched else 0.0)
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | matched)), round(score, 6)


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(text: Column) -> Column:
    """A struct for each whole text: see ``scan``. Null and empty texts have no words and no labels."""
    names = [x.split()[0] for x in SCANNED.split(", ")]

    @pandas_udf(SCANNED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan(t) for t in texts], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fields of ``license_scan``; its columns of the same names are replaced.

    Rows are scanned one by one: repeated rows agree, an empty table gives an empty one.
    """
    made = [x.split()[0] for x in SCANNED.split(", ")]
    held = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*held, license_scan(F.col(text)).alias("_l")).select(*held, "_l.*")
