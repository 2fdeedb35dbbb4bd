"""Porter's stemmer (M. F. Porter, 1980) as column expressions.

Words are stems to their suffixes' rules in five steps; each step looks at the
part before a suffix, its consonant-vowel shape and how often a vowel run is
followed by a consonant run in it.  Meant for vocabularies: stem every
different word once and join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of the algorithm and what stands for them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Shorter and longer words stay as they are.
SHORTEST, LONGEST = 3, 64

#: Latin letters with marks, and what they are without.
MARKED = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0].lower() for c in MARKED)
TOKEN = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case, Latin letters without marks."""
    return F.translate(F.lower(F.translate(text, MARKED, PLAIN)), MARKED, PLAIN)


def stem_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, before stemming."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shape(word: Column) -> Column:
    """``v`` for each vowel (a y after a consonant is one), ``c`` for all else."""
    vowel = lambda seen, c: c.isin("a", "e", "i", "o", "u") | ((c == "y") & (F.right(seen, F.lit(1)) == "c"))
    return F.aggregate(F.split(word, ""), F.lit(""), lambda seen, c: F.concat(seen, F.when(c == "", "").when(vowel(seen, c), "v").otherwise("c")))


def measure(word: Column) -> Column:
    return F.regexp_count(shape(word), F.lit("v+c+"))


def _closed(word: Column) -> Column:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    return shape(word).endswith("cvc") & ~word.rlike("[wxy]$")


def _suffixed(word: Column, suffixes: tuple[str, ...], then: Callable[[Column, Column], Column]) -> Column:
    """``then(part before, suffix)`` of the longest of ``suffixes``, or the word."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    part = F.struct(F.regexp_extract(word, pattern, 1).alias("stem"), F.regexp_extract(word, pattern, 2).alias("suffix"))
    return _let(part, lambda p: F.when(p["suffix"] == "", word).otherwise(then(p["stem"], p["suffix"])))


def _replaced(word: Column, rules: dict[str, str], least: int = 1) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])

    def then(stem: Column, suffix: Column) -> Column:
        new = F.concat(stem, F.try_element_at(table, suffix))
        return F.when(measure(stem) >= least, new).otherwise(F.concat(stem, suffix))

    return _suffixed(word, tuple(rules), then)


def _singular(word: Column) -> Column:
    """A suffix that is the whole word only loses its s."""
    table = F.create_map(*[F.lit(x) for pair in PLURALS.items() for x in pair])
    whole = lambda suffix: F.when(suffix.isin("sses", "ies"), F.substr(suffix, F.lit(1), F.length(suffix) - 1)).otherwise(suffix)
    return _suffixed(word, tuple(PLURALS), lambda stem, suffix: F.when(stem == "", whole(suffix)).otherwise(F.concat(stem, F.try_element_at(table, suffix))))


def _participle(word: Column) -> Column:
    """eed, ed and ing, and what the part before needs then."""

    def mended(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(r"([^aeioulsz])\1$"), F.substr(stem, F.lit(1), F.length(stem) - 1))
            .when((measure(stem) == 1) & _closed(stem), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def then(stem: Column, suffix: Column) -> Column:
        some = F.when(F.contains(shape(stem), F.lit("v")), mended(stem)).otherwise(F.concat(stem, suffix))
        return F.when(suffix != "eed", some).when(stem == "", "e").otherwise(F.concat(stem, F.when(measure(stem) >= 1, "ee").otherwise("eed")))

    return _suffixed(word, ("eed", "ed", "ing"), then)


def _y_to_i(word: Column) -> Column:
    return _suffixed(word, ("y",), lambda stem, suffix: F.concat(stem, F.when(F.contains(shape(stem), F.lit("v")), "i").otherwise(suffix)))


def _bare(word: Column) -> Column:
    def then(stem: Column, suffix: Column) -> Column:
        goes = (measure(stem) >= 2) & ((suffix != "ion") | stem.rlike("[st]$"))
        return F.when(goes, stem).otherwise(F.concat(stem, suffix))

    return _suffixed(word, LAST, then)


def _without_e(word: Column) -> Column:
    def then(stem: Column, suffix: Column) -> Column:
        m = measure(stem)
        return F.when((m >= 2) | ((m == 1) & ~_closed(stem)), stem).otherwise(F.concat(stem, suffix))

    return _suffixed(word, ("e",), then)


def _single_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & (measure(word) >= 2), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def porter(word: Column) -> Column:
    """The stem of a folded word."""
    out = word
    for step in (_singular, _participle, _y_to_i, lambda w: _replaced(w, DOUBLE), lambda w: _replaced(w, SINGLE), _bare, _without_e, _single_l):
        out = _let(out, step)
    return F.when(F.octet_length(word).between(SHORTEST, LONGEST), out).otherwise(word)
