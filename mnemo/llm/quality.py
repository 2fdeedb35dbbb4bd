"""Quality rules, line first.

Every line is judged by itself (punctuation, navigation, boilerplate), failing
lines are taken out, and a document goes when it loses too much of its text or
fails the base counts.  One pass of built-in functions over each row: no
shuffle, so nothing depends on how sources or copies are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import WORD

SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)"
#: Runs of the same mark, as in ``word***`` or ``WORD!!``; an ellipsis is none.
MARK_RUN = r"([^\p{L}\p{N}\s.])\1+"
SEPARATORS = r"[|»›•·]|\s[>/]\s"
BOILERPLATE = (
    r"(?i)\b(?:lorem ipsum|javascript|cookie policy|cookie settings|accept (?:all )?cookies|privacy policy"
    r"|terms of (?:use|service)|all rights reserved|subscribe to our|sign up for|log in to|click here"
    r"|read more|share this|skip to (?:main )?content)\b"
)


def line_fails(line: Column, sparse: float = 0.3) -> Column:
    """Whether one line is cut out.

    * punctuation: no sentence ends in it and it has over three words, or runs
      of one mark come with more than ``sparse`` of its words;
    * navigation: three or more separators, at least one for every four words,
      or one to three words without an end of sentence beside a separator;
    * boilerplate: a fixed phrase of web furniture in a line of at most 25 words.
    """
    words = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    ends = line.rlike(SENTENCE_END)
    return (
        (~ends & (words > 3) & (separators > 0))
        | (~ends & (words > 40))
        | (F.regexp_count(line, F.lit(MARK_RUN)) > words * F.lit(sparse))
        | ((separators >= 3) & (separators * 4 >= words))
        | (~ends & (words <= 3) & (separators > 0))
        | ((words <= 25) & line.rlike(BOILERPLATE))
    )


def _repeat_words(docs: DataFrame, span: int) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of ``span`` words found twice or more in the text.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window
    are sorted; their starts, in order, give the number of words covered.
    """
    empty = F.array().cast("array<struct<g:bigint,i:int>>")
    windows = F.transform(
        F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (span - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.col("_hashes")[i + k] for k in range(1, span)]),
    )
    docs = docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_windows", windows)
    docs = docs.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(empty),
    )
    last = F.size("_sorted") - 1
    twice = F.filter(
        "_sorted",
        lambda x, i: ((i > 0) & (F.get("_sorted", i - 1)["g"] == x["g"]))
        | ((i < last) & (F.get("_sorted", i + 1)["g"] == x["g"])),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(-span).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(span), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return docs.withColumn("n_repeat_words", covered)


def judge(docs: DataFrame, text: str = "text", most_lost: float = 0.3, span: int = 5) -> DataFrame:
    """``docs`` with base counts, ``n_lost_words``, ``clean_text``, ``base_failed`` and ``kept``.

    A null text counts as no words, gives a null ``clean_text`` and fails the
    base rule, as does an empty one.  Every row is judged alone: repeated rows
    get equal verdicts and an empty table gives an empty one.  Columns of
    ``docs`` with the names of the added ones are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "clean_text", "base_failed", "kept"]
    held = [c for c in docs.columns if c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*[F.col(f"`{c}`") for c in held]).withColumns({"_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), "_lines": F.split(t, "\n")})
    out = _repeat_words(out, span)
    out = out.withColumn("_full", F.filter("_lines", lambda x: x.rlike(WORD)))
    out = out.withColumn("_failed", F.filter("_full", lambda x: line_fails(x)))
    long = lambda c: c.cast("long")
    out = out.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_symbols": long(F.regexp_count(t, F.lit(SYMBOLS))),
            "n_dup_lines": long(F.size("_full") - F.size(F.array_distinct("_full"))),
            "n_lost_words": F.aggregate("_failed", F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(WORD))),
            "clean_text": F.when(
                F.col(text).isNotNull(),
                F.when(F.size("_failed") == 0, F.col(text)).otherwise(
                    F.array_join(F.filter("_lines", lambda x: ~(x.rlike(WORD) & line_fails(x))), "\n")
                ),
            ),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * F.lit(most_lost)))
    return out.select(*[F.col(f"`{c}`") for c in held], *made)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned text, in the columns of ``docs``."""
    out = judge(docs)
    # the verdict passes through a generator, so that the optimizer doesn't put its whole derivation into the filter
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("clean_text", "kept")], F.inline(F.array(F.struct("clean_text", "kept")))).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
