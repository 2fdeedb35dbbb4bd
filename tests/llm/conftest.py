import random

import pytest


@pytest.fixture
def words():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty, blank, long and repeated texts, beside columns with the names that operators add."""
    rows = [(1, None, None), (2, "", "s"), (3, " \n\t ", "s"), (4, "x" * 70_000, None), (5, "word " * 12_000, "t"), (6, "same text", "t"), (6, "same text", "t"), (None, "no id here", "u"), (7, "é中文 😀 Ünïcode\r\nline", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'mine' AS kept", "1 AS n_words", "2 AS n_tokens", "'f' AS feature", "0 AS taken", "'r' AS rule", "'l' AS labels", "9 AS n_removed", "8 AS n_entities", "'x' AS extra")
