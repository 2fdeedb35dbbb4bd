"""Functions a caller can replace: embeddings and rerankers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mnemo.functions.text import bm25_tokens


def embed(text: Column, dim: int = 64) -> Column:
    """A unit vector of token counts by hash; the default for a caller's ``Series[str] -> Series[list[float]]``."""

    @pandas_udf("array<float>")
    def vectors(tokens: pd.Series) -> pd.Series:
        def one(words: list | None) -> list | None:
            if words is None:
                return None
            v = np.bincount([xxhash.xxh64_intdigest(w) % dim for w in words], minlength=dim).astype(np.float64) if len(words) else np.zeros(dim)
            return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).tolist()

        return tokens.map(one)

    return vectors(bm25_tokens(text))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: share of a query's words that a text has."""
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))
