"""Hybrid retrieval: reciprocal rank fusion of full text and vectors, re-scored by late interaction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as text_ops
from . import vector as vector_ops

RRF, OVERSAMPLE, TOKEN_DIM = 60, 4, 32


def fused(text_hits: DataFrame | None, vector_hits: DataFrame | None, key: str, k: int, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """key and score: the sum of weight / (60 + rank) over the two lists (key, rank), best first, ties by key."""
    lists = [(h, w) for h, w in ((text_hits, weights[0]), (vector_hits, weights[1])) if h is not None]
    parts = [h.select(key, (F.lit(w) / (RRF + F.col("rank"))).alias("part")) for h, w in lists]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(k)


def search(df: DataFrame, key: str, k: int, text: str | None = None, column: str | None = None, vector: Sequence[float] | None = None, embedding: str | None = None, metric: str = "l2", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Each way gives 4k candidates; without a text, or without a vector, the other alone."""
    if text is None and vector is None:
        raise ValueError("a text or a vector is needed")
    n, hits = OVERSAMPLE * k, [None, None]
    if text is not None and column:
        top = text_ops.bm25(df, column, text, key).orderBy(F.desc("score"), key).limit(n)
        hits[0] = top.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))  # over n rows
    if vector is not None and embedding:
        top = vector_ops.knn(df.select(key, embedding), embedding, vector, n, metric, key)
        hits[1] = top.select(key, F.row_number().over(Window.orderBy("distance", key)).alias("rank"))
    return fused(hits[0], hits[1], key, k, weights)


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def token_vector(token: str) -> list[float]:
    seed = vector_ops.fnv1a(token.encode())
    v = [(_splitmix((seed + i) & 0xFFFFFFFFFFFFFFFF) & 255) / 127.5 - 1 for i in range(TOKEN_DIM)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def maxsim(query: str, document: str | None) -> float:
    """For each query word its best likeness to a word of the document, summed."""
    q, d = query.split(), (document or "").split()
    if not q or not d:
        return 0.0
    vectors = [token_vector(w) for w in set(d)]
    return sum(max(sum(a * b for a, b in zip(token_vector(w), v)) for v in vectors) for w in q)


def rescored(hits: DataFrame, df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """The k hits of a search in order of maxsim, ties by key: a join of k rows, scored by an Arrow UDF."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: maxsim(query, t))

    return df.join(F.broadcast(hits), key).select(key, "score", score(F.col(column)).alias("maxsim")).orderBy(F.desc("maxsim"), key)
