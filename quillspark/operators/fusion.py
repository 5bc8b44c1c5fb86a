"""Merging keyword and vector hits, and reranking by several criteria."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

RRF_K, VECTOR_SHARE, KEYWORD_SHARE = 60, 0.7, 0.3
WEIGHTS = {"relevance": 0.6, "recency": 0.25, "authority": 0.15}
HALF_LIFE = 8
GUARD = 10
# fixed values: standing of journals
AUTHORITY = {
    "nature": 1.0, "science": 1.0, "cell": 1.0, "new england journal of medicine": 1.0, "nejm": 1.0, "the lancet": 1.0, "lancet": 1.0, "jama": 0.95, "nature medicine": 0.95,
    "bmj": 0.9, "annals of internal medicine": 0.9, "plos medicine": 0.75, "circulation": 0.8, "scientific reports": 0.6, "plos one": 0.55,
}


def merge(vector: DataFrame, keyword: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Hits of either path: vector has similarity and rank, keyword has score and rank; n_sources and sources say which.  Where hits carry a text, ``hit_text`` is
    the keyword path's, or else the vector path's."""
    texts = [(side.columns.count("text") > 0, name) for side, name in ((vector, "_vector_text"), (keyword, "_keyword_text"))]
    v = vector.select(query, key, F.col("similarity").alias("vector_score"), F.col("rank").alias("vector_rank"), *([F.col("text").alias("_vector_text")] if texts[0][0] else []))
    k = keyword.select(query, key, F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"), *([F.col("text").alias("_keyword_text")] if texts[1][0] else []))
    both = v.join(k, [query, key], "full_outer")
    have = [name for has, name in reversed(texts) if has]
    both = both.withColumn("hit_text", F.coalesce(*have)).drop(*have) if have else both
    return both.withColumns(paths())


def paths() -> dict[str, Column]:
    """Which paths found a merged hit, and how many."""
    by_vector, by_keyword = F.col("vector_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    return {"sources": F.array_compact(F.array(F.when(by_vector, "vector"), F.when(by_keyword, "keyword"))), "n_sources": by_vector.cast("int") + by_keyword.cast("int")}


def steps(df: DataFrame, each: list[dict[str, Column]]) -> DataFrame:
    """``df`` with the columns of one step after the other.  Columns can be made once and serve many tables."""
    for columns in each:
        df = df.withColumns(columns)
    return df


def fuse(merged: DataFrame, strategy: str, query: str = "query_id", key: str = "chunk_id", k: int | None = None) -> DataFrame:
    """fused_score and fused_rank; ties keep vector hits by rank, then keyword hits by rank.

    simple: the number of paths, then both scores.  rrf: sums of 1 / (60 + rank).  weighted: 0.7 x similarity + 0.3 x
    keyword score, scaled to 0..1 over the query's hits; without a range it is 0.  Ranks look at GUARD digits, the result has 6.
    """
    ranked = steps(merged, fusing(strategy, query, key))
    return ranked.where(F.col("fused_rank") <= k) if k else ranked


def fusing(strategy: str, query: str = "query_id", key: str = "chunk_id") -> list[dict[str, Column]]:
    """The steps of ``fuse``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    place = F.coalesce(F.col("vector_rank"), F.lit(1_000_000) + F.col("keyword_rank"))
    if strategy == "simple":
        score, order = F.col("n_sources").cast("double"), [F.desc("fused_score"), F.desc(zero("vector_score")), F.desc(zero("keyword_score"))]
    elif strategy == "rrf":
        score, order = F.coalesce(1.0 / (RRF_K + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("keyword_rank")), F.lit(0.0)), [F.desc("fused_score")]
    elif strategy == "weighted":
        every = Window.partitionBy(query)
        low, high = F.min("keyword_score").over(every), F.max("keyword_score").over(every)
        scaled = F.coalesce((F.col("keyword_score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        score, order = VECTOR_SHARE * zero("vector_score") + KEYWORD_SHARE * scaled, [F.desc("fused_score")]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order, place, key))
    return [{"fused_score": F.round(score, GUARD)}, {"fused_rank": rank}, {"fused_score": F.round("fused_score", 6)}]


def recency(year: Column, now: int) -> Column:
    """Half after HALF_LIFE years; 0.5 if the year is missing or not positive; no more than 1."""
    age = F.greatest(F.lit(0), F.lit(now) - year)
    return F.when(year > 0, F.pow(F.lit(0.5), age / HALF_LIFE)).otherwise(0.5)


def authority(journal: Column, table: dict[str, float] | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for pair in (table or AUTHORITY).items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(journal))), F.lit(0.5))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scored(query: Column, text: Column, model: Callable[[], object], most: int = 512, batch: int = 32) -> Column:
    """Relevance by a model of pairs: the sigmoid of its score.  ``model`` makes an object with ``predict(list of (query, text)) -> scores``, once for each task;
    it is asked for ``batch`` pairs at a time, and of a text it sees ``most`` words."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = model()
        for q, t in parts:
            pairs = list(zip(q.fillna("").tolist(), t.fillna("").tolist()))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in own.predict(pairs[i : i + batch])], dtype=float)

    return sigmoid(run(query, F.array_join(F.slice(words(text), 1, most), " ")))


def rerank(hits: DataFrame, now: int, relevance: Column, weights: dict | None = None, table: dict[str, float] | None = None, query: str = "query_id", k: int | None = None) -> DataFrame:
    """final_score and final_rank from relevance, recency (pub_year) and authority (journal); ties keep the fused order."""
    out = steps(hits, reranking(now, relevance, weights, table, query))
    return out.where(F.col("final_rank") <= k) if k else out


def reranking(now: int, relevance: Column, weights: dict | None = None, table: dict[str, float] | None = None, query: str = "query_id") -> list[dict[str, Column]]:
    """The steps of ``rerank``."""
    w = WEIGHTS | (weights or {})
    parts = {"relevance": relevance, "recency": recency(F.col("pub_year"), now), "authority": authority(F.col("journal"), table)}
    final = sum((w[name] * c for name, c in parts.items()), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("final_score"), "fused_rank"))
    scores = {f"{name}_score": F.round(c, 6) for name, c in parts.items()}
    return [scores | {"final_score": F.round(final, GUARD)}, {"final_rank": rank}, {"final_score": F.round("final_score", 6)}]
