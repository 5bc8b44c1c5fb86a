"""Texts to vectors by a model that the caller brings; the default one hashes words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

# fixed value: what the usual model wants before a question
INSTRUCTION = "Represent this sentence for searching relevant passages: "


class Hashing:
    """Signed feature hashing of words.  A word is a run of a-z and 0-9 after A-Z are lower-cased; the first eight hexadecimal digits of its MD5 say
    which component it adds to, the ninth, if odd, that it takes away."""

    def __init__(self, dimension: int = 128):
        self.dimension, self.known = dimension, {}

    def place(self, word: str) -> tuple[int, int]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            digits = hashlib.md5(word.encode()).hexdigest()
            found = self.known[word] = (int(digits[:8], 16) % self.dimension, -1 if int(digits[8], 16) % 2 else 1)
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                i, sign = self.place(word)
                row[i] += sign
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def embed(text: Column, model: Callable[[], object] = Hashing, kind: str = "float", batch: int = 256) -> Column:
    """The vector of each text at length 1, array<``kind``>.

    ``model`` makes an object with ``encode(list of str) -> matrix``; it is made once for each task that runs, and asked for ``batch`` texts at a time.
    A null or empty text is encoded as an empty one; a vector of zeros stays.
    """

    @F.pandas_udf(f"array<{kind}>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for s in series:
            texts = s.fillna("").tolist()
            found = [unit(np.asarray(own.encode(texts[i : i + batch]), np.float64)) for i in range(0, len(texts), batch)]
            yield pd.Series([v for m in found for v in m])

    return run(text)


def embed_documents(docs: DataFrame, text: str = "text", out: str = "embedding", **how) -> DataFrame:
    """``docs`` with a vector for each text, asked without a prefix.  An empty table stays one."""
    return docs.withColumn(out, embed(F.col(text), **how))


def embed_queries(queries: DataFrame, text: str = "query", out: str = "query_vector", prefix: str = INSTRUCTION, blank: str = "error", **how) -> DataFrame:
    """``queries`` with a vector for each, of the prefix and the text without white space at its ends.  A query that is null or has nothing else is refused:
    an error when the rows are computed, or, with ``blank`` "null", a null vector."""
    stripped = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    if blank == "error":
        asked = F.when(stripped != "", F.concat(F.lit(prefix), stripped)).otherwise(F.raise_error(F.lit("a query must not be blank")))
        return queries.withColumn(out, embed(asked, **how))
    return queries.withColumn(out, F.when(stripped != "", embed(F.concat(F.lit(prefix), stripped), **how)))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, ranges: Column | None = None, key: str = "chunk_id", text: str = "text", query: str = "query_id", asked: str = "query", **how) -> DataFrame:
    """Questions in words to hits: query, key, rank, distance, similarity, text_preview and the rows' other columns.

    rows: key, text, embedding and what the filters name.  ``where`` filters before ranking.  ``ranges`` filters afterwards, from the ``pool_size`` nearest,
    as an index that can't filter by ranges would: fewer than k may be found.  A blank question finds nothing.  Ranks count without gaps after filters.
    """
    asks = embed_queries(queries, asked, blank="null", **how).where("query_vector is not null").select(query, "query_vector")
    kept = rows if where is None else rows.where(where)
    pool = vectors.pool_size(k, kept.count()) if ranges is not None else None
    near = vectors.knn(kept, asks, k, ranges, pool, key=key, query=query) if pool != 0 else vectors.knn(kept.limit(0), asks, k, key=key, query=query)
    found = near.join(rows.drop("embedding"), key)
    return found.select(query, key, "rank", F.round(1 - F.col("similarity"), 6).alias("distance"), "similarity", F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("text_preview"), *(c for c in rows.columns if c not in (key, text, "embedding")))
