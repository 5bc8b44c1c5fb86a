"""Exact nearest neighbours by cosine: matrix products of rows with a bounded block of questions, filters before or after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

GUARD = 12  # digits that ranks look at
BLOCK_BYTES = 32 << 20  # questions' vectors that a task holds at once
SLAB = 1 << 22  # cosines that are worked out at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalized(v: Column) -> Column:
    """A vector at length 1, in doubles; a vector of zeros stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``dim`` finite components that aren't all zero, and those vectors at length 1, in doubles."""
    full = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(full)
    flat = (column if len(at) == len(column) and not column.null_count else column.take(pa.array(at))).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
    if not fine.all():
        at, x = at[fine], x[fine]
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x  # so that squares stay in range
    return at, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def exact(q: np.ndarray, x: np.ndarray, ask: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cosines of pairs with GUARD digits, each summed by itself: in a matrix product the last bits depend on where a row stands, so copies needn't tie."""
    step = max(1, SLAB // q.shape[1])
    parts = [(q[ask[i : i + step]] * x[row[i : i + step]]).sum(axis=1) for i in range(0, len(ask), step)]
    return np.round(np.concatenate(parts), GUARD) if parts else np.zeros(0)


def nearest(values: np.ndarray, k: int, floor: np.ndarray, settled=None, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``values`` (questions by candidates, in order of their keys; -inf: no candidate) the k greatest that aren't below ``floor``, which is raised to the k-th:
    question, candidate, value.  ``settled`` gives the final values of pairs, where ``values`` may be off by half of ``slack``."""
    n = values.shape[1]
    kth = np.partition(values, n - k, axis=1)[:, -k] if n > k else values.min(axis=1)
    fine = np.isfinite(kth)
    ask, row = np.nonzero(values >= (np.maximum(floor, np.where(fine, kth, -1e9)) - slack)[:, None])
    value = settled(ask, row) if settled else values[ask, row]
    by = np.lexsort((row, -value, ask))
    ask, row, value = ask[by], row[by], value[by]
    some = np.arange(len(ask)) - np.searchsorted(ask, ask) < k  # those left are the latest of equal ones
    if n >= k:
        np.maximum(floor, np.where(fine, kth, -np.inf), out=floor)
    return ask[some], row[some], value[some]


def _best(asks: pa.Table, k: int, ranges: bool):
    """For each batch of rows the questions' k nearest of the batch that aren't below the k-th best of earlier batches: question, key, similarity, pass."""
    dims = pc.list_value_length(asks.column("v").combine_chunks())
    blocks = []
    for dim in dims.unique().to_pylist():
        if dim:
            part = asks.filter(pc.fill_null(pc.equal(dims, dim), False))
            at, q = matrix(part.column("v").combine_chunks(), dim)
            part = part.take(pa.array(at))
            spans = [part.column(c).fill_null(d).to_numpy() for c, d in (("lo", -(2**62)), ("hi", 2**62))] if ranges else None
            blocks.append((dim, q, part.column("q").combine_chunks(), spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [np.full(len(q), -np.inf) for _, q, _, _ in blocks]
        for batch in batches:
            order = pc.sort_indices(batch.column("key"), null_placement="at_start")  # as ties are settled
            batch = batch.take(order)
            keys, passes = batch.column("key"), batch.column("pass")
            for (dim, q, names, spans), floor in zip(blocks, floors):
                at, x = matrix(batch.column("v"), dim)
                if not len(at):
                    continue
                value = batch.column("value").to_numpy(zero_copy_only=False)[at] if spans else None
                step = max(1, SLAB // len(at))
                for begin in range(0, len(q), step):
                    end = min(begin + step, len(q))
                    near = q[begin:end] @ x.T
                    if spans:
                        lo, hi = (s[begin:end, None] for s in spans)
                        open_ = (lo == -(2**62)) | ((value >= lo) & (value <= hi))
                        near = np.where(open_, near, -np.inf)
                    ask, row, value_ = nearest(near, k, floor[begin:end], lambda i, j, b=begin, q=q, x=x: exact(q, x, i + b, j), 10.0**-GUARD * 4)
                    if len(ask):
                        rows = pa.array(at[row])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(ask + begin)), keys.take(rows), pa.array(value_), passes.take(rows)], names=["q", "key", "similarity", "pass"])

    return run


def asking(asked: list[list[float] | None], query: str = "query_id", vector: str = "query_vector") -> pa.Table:
    """A few questions that the caller holds, numbered from 0, as ``knn`` takes them."""
    return pa.table({query: pa.array(range(len(asked)), pa.int64()), vector: pa.array(asked, pa.list_(pa.float64()))})


def knn(vectors: DataFrame, queries: DataFrame | pa.Table, k: int, where: Column | None = None, pool: int | None = None, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", asked: str = "query_vector", within: tuple[str, str, str] | None = None, digits: int = 6, number: int | None = None) -> DataFrame:
    """The k nearest rows for each query by cosine, ranks from 1: query, key, similarity, rank.

    ``where`` filters before ranking, so nothing is lost.  With ``pool`` the ``pool`` nearest are taken first and
    filtered then, as an index without filters would do; fewer than k may stay (``pool_size`` is the usual choice).  ``within`` (a whole-number column of
    the rows, two of the queries): a query may only have rows whose value is between its two; a query without a first one may have all.

    Queries are a stated set.  They are dealt by hash into blocks of BLOCK_BYTES, mostly one; a block goes to the tasks as a matrix, and each batch of rows
    meets it in a matrix product.  What leaves a task are rows among the k best of its batch and no worse than the k-th of those before; per partition
    and then per query Spark merges them.  Ranks come from cosines of GUARD digits, so that equal vectors tie, to the smaller key; the result has
    ``digits``.  Vectors that are null, zero, of another length or hold null or non-finite components take no part, on either side.  ``number``: how many
    queries there are, where that is known and few, which spares counting them.  A few queries may also come as an Arrow table (``asking``), which
    spares the job that fetches them.
    """
    rows = vectors if pool or where is None else vectors.where(where)
    passed = F.coalesce(where, F.lit(False)) if pool and where is not None else F.lit(True)
    value = [F.col(within[0]).cast("long").alias("value")] if within else []
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), passed.alias("pass"), *value)
    ranges = [F.col(within[1]).cast("long").alias("lo"), F.col(within[2]).cast("long").alias("hi")] if within else []
    key_kind = rows.schema["key"].dataType.simpleString()
    if isinstance(queries, pa.Table):
        blocks, number, asks = 1, queries.num_rows, queries.select([query, asked, *(within or ())[1:]]).rename_columns(["q", "v", "lo", "hi"][: 4 if within else 2])
        query_kind = from_arrow_type(asks.schema.field("q").type).simpleString()
    else:
        asks, width = queries.select(F.col(query).alias("q"), F.col(asked).alias("v"), *ranges), 1
        query_kind = asks.schema["q"].dataType.simpleString()
        if number is None:
            number, width = asks.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        blocks = max(1, -(-number * max(width, 1) * 8 // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        held = asks if isinstance(asks, pa.Table) else (asks.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asks).toArrow()  # BLOCK_BYTES, about
        part = rows.mapInArrow(_best(held, pool or k, bool(within)), f"q {query_kind}, key {key_kind}, similarity double, pass boolean")
        found = part if found is None else found.unionByName(part)
    if number == 1 and not pool:  # one question needs no shuffle: each task's best are merged where the result is read
        found = found.orderBy(F.desc("similarity"), "key").limit(k)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
    if pool:
        found = found.withColumn("_pool", F.row_number().over(order)).where(F.col("_pool") <= pool).where("pass")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query), F.col("key").alias(key), F.round("similarity", digits).alias("similarity"), "rank")


def pool_size(k: int, count: int, most: int = 2000) -> int:
    """How many rows to take before a filter on ranges: ten times as many as asked for, 50 at least, no more than there are or ``most``."""
    return min(max(10 * k, 50), count, most)
