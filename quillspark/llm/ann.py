"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import by_length, stored

_erf = np.vectorize(erf, otypes=[float])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, d) with ``bits`` bits a dimension; d * bits is 62 at most.

    Walks down from the coarsest bit: what a dimension's bit says about orientation is undone by an
    exchange or an inversion of the lower bits against dimension 0, then the Gray code is resolved.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[i] & bit) != 0
            flip = np.where(on, low, (x[0] ^ x[i]) & low)
            x[0] ^= flip
            x[i] ^= np.where(on, 0, flip)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | ((x[i] >> level) & 1)
    return place


def projections(length: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each curve an orthonormal projection (length, dims) and a shift in [0, 1)."""
    rng = np.random.default_rng([seed, length])
    frames = [np.linalg.qr(rng.standard_normal((length, min(dims, length))))[0] for _ in range(curves)]
    return np.stack(frames), rng.random((curves, min(dims, length)))


def _least_ids(most: int):
    """Copies of a vector within a partition become one row with their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[set, object]] = {}
        for batch in batches:
            at = np.sort(np.concatenate([np.zeros(0, np.int64), *(a for a, _ in by_length(batch.column("vec")))]))
            rows = batch.take(pa.array(at))
            for i, (x, a, b) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("id", "h1", "h2")))):
                ids, _ = seen.setdefault((a, b), (set(), rows.column("vec")[i]))
                ids.add(x)
                if len(ids) > 4 * most:
                    for y in sorted(ids)[most:]:
                        ids.remove(y)
        kind = pa.list_(pa.float32()) if not seen else next(iter(seen.values()))[1].type
        keys = list(seen)
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.int64()), pa.array([sorted(seen[k][0])[:most] for k in part], pa.list_(pa.int64())), pa.array([seen[k][1].as_py() for k in part], kind)],
                names=["h1", "h2", "ids", "vec"],
            )

    return run


def _moments(curves: int, dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column("vec")):
                y = np.einsum("nl,cld->ncd", x, projections(x.shape[1], curves, dims, seed)[0])
                new = np.stack((np.full(y.shape[1:], float(len(x))), y.sum(axis=0), (y**2).sum(axis=0)))
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + new
        for length, s in sums.items():
            c, d = (g.ravel() for g in np.indices(s.shape[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), length)), pa.array(c), pa.array(d), *(pa.array(v.ravel()) for v in s)], names=["length", "c", "d", "n", "s", "ss"])

    return run


def _places(curves: int, dims: int, bits: int, seed: int, fitted: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Each class's place on each curve: projected, spread evenly by the normal distribution function, shifted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("cls").to_numpy(zero_copy_only=False)
            for at, x in by_length(batch.column("vec")):
                frames, shifts = projections(x.shape[1], curves, dims, seed)
                mean, deviation = fitted[x.shape[1]]
                for c in range(curves):
                    even = (_erf((x @ frames[c] - mean[c]) / deviation[c] / 2**0.5) / 2 + 0.5 + shifts[c]) / 2
                    place = hilbert(np.clip((even * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1] * curves + c)), pa.array(place), pa.array(ids[at])], names=["curve", "place", "cls"])

    return run


def _rerank(kind: str, k: int):
    """For each block of one partition: the k + 1 nearest classes to each query within its window."""

    def group(rows: pa.Table):
        asks = np.array(rows.column("asks").to_pylist(), bool)
        if not asks.any() or asks.all():
            return
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(asks), -1).astype(np.float64)
        rank, cls, least, width = (rows.column(c).to_numpy() for c in ("rank", "cls", "least", "width"))
        q, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        most = min(k + 1, len(b))
        for q in np.array_split(q, len(q) // 512 + 1):
            asked, other = (x[q] ** 2).sum(axis=1), (x[b] ** 2).sum(axis=1)
            rough = asked[:, None] + other[None] - 2 * x[q] @ x[b].T
            rough[np.abs(rank[q][:, None] - rank[b][None]) > width[q][:, None]] = np.inf
            # whatever may be among the nearest, ties included, whichever way the rough distances were rounded
            limit = np.partition(rough, most - 1, axis=1)[:, most - 1] + 8 * (x.shape[1] + 4) * np.finfo(float).eps * (asked + other.max())
            for i, own in enumerate(q.tolist()):
                some = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
                exact = np.sqrt(((x[b[some]] - x[own]) ** 2).sum(axis=1))
                best = np.lexsort((least[b[some]], exact))[:most]
                yield np.full(len(best), cls[own]), cls[b[some]][best], least[b[some]][best], exact[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        curve, block = rows.column("curve").to_numpy(), rows.column("block").to_numpy()
        order = np.lexsort((block, curve))
        starts = np.flatnonzero(np.concatenate(([True], (curve[order][1:] != curve[order][:-1]) | (block[order][1:] != block[order][:-1]))))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            found = list(group(rows.take(pa.array(order[s:e]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["q", "cls", "least", "score"])

    return run


def nearest(vectors: DataFrame, asks: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, curves: int = 16, dims: int = 4, bits: int = 12, window: float = 0.04, least_window: int = 512, block_rows: int = 4096, seed: int = 11) -> DataFrame:
    """The ``k`` nearest other rows found for each row that ``asks`` holds for: query_id, rank, vec_id, score.

    Each of ``curves`` Hilbert curves orders all vectors by a random orthonormal projection to ``dims``
    dimensions, scaled by means and deviations over all rows, each with its own shift.  A query's window on
    a curve is ``window`` of all rows to either side, ``least_window`` at least, at every size of the table;
    the windows of all curves merge and are reranked by Euclidean distance in double precision on the original
    vectors.  The shares are set for directions without structure, the worst case: on such 64-component
    vectors the recall is over 0.95; see the README.

    Curves are range-partitioned; a row's rank is its index in its partition plus the curve's rows in earlier
    ones.  Orderings are cut into blocks of ``block_rows`` rows, and a query goes to the blocks that its window
    touches, so no group grows with the data.  Copies of a vector are one entry with their k + 1
    least keys, so ties go to the smaller key and many copies don't fill a window.

    Null, zero, null-holding or non-finite vectors and null keys take no part, as query or neighbour;
    vectors of different lengths are never neighbours; rows that repeat a key and vector count once; fewer than k others give
    fewer rows, an empty table none; other columns are ignored.
    """
    kind = stored(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), asks.alias("asks")).where("id is not null and vec is not null")
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(1))})
    least = rows.select("id", "h1", "h2", "vec").mapInArrow(_least_ids(k + 1), f"h1 long, h2 long, ids array<long>, vec {vectors.schema[vector].dataType.simpleString()}")
    least = least.groupBy("h1", "h2").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {k + 1})").alias("ids"), F.first("vec").alias("vec"))
    who = rows.where("asks").select("id", "h1", "h2").distinct()
    marked = least.join(who.select("h1", "h2").distinct().withColumn("asks", F.lit(True)), ["h1", "h2"], "left")
    classes = cut(marked.select("h1", "h2", "ids", "vec", F.coalesce("asks", F.lit(False)).alias("asks"), F.xxhash64("h1", "h2").alias("cls")))

    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sums = classes.select("vec").mapInArrow(_moments(curves, dims, seed), "length long, c long, d long, n double, s double, ss double")
    for r in sums.groupBy("length", "c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect():  # lengths x curves x dims rows
        mean, deviation = fitted.setdefault(r["length"], (np.zeros((curves, min(dims, r["length"]))), np.ones((curves, min(dims, r["length"])))))
        mean[r["c"], r["d"]] = r["s"] / r["n"]
        deviation[r["c"], r["d"]] = max(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2, 0) ** 0.5 or 1

    placed = classes.select("cls", "vec").mapInArrow(_places(curves, dims, bits, seed, fitted), "curve long, place long, cls long")
    placed = placed.repartitionByRange("curve", "place", "cls").sortWithinPartitions("curve", "place", "cls").withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.select("curve", "cls", F.shiftright("at", 33).alias("part"), "at"))
    parts = placed.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = parts.withColumn("shift", F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n") - F.col("first"))
    sizes = parts.groupBy("curve").agg(F.sum("n").alias("total"))
    parts = parts.join(F.broadcast(sizes), "curve").select("part", "curve", "shift", F.greatest(F.lit(least_window), F.ceil(F.col("total") * window)).cast("long").alias("width"), F.floor((F.col("total") - 1) / block_rows).alias("last"))  # lengths x curves rows
    ranked = placed.join(parts, ["part", "curve"]).select("cls", "curve", (F.col("at") + F.col("shift")).alias("rank"), "width", "last")
    ranked = ranked.groupBy("cls").agg(F.collect_list(F.struct("curve", "rank", "width", "last")).alias("on"))  # a row a curve
    raw = classes.select("cls", F.col("ids")[0].alias("least"), "asks", "vec").mapInArrow(_packed(kind), "cls long, least long, asks boolean, vec binary").join(ranked, "cls")
    base = raw.select("cls", "least", "vec", F.explode("on").alias("o")).select("o.curve", F.floor(F.col("o.rank") / block_rows).alias("block"), "cls", "least", "vec", "o.rank", "o.width", F.lit(False).alias("asks"))
    put = F.expr(f"sequence(greatest(0L, (o.rank - o.width) div {block_rows}), least(o.last, (o.rank + o.width) div {block_rows}))")
    ask = raw.where("asks").select("cls", "least", "vec", F.explode("on").alias("o")).select("o.curve", F.explode(put).alias("block"), "cls", "least", "vec", "o.rank", "o.width", F.lit(True).alias("asks"))
    near = base.unionByName(ask).repartition("curve", "block").mapInArrow(_rerank(kind, k), "q long, cls long, least long, score double")

    best = near.groupBy("q", "cls", "least").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "least")
    best = best.withColumn("place", F.row_number().over(order)).where(f"place <= {k + 1}").drop("place")
    best = best.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    queries = classes.where("asks").select("h1", "h2", F.col("cls").alias("q")).join(who, ["h1", "h2"]).select("q", F.col("id").alias("query_id"))
    pairs = queries.join(best, "q").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column("vec")):
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["cls", "least", "asks", "vec"])

    return run
