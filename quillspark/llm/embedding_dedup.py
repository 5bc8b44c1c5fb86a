"""Embedding near-dedup: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, span
from .vectors import by_length, stored, unit

BLOCK, HOT = 512, 1 << 18  # rows compared at once; hot buckets that may be broadcast, some 30 bytes each


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _signatures(tables: int, bits: int, seed: int):
    """A row for each usable vector: its class, its length, its buckets in all tables, and all signs packed to whole 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column("vec")):
                own, n = batch.take(pa.array(at)), len(x)
                signs = unit(x) @ planes(x.shape[1], tables, bits, seed) > 0
                buckets = signs.reshape(n, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                packed = np.zeros((n, -(-tables * bits // 64) * 8), np.uint8)
                packed[:, : -(-tables * bits // 8)] = np.packbits(signs, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, n * tables + 1, tables, dtype=np.int32), buckets.ravel())
                yield pa.RecordBatch.from_arrays([own.column("h1"), own.column("h2"), pa.array(np.full(n, x.shape[1], np.int32)), lists, pa.array([v.tobytes() for v in packed], pa.binary())], names=["h1", "h2", "dim", "buckets", "sig"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list]:
    """Columns of each run of two rows or more whose first ``by`` columns agree: numbers as arrays, bytes as lists.  Rows come sorted, so one group at a time is held."""

    def whole(parts):
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for p in c for x in p] for c in zip(*parts)]

    held, now = [], None
    for batch in batches:
        columns = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        keys = np.stack([c.astype(np.int64) for c in columns[:by]])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if (key := keys[:, s].tolist()) != now:
                if sum(len(h[0]) for h in held) > 1:
                    yield whole(held)
                held, now = [], key
            held.append([c[s:e] for c in columns])
    if sum(len(h[0]) for h in held) > 1:
        yield whole(held)


def _new(sig: np.ndarray, p: np.ndarray, q: np.ndarray, t: int, bits: int) -> np.ndarray:
    """Whether table t is the first where p and q meet."""
    if not t:
        return np.ones(len(p), bool)
    differ = np.unpackbits(sig[p] ^ sig[q], axis=1, count=t * bits).reshape(len(p), t, bits)
    return differ.any(axis=2).all(axis=1)


def _candidates(bits: int, most: int):
    """Rows of each group that meet another there first, with at most ``most`` differing signs in all; groups come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, dim, bucket, part, half, h1, h2, sigs in _groups(batches, 4):
            n = len(half)
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(n, -1)
            words, on, crossed = sig.view(np.uint64), np.zeros(n, bool), bool(half.any())
            for i in range(0, n, BLOCK):
                far = np.zeros((min(BLOCK, n - i), n - i), np.uint16)
                for w in words.T:
                    far += np.bitwise_count(w[i : i + BLOCK, None] ^ w[None, i:])
                near = np.triu(far <= most, 1)
                if crossed:
                    near &= half[i : i + BLOCK, None] != half[None, i:]
                a, b = np.nonzero(near)
                for k in range(0, len(a), 1 << 14):
                    p, q = a[k : k + (1 << 14)] + i, b[k : k + (1 << 14)] + i
                    open_ = ~(on[p] & on[q])
                    p, q = p[open_], q[open_]
                    new = _new(sig, p, q, int(t[0]), bits)
                    on[p[new]] = on[q[new]] = True
            if on.any():
                kept = [pa.array(c[on]) for c in (t, dim, bucket, part, half, h1, h2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([sigs[k] for k in np.flatnonzero(on)], pa.binary())], names=["t", "dim", "bucket", "part", "half", "h1", "h2", "sig"])

    return run


def _compare(bits: int, least: float, kind: str):
    """Links of each bucket, or pair of blocks of a bucket: id, n (links in its own table first), other (for the forest); groups come sorted."""

    def group(t: int, half, ids, copies, vecs, sigs):
        n = len(ids)
        x = unit(np.frombuffer(b"".join(vecs), kind).reshape(n, -1).astype(np.float64))
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(n, -1)
        counts, rows, crossed = np.zeros(n, np.int64), [], bool(half.any())
        for i in range(0, n, BLOCK):
            near = x[i : i + BLOCK] @ x.T >= least
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            if crossed:
                near &= half[i : i + BLOCK, None] != half[None, :]
            rows.append(np.packbits(near, axis=1))
            a, b = np.nonzero(near)
            for k in range(0, len(a), 1 << 14):  # a pair counts in the first table where it meets
                p, q = a[k : k + (1 << 14)] + i, b[k : k + (1 << 14)]
                new = _new(sig, p, q, t, bits)
                np.add.at(counts, p[new], copies[q[new]])
        bitmap = np.concatenate(rows)
        if bitmap.any():
            i, j = span(n, lambda r, others: np.unpackbits(bitmap[r], count=n)[others].astype(bool))
            yield from ((int(ids[k]), int(counts[k]), None) for k in np.flatnonzero(counts))
            yield from ((int(a), 0, int(b)) for a, b in zip(ids[i], ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _dim, _bucket, _part, half, ids, copies, vecs, sigs in _groups(batches, 4):
            if found := list(group(int(t[0]), half, ids, copies, vecs, sigs)):
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["id", "n", "other"])

    return run


def _raw(kind: str):
    """Each class's vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column("vec")):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("h1", "h2", "rep", "copies")), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["h1", "h2", "id", "copies", "vec"])

    return run


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.sort(np.concatenate([np.zeros(0, np.int64), *(a for a, _ in by_length(batch.column("vec")))]))
        yield batch.take(pa.array(at))


def settings(classes: int, least: float, chance: float = 0.966, bucket: int = 16) -> tuple[int, int]:
    """Bits and tables for so many distinct vectors: as many bits as leave about ``bucket`` of unrelated ones in a bucket, 12 at the least, and as many tables as
    then find a pair at cosine ``least`` with ``chance``.  At 0.9 the tables grow with about the 0.22th power of the vectors."""
    bits = max(12, int(np.ceil(np.log2(max(classes, 1) / bucket))))
    meet = (1 - np.arccos(least) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log1p(-chance) / np.log1p(-meet) - 0.05)))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, tables: int | None = None, bits: int | None = None, seed: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept.

    Two vectors link if they share a bucket in one of ``tables`` sign hashes of ``bits`` random
    hyperplanes and their cosine in double precision is ``least`` or more.  ``settings`` chooses both by the number of distinct vectors (12 bits and 20 tables up to
    65,536 of them), so buckets don't grow with the table: a pair
    at cosine 0.9 is found with a chance of 0.966, at 0.95 of 0.9997, at 0.99 of over 0.99999999.

    A bucket of more than ``bucket_rows`` rows is cut into blocks by hash, and each pair of blocks is a
    group of its own, so no group grows with the data and no pair is lost.  First only the signs of all tables
    go to the buckets, packed; two rows of a bucket go on if the number of signs that differ is at most five standard deviations over
    what is expected at ``least`` (62 of 240), which loses a pair at ``least`` with a chance of about 3e-7, a nearer one with less.  Vectors follow
    only into buckets where such a pair meets for the first time.  Groups send counts and a spanning forest, never their pairs.  Exact copies link with each other and share their other links:
    they go through the index once, with their number.

    Null, zero, null-holding or non-finite vectors keep their row and link with nothing; a null key
    keeps its row, with no links, component_id null and kept false; rows that repeat a key and vector
    count as one vector; vectors of different lengths don't link; an empty table gives no rows; other columns are
    ignored.
    """
    kind = stored(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    good = rows.where("id is not null and vec is not null").mapInArrow(_usable, rows.schema)
    named = good.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2"), "vec")  # copies: equal in 128 bits of hash
    named = cut(named.groupBy("id", "h1", "h2").agg(F.first("vec").alias("vec")))
    classes = named.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    if bits is None or tables is None:
        chosen = settings(named.select("h1", "h2").distinct().count(), least)
        bits, tables = bits or chosen[0], tables or chosen[1]
    sigs = classes.select("h1", "h2", "vec").mapInArrow(_signatures(tables, bits, seed), "h1 long, h2 long, dim int, buckets array<long>, sig binary")
    placed = sigs.select("h1", "h2", "dim", "sig", F.posexplode("buckets").alias("t", "bucket"))
    hot = cut(placed.groupBy("t", "dim", "bucket").count().where(F.col("count") > bucket_rows).select("t", "dim", "bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")))
    blocked = placed.join(F.broadcast(hot) if hot.count() <= HOT else hot, ["t", "dim", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("own", F.expr("cast(pmod(xxhash64(h1, t), blocks) as int)"))
    places = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(own, b) * blocks + greatest(own, b) as part, case when b = own then 0 when own < b then 1 else 2 end as half))")
    group = ["t", "dim", "bucket", "part"]
    groups = blocked.withColumn("p", F.explode(places)).select("t", "dim", "bucket", "p.part", "p.half", "h1", "h2", "sig")
    share = np.arccos(least) / np.pi  # of the signs, where two vectors at this cosine differ
    most = int(np.ceil(tables * bits * share + 5 * np.sqrt(tables * bits * share * (1 - share))))
    met = groups.repartition(*group).sortWithinPartitions(*group).mapInArrow(_candidates(bits, most), groups.schema)
    vecs = classes.select("h1", "h2", "rep", "copies", "vec").mapInArrow(_raw(kind), "h1 long, h2 long, id long, copies long, vec binary")
    near = met.join(vecs, ["h1", "h2"]).select(*group, "half", "id", "copies", "vec", "sig")
    found = cut(near.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(bits, least, kind), "id long, n long, other long"))
    # Reps are unique only together with their class: an id may have several vectors.  Links of an id are those of all its vectors.
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    owns = classes.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = named.select("id", "h1", "h2").join(owns, ["h1", "h2"])
    whole = components(each.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").unionByName(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))))
    links = each.groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("id").join(links, "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))
