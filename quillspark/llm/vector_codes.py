"""Vector codes: each part of a vector as the index of its nearest codebook entry, found in a vantage-point tree of the entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE = 1 << 24  # components below: the square of a distance of up to 2 ** 12 of them fits a long
LEAF, MOST = 8, 2**63 - 1


def whole(column: pa.Array, scale: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count, and their components as whole numbers, floor(scale * x), filled up with zeros to ``width``.

    A row counts unless it is null or holds null or non-finite components.  Longs if all are below SAFE, else Python's own whole numbers.
    """
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    valid = column.take(pa.array(good)) if len(good) < len(column) else column
    flat, lengths = valid.flatten(), valid.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    fine = flat.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(good)), lengths)
    kept = np.bincount(owner[~fine], minlength=len(good)) == 0
    taken = kept[owner] if len(owner) else np.zeros(0, bool)
    x = np.floor(flat.fill_null(0).to_numpy(zero_copy_only=False)[taken].astype(np.float64) * scale)
    huge = ~np.isfinite(x)
    big = bool(len(x)) and (huge.any() or np.abs(x).max() >= SAFE)
    width = int(lengths[kept].max(initial=0)) if width is None else width
    out = np.zeros((int(kept.sum()), width), object if big else np.int64)
    lengths = lengths[kept]
    at = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if big:
        source = flat.fill_null(0).to_numpy(zero_copy_only=False)[taken].astype(np.float64)
        values = np.array([int(v) if np.isfinite(v) else int(s) * scale for v, s in zip(x, source)] + [0], object)[:-1]
    else:
        values = x.astype(np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values
    return good[kept], out


class Tree:
    """A vantage-point tree over one part's entries, whole numbers.

    Every node holds one entry and, for those inside and outside of its median distance, the range of their distances to it.  Ranges are
    rounded outwards and a query's distances inwards, so a bound is never too high; a side is visited if its bound
    isn't above the best distance so far, equality included; the squares that decide are whole numbers.  So the result is exactly that of a
    full comparison, ties to the lower index.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries))) if entries.dtype != object else None

    def _build(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        vantage, rest = ids[0], ids[1:]
        square = squares(self.entries[rest], self.entries[vantage])
        order = np.argsort(square, kind="stable")
        half = len(rest) // 2
        sides = []
        for part in (order[:half], order[half:]):
            low, high = down(square[part].min()), up(square[part].max())
            sides.append((low, high, self._build(np.sort(rest[part]))))
        return int(vantage), float(square[order[half]]), sides

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the square of its distance, for each row."""
        if x.dtype == object:  # beyond what bounds in doubles can hold: all entries are compared
            every = squares(x[:, None, :], self.entries[None])
            found = np.array([min(range(len(r)), key=r.__getitem__) for r in every.tolist()], np.int64)
            return found, every[np.arange(len(x)), found]
        best, found = np.full(len(x), MOST, np.int64), np.full(len(x), len(self.entries), np.int64)
        self._visit(self.root, x, np.arange(len(x)), best, found)
        return found, best

    def _better(self, rows, square, ids, best, found):
        hit = (square < best[rows]) | ((square == best[rows]) & (ids < found[rows]))
        at = rows[hit]
        best[at], found[at] = square[hit], ids[hit] if isinstance(ids, np.ndarray) else ids

    def _visit(self, node, x, rows, best, found):
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            all_ = squares(x[rows][:, None, :], self.entries[node][None])
            least = all_.argmin(axis=1)  # ids ascend, so the first of equal ones is the lowest
            self._better(rows, all_[np.arange(len(rows)), least], node[least], best, found)
            return
        vantage, middle, (inner, outer) = node
        square = squares(x[rows], self.entries[vantage])
        self._better(rows, square, vantage, best, found)
        near, low, high = square < middle, down(square), up(square)
        for mine, order in ((near, (inner, outer)), (~near, (outer, inner))):
            own, l, h = rows[mine], low[mine], high[mine]
            for least, most, child in order:
                bound = np.nextafter(np.maximum(l - most, least - h), -np.inf)
                open_ = bound <= up(best[own])
                self._visit(child, x, own[open_], best, found)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def down(square) -> np.ndarray:
    """At most the root of a whole number."""
    return np.nextafter(np.sqrt(np.asarray(square).astype(np.float64)) * (1 - 2**-50), -np.inf)


def up(square) -> np.ndarray:
    """At least the root of a whole number."""
    return np.nextafter(np.sqrt(np.asarray(square).astype(np.float64)) * (1 + 2**-50), np.inf)


def _same_kind(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    if x.dtype == object or any(b.dtype == object for b in books):
        return x.astype(object), [b.astype(object) for b in books]
    return x, books


def _trees(books: list[np.ndarray], held: dict, kind) -> list[Tree]:
    if kind not in held:
        held[kind] = [Tree(b.astype(kind)) for b in books]
    return held[kind]


LIMBS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def limbs(n: int) -> Iterator[int]:
    """A whole number as longs to the base 2 ** 48, the last one signed."""
    while not -(2**62) <= n < 2**62:
        yield n & (2**48 - 1)
        n >>= 48
    yield n


def _sums(books: list[np.ndarray], scale: int):
    """Partial sums of the rows that fall to each entry: part, entry, place, count and sum, at most the codebooks' size a task."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, len(books[0])), np.int64)
        sums, held = np.zeros((parts, len(books[0]), width), object), {}
        for batch in batches:
            _, x = whole(batch.column(0), scale, parts * width)
            x, _ = _same_kind(x, books)
            for p, tree in enumerate(_trees(books, held, x.dtype)):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = tree.nearest(own)
                counts[p] += np.bincount(entry, minlength=len(books[0]))
                part = np.zeros((len(books[0]), width), x.dtype)  # of a batch, below 2 ** 63 for components below SAFE
                np.add.at(part, entry, own)
                sums[p] += part
        p, e, j = (a.ravel() for a in np.indices(sums.shape))
        used = np.flatnonzero(counts[p, e] > 0)
        p, e, j = p[used], e[used], j[used]
        rows = [(*at, limb, n if not limb else 0, value) for at, n, total in zip(zip(p.tolist(), e.tolist(), j.tolist()), counts[p, e].tolist(), sums[p, e, j]) for limb, value in enumerate(limbs(int(total)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, LIMBS.types)], names=LIMBS.names)

    return run


def _codes(books: list[np.ndarray], scale: int):
    """Rows with their code and error."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            at, x = whole(batch.column(0), scale, parts * width)
            x, _ = _same_kind(x, books)
            found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(_trees(books, held, x.dtype))]
            error = sum((f[1].astype(object) for f in found), np.zeros(len(x), object))
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            rest = batch.take(pa.array(at, pa.int64())).columns[1:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(e, MOST) for e in error], pa.int64())], names=["key", "label", "code", "error"])

    return run


class Codebooks:
    """The entries of all parts; ``digest`` is the SHA-256 of their components, comma-joined by part, entry and place."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def fit(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks: the parts of the ``entries`` smallest keys, moved in each round to the floored mean of what falls to them.

    Null keys come last, equal keys in order of their vectors.  Vectors shorter than others are filled up with zeros, all to a length that
    ``parts`` divides.  None if no row counts.  What comes to the driver is ``entries`` vectors, then counts and sums of the codebooks' size.
    """
    rows = vectors.select(F.col(f"`{vector}`").alias("v"), F.col(f"`{key}`").alias("key"))
    sound = rows.where(F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    longest = sound.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    first = sound.orderBy(F.asc_nulls_last("key"), "v").limit(entries).toArrow()
    width = max(1, -(-longest // parts))
    _, x = whole(first.column("v").combine_chunks(), scale, parts * width)
    books = [x[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        got = rows.select("v").mapInArrow(_sums(books, scale), "part int, entry int, place int, limb int, n long, total long")
        summed = got.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found: dict[tuple, list[int]] = {}
        for r in summed.collect():  # the codebooks' size
            at = found.setdefault((r["part"], r["entry"], r["place"]), [0, 0])
            at[0], at[1] = at[0] + r["n"], at[1] + (int(r["total"]) << 48 * r["limb"])
        new = [b.astype(object) for b in books]
        for (p, e, j), (n, total) in found.items():
            new[p][e, j] = total // n
        books = [b.astype(np.int64) if all(abs(v) < SAFE for v in b.ravel()) else b for b in new]
    return Codebooks(books)


def encode(vectors: DataFrame, found: Codebooks, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """key, label, code (a byte a part), error (the squared distances of all parts summed; beyond a long the greatest long) of the rows that count."""
    rows = vectors.select(F.col(f"`{vector}`").alias("v"), F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    coded = rows.mapInArrow(_codes(found.books, scale), f"key {kinds[0]}, label {kinds[1]}, code binary, error long")
    return coded.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error")


def report(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """A row for each vector that counts: key, code (hexadecimal), error, label_error (summed over equal labels, nulls together), codebooks_sha256.

    Null vectors and those with null or non-finite components are left out; zero and empty vectors count.  Rows that repeat a key stay rows; with fewer rows
    than ``entries`` (256 at most) the codebooks are as small; an empty table gives no rows; columns by other names are ignored.  Components of any
    finite size are exact; sums beyond a long are the greatest long.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of one byte a part has 1 to 256 entries")
    found = fit(vectors, key=key, vector=vector, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if found is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = encode(vectors, found, key=key, vector=vector, label=label, scale=scale).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), "code", "error")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
