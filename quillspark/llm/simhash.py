"""SimHash near-dedup with multi-index hashing over fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, components, cut, keep_one, map_texts, span

BITS, BLOCK, ROWS = 64, 1 << 15, 1 << 14
PLACES = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Bit i is set if it is set in over half of the XXH64 (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased, words are what ASCII white space separates; fewer words than a shingle needs
    make one shingle; a text without words has fingerprint zero.
    """
    parts = (text or b"").lower().split()  # bytes: both touch ASCII only
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lasts = ends[min(words, len(parts)) - 1 :]
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([hash64(joined[s:e], 42) for s, e in zip(starts[i : min(n, i + BLOCK)].tolist(), lasts[i : i + BLOCK].tolist())], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(PLACES[ones * 2 > n].sum(dtype=np.uint64)) if (ones * 2 > n).any() else 0


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["row", "id", "fp"])

    return run


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits in ``width``."""
    masks = [0]
    layer = [0]
    for _ in range(radius):
        layer = [m | 1 << i for m in layer for i in range(m.bit_length(), width)]
        masks += layer
    return np.array(masks, np.uint64)


def _probes(segments: int, distance: int):
    """Rows (key, fp, rep): each segment's value with every mask of a Hamming ball, and the segment's number.

    By the pigeonhole principle two fingerprints within ``distance`` have a segment within
    r = distance // segments.  One side enumerates the ball of radius ceil(r / 2), the other that of
    floor(r / 2); here both enumerate the larger one, as every fingerprint is on both sides.
    """
    width = BITS // segments
    masks = ball(width, (distance // segments + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                fp, rep = (piece.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for s in range(segments):
                    part = (fp.view(np.uint64) >> np.uint64(s * width)) & np.uint64(2**width - 1)
                    keys = ((part[:, None] ^ masks[None, :]) * np.uint64(segments) + np.uint64(s)).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp, len(masks))), pa.array(np.repeat(rep, len(masks)))], names=["key", "fp", "rep"])

    return run


def _matches(distance: int):
    """Links between the fingerprints of each key, from one partition that holds whole keys.

    Complete distances are compared.  A group sends a spanning forest of its links, not its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not held:
            return
        key, fp, rep = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
        a, b = [rep[two][near]], [rep[two + 1][near]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            f, r = fp[s : s + n], rep[s : s + n]
            i, j = span(n, lambda x, others, f=f: np.bitwise_count(f[others] ^ f[x]) <= distance)
            a.append(r[i])
            b.append(r[j])
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]), pa.int64())], names=["a", "b"])

    return run


def _classes(docs: DataFrame, key: str, text: str, words: int, distance: int, segments: int) -> DataFrame:
    """A row for each document: row (hash of key and text), id, fp, component, which is one of its fingerprints."""
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    prints = cut(map_texts(rows, _fingerprints(words), "row long, id long, fp long"))
    probes = prints.select("fp").distinct().select("fp", F.col("fp").alias("rep")).mapInArrow(_probes(segments, distance), "key long, fp long, rep long")
    found = components(probes.repartition("key").mapInArrow(_matches(distance), "a long, b long"))
    return prints.join(found, prints["fp"] == found["node"], "left").select("row", "id", "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, segments: int = 2) -> DataFrame:
    """Documents with their fingerprint and class: key, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link if they differ in ``distance`` bits or fewer; component_id is the smallest key
    reachable.  Every distinct fingerprint is one entry of the index, however many copies have it and whether
    their keys are null or not.  Texts without words have fingerprint zero and link like others; null keys keep
    their row, with the smallest other key reachable (null if there is none); repeated keys each keep
    their row; an empty table gives no rows; other columns are ignored.

    With 2 segments of 32 bits a key of the index has chance matches only from about 2 ** 26 distinct
    fingerprints on; beyond that ``segments`` and ``distance`` decide the trade.
    """
    every = _classes(docs, key, text, words, distance, segments)
    least = every.groupBy("component").agg(F.min("id").alias("component_id"))
    return every.join(least, "component").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, segments: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest key, or any if all its keys are null."""
    return any_names(docs, lambda rows, k, t: keep_one(rows, _classes(rows, k, t, words, distance, segments), k, t), key, text)
