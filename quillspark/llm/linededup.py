"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import LEAST_LONG, any_names, cut, map_texts

STRIP = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, did long, rid long, n int, at array<int>"
DECISIONS = "kind byte, h1 long, h2 long, did long, rid long, n int, at array<int>, docs long"
DROP, PENDING, RUN = 0, 1, 2
OUT_ROWS = 4096


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(STRIP).lower()


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_LINES = [("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32()))]
_DECISIONS = [("kind", pa.int8()), *_LINES, ("docs", pa.int64())]
_BITMAPS = [("did", pa.int64()), ("rid", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())]


def _lines(least_chars: int):
    """A row for each document and distinct key in it: the key's hash, the document, its number of lines, the places."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for did, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found: dict[int, list[int]] = {}
                lines = (text.as_py() or b"").split(b"\n")
                for i, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                        found.setdefault(xxhash.xxh3_128_intdigest(key), []).append(i)
                for h, at in found.items():
                    out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, did, rid, len(lines), at))
                    if len(out) == OUT_ROWS:
                        yield _batch(out, _LINES)
                        out.clear()
        if out:
            yield _batch(out, _LINES)

    return extract


def _decide(least_docs: int):
    """Stream one partition sorted by hash, then document, largest first.

    A run of equal hashes that begins inside the partition has its keeper there: its other documents
    are dropped as soon as ``least_docs`` are seen.  The first run may have begun in an earlier
    partition, and the last may go on in a later one: what they leave open goes out as pending rows,
    with a row for the run that counts its documents.  At most ``least_docs`` documents are held.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = keeper = last = None
        first, docs = True, 0
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                did = row[2]
                if row[:2] != key:
                    if first and key is not None:
                        out.append((RUN, *key, keeper, 0, None, None, docs))
                        first = False
                    key, keeper, last, docs = row[:2], did, did, 1
                    held.clear()
                elif did != last:
                    last, docs = did, docs + 1
                if first:
                    out.append((PENDING, *row, None))
                elif did != keeper:
                    if docs < least_docs:
                        held.append((*row, None))
                    else:
                        out.extend((DROP, *x) for x in held)
                        held.clear()
                        out.append((DROP, *row, None))
            if out:
                yield _batch(out, _DECISIONS)
                out.clear()
        if key is not None:
            out.append((RUN, *key, keeper, 0, None, None, docs))
            out.extend((PENDING, *x) for x in held)
            yield _batch(out, _DECISIONS)

    return decide


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One deflated bitmap for each document of a partition sorted by document; one document is held at a time."""
    now, keep = None, np.ones(0, bool)
    out: list[tuple] = []

    def close() -> None:
        if now is not None:
            out.append((*now, len(keep), len(keep) - int(keep.sum()), zlib.compress(np.packbits(keep).tobytes(), 6)))

    for batch in batches:
        for did, rid, n, at in zip(*(c.to_pylist() for c in batch.columns)):
            if (did, rid) != now:
                close()
                now, keep = (did, rid), np.ones(n, bool)
            keep[at] = False
        if len(out) >= OUT_ROWS:
            yield _batch(out, _BITMAPS)
            out.clear()
    close()
    yield _batch(out, _BITMAPS)


def kept_lines(raw: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """What stays of a text by its bitmap (None: all of it), its lines, and how many of them go."""
    n = raw.count(b"\n") + 1
    if keep is None:
        return raw, n, 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
    return b"\n".join(line for line, bit in zip(raw.split(b"\n"), bits.tolist()) if bit), n, n - int(bits.sum())


def _keyed(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("did"), F.xxhash64(text).alias("rid"), F.col(text).cast("binary").alias("raw"), *more)


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """For each document that loses lines, which of them stay: did, rid, n_lines, n_dropped, keep.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  A key of
    ``least_chars`` code points or more that ``least_docs`` documents or more hold stays in the largest
    document only, every time it stands there.  ``keep`` holds a bit for each line, packed and
    deflated; no text comes back, and documents that keep every line have no row.  (did, rid) names a document: its
    id (null: the least long, a document like any other) and the hash of its text, so rows that repeat whole share a
    line of the result and rows that repeat an id with other text each have their own; they count as one document.
    Null and empty texts and an empty table lose nothing; other columns are ignored, whatever their names.

    The 128-bit hashes of each document's lines are range-partitioned with the document in the key,
    so a line that a third of all documents hold spreads over partitions; sorted by hash and document,
    partitions are streamed.  Only runs at partition borders need a second look, by a join with at most
    two rows a partition.  What is dropped meets again by document and is streamed into bitmaps.
    """
    lines = map_texts(_keyed(docs, key, text), _lines(least_chars), LINES)
    order = [F.col("h1"), F.col("h2"), F.col("did").desc()]
    found = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order, "rid").mapInArrow(_decide(least_docs), DECISIONS))
    runs = found.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("docs").alias("n_docs"), F.max("did").alias("keeper"))
    pending = found.where(F.col("kind") == PENDING).join(F.broadcast(runs), ["h1", "h2"])  # two runs a partition at most
    row = ["did", "rid", "n", "at"]
    drops = found.where(F.col("kind") == DROP).select(*row).unionByName(pending.where(f"n_docs >= {least_docs} and did < keeper").select(*row))
    return drops.repartition("did", "rid").sortWithinPartitions("did", "rid").mapInArrow(_bitmaps, "did long, rid long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as its text (null: empty), and the columns n_lines and n_dropped.

    Columns of those names that docs already has, in whatever case, are replaced.  Documents without a bitmap keep every line.  Bitmaps hold
    a bit for each line, far less than the texts they meet, so they are the side that a task holds, and texts aren't sorted.
    """
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    rows = _keyed(docs, key, text, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    marks = bitmaps.select(F.col("did").alias("to"), F.col("rid").alias("of"), "keep")
    joined = rows.join(marks.hint("shuffle_hash"), (F.col("did") == F.col("to")) & (F.col("rid") == F.col("of")), "left").select("rest", "raw", "keep")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_lines(raw.as_py() or b"", keep) for raw, keep in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0].decode("utf-8", "replace") for x in got], pa.string()), *(pa.array([x[k] for x in got], pa.int64()) for k in (1, 2))], names=["rest", "kept", "lines", "dropped"])

    schema = StructType([rows.schema["rest"], StructField("kept", StringType()), StructField("lines", LongType()), StructField("dropped", LongType())])
    own = {text.lower(): "kept", "n_lines": "lines", "n_dropped": "dropped"}
    columns = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in {d.lower() for d in docs.columns})]
    return map_texts(joined, cleaned, schema).select(*(F.col(own[c.lower()]).alias(c) if c.lower() in own else F.col("rest")[c].alias(c) for c in columns))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` without the lines that ``keep_bitmaps`` drops; nulls, ties and repeats as described there."""
    return apply_bitmaps(docs, keep_bitmaps(docs, key=key, text=text, least_chars=least_chars, least_docs=least_docs), key=key, text=text)


def drop_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs`` alone: they may have any names, and an own n_lines stays as it is."""
    return any_names(docs, lambda rows, k, t: dedup_lines(rows, key=k, text=t, **how), key, text)
