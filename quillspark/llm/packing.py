"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_texts

PIECE = "piece int, start long, length long, ids_crc32 long"
# fixed values: the characters that Unicode calls white space; runs of so many are encoded by themselves
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
_tokenizers: dict[int, object] = {}


def tokenizer(file: bytes):
    """A function from text to ids, uint32.  One a worker.

    A byte-level BPE file whose ids follow its merges is run by its ranks, which gives the same ids
    several times faster; any other file by the tokenizers library.  As there, a special token's string in a
    text becomes that token's id; a file whose added tokens do more than that is left to the library.
    """
    if (found := _tokenizers.get(hash(file))) is None:
        found = _tokenizers[hash(file)] = _by_ranks(json.loads(file)) or _by_library(file)
    return found


def _by_library(file: bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(file.decode())
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def _by_ranks(spec: dict):
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added, vocab = spec.get("added_tokens", []), model.get("vocab")
    if any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or spec.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)):
        return None
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in special}
    # fixed value: the published word pattern of this kind of tokenizer
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    run = tiktoken.Encoding("run", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        """As the pattern has it; but a long run of white space is taken out first, as matching it would take a stack of its length.  Such a run is a word of
        its own, without its last character where something else follows it in the text or before a special token."""
        parts, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(tuple(special), m.end()) else m.end() - 1
            parts += [core.encode_to_numpy(text[at : m.start()], allowed_special="all"), run.encode_to_numpy(text[m.start() : end], disallowed_special=())]
            at = end
        rest = core.encode_to_numpy(text[at:], allowed_special="all")
        return np.concatenate((*parts, rest)) if parts else rest

    return encode


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n ids start: all have ``capacity`` ids but the first, which may be shorter."""
    return [0] if n <= capacity else [*range(0, 1), *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: the columns of ``docs`` but its text, and piece, start, length, ids_crc32 (and ids, if asked for).

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.  Columns of ``docs`` with those names are replaced.
    """
    file = Path(tokenizer_path).read_bytes()
    own = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), *own}]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(fresh(kept, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(file)
        for batch in batches:
            at, found = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column(len(kept))):
                ids = np.append(encode(t.as_py() or ""), end_id).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    raw = ids[s:e].tobytes()
                    at.append(i)
                    for f, x in zip(found, (k, s, e - s, zlib.crc32(raw), raw if with_ids else None)):
                        f.append(x)
            base = batch.take(pa.array(at, pa.int64())).columns[: len(kept)]
            new = [pa.array(f, k) for f, k in zip(found, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*base, *new[: len(own)]], names=[*kept, *own])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [PIECE] + ["ids binary"] * with_ids)
    return map_texts(rows, run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill.  The fullest bin with room is found in a bit set of free rooms."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound on bins by two families of dual-feasible functions; counts[n] is the number of items of length n.

    U(e): lengths over C - e count whole, those under e not at all.  u(k): (k + 1) x / C, rounded down, over k,
    but exact where it is whole.
    """
    n = np.arange(capacity + 1, dtype=np.int64)
    total, number = np.concatenate(([0], np.cumsum(counts * n))), np.concatenate(([0], np.cumsum(counts)))
    e = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]
    best = int((big + -(-(total[capacity - e + 1] - total[e]) // capacity)).max())
    for k in range(1, 33):
        exact = n * (k + 1) % capacity == 0
        scaled = np.where(exact, n * k, n * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * scaled).sum()) // (capacity * k)))
    return best


def _fill(capacity: int, k: int, final: bool):
    """Packs one part; says of each row whether its bin stays."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_length", "_row"], ascending=[False, True])
        sizes = part["_length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(sizes, capacity)
        certified = len(fills) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        closed = np.arange(len(fills)) != fills.argmin() if certified else fills == capacity
        base = (k + 1) << 56 | int(part["_part"].iloc[0]) << 28
        return pd.DataFrame({"_row": part["_row"].to_numpy(), "sequence_id": base + bins, "offset": offsets, "closed": closed[bins] | final})

    return fill


def pack(rows: DataFrame, *, length: str = "length", capacity: int = 2048, part_rows: int = 20_000, most_rounds: int = 4) -> DataFrame:
    """``rows`` with sequence_id and offset: every row in a sequence of ``capacity`` at most, gapless from offset 0.

    Rows are dealt by hash to parts of about ``part_rows`` and packed by best-fit decreasing.  A part whose
    bins are as few as its dual-feasible bound says is certified: its bins stay, but for its emptiest one. A
    part with a gap gives back all bins that aren't full.  What is given back is dealt anew, so parts exchange
    documents, and packed again, in parts twice as large; the last round keeps what it gets.  Parts, the
    largest ``part_rows`` * 2 ** (``most_rounds`` - 1), bound what a task holds at any size of the table.

    Rows must have lengths from 1 to ``capacity``; equal lengths keep their order within a part; an empty table gives no rows;
    columns named sequence_id or offset are replaced, others stay whatever their names.
    """
    rows = rows.drop("sequence_id", "offset")
    names, own = [F.col(f"`{c}`") for c in rows.columns], fresh(rows.columns, "row")
    rows = cut(rows.withColumn(own, F.monotonically_increasing_id()))
    wrong = rows.where(f"`{length}` is null or `{length}` < 1 or `{length}` > {capacity}").limit(1).count()
    if wrong:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    done = [rows.where(F.col(length) == capacity).select(*names, (-F.col(own) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = rows.where(F.col(length) < capacity)
    schema = "_row long, sequence_id long, offset long, closed boolean"
    for k in range(most_rounds):
        n = left.count()
        if not n:
            break
        parts, last = -(-n // (part_rows << k)), k == most_rounds - 1
        final = last or parts == 1

        dealt = left.select(F.col(own).alias("_row"), F.col(length).alias("_length"), F.pmod(F.xxhash64(own, F.lit(k)), F.lit(parts)).alias("_part"))
        placed = cut(dealt.groupBy("_part").applyInPandas(_fill(capacity, k, final), schema).withColumnRenamed("_row", own))
        done.append(left.join(placed.where("closed").select(own, "sequence_id", "offset"), own).select(*names, "sequence_id", "offset"))
        if final:
            break
        left = cut(left.join(placed.where("not closed").select(own), own))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def certificate(packed: DataFrame, *, length: str = "length", capacity: int = 2048) -> tuple[int, int]:
    """Sequences used, and the bound for all rows together; at most ``capacity`` counts come to the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy(length).count().collect():
        counts[r[length]] = r["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """Documents as packed pieces: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null keys are kept as they are, and rows that repeat are packed each; null and empty texts are one id 0; an empty table gives no
    rows.  A text is encoded whole, however long, in one task, and only longer documents than a sequence are cut; other columns are
    ignored."""
    return pack(pieces(docs.select(key, text), tokenizer_path, text=text, capacity=capacity), capacity=capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
