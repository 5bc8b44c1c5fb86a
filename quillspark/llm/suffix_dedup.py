"""Suffix-array dedup: bytes in passages of 100 that stand earlier too are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_LONG, cut, map_texts

GRAM, SHALLOW, CHUNK = 32, 32, 1 << 21
ANCHOR, GONE, OPEN = 0, 1, 2
ROWS = "kind byte, ah long, ch long, did long, loc long"
_rng = np.random.default_rng(2024)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` (a power of two) values, by doubling."""
    h, n, power = values, 1, MULTIPLIER
    with np.errstate(over="ignore"):  # arithmetic modulo 2 ** 64
        while n < size:
            h = h[:-n] * power + h[n:]
            n, power = 2 * n, power * power
    return mix(h)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    m, n = h, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if width > n else m


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers: list[np.ndarray] = []


def anchors(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, size: int):
    """Windows of ``size`` bytes grouped by the place of their least gram: first window, windows, hash of the gram, hash of all bytes.

    Slice i of the buffer has counts[i] windows from starts[i] on.  Equal windows have the same gram at the same
    place, wherever they stand.
    """
    width = size - GRAM + 1
    values = BYTE[buffer]
    h = gram_hashes(values, GRAM)
    least = sliding_least(h, width)
    first = np.zeros(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + counts, -1)
    first &= np.cumsum(valid[:-1]).astype(bool)
    first[starts] = True
    at = np.flatnonzero(first)
    owner = np.searchsorted(starts, at, side="right") - 1
    ends = np.minimum(np.append(at[1:], len(least)), starts[owner] + counts[owner])
    n = ends - at
    offset = np.empty(len(at), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for i in range(0, len(at), 1 << 14):
        offset[i : i + (1 << 14)] = view[at[i : i + (1 << 14)]].argmin(axis=1)
    if not _powers or len(_powers[0]) < len(buffer) + 1:
        _powers[:] = [powers(MULTIPLIER, len(buffer) + 1), powers(INVERSE, len(buffer) + 1)]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values * _powers[0][: len(buffer)], dtype=np.uint64, out=sums[1:])
    whole = (sums[ends + size - 1] - sums[at]) * _powers[1][at]
    whole = mix(whole + mix((n * 128 + offset).astype(np.uint64)))
    return owner, at - starts[owner], n, least[at], whole


def _slices(batch: pa.RecordBatch, size: int):
    """Texts of the batch, cut into runs of windows, some megabytes at a time: bytes, starts, counts, row, first window."""
    held, total = [], 0
    for i, text in enumerate(batch.column("text")):
        raw = text.as_buffer() if text.is_valid else b""
        raw = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
        for s in range(0, max(0, len(raw) - size + 1), CHUNK // 2):
            part = raw[s : s + CHUNK // 2 + size - 1]
            held.append((part, i, s))
            total += len(part)
            if total >= CHUNK // 2:
                yield held
                held, total = [], 0
    if held:
        yield held


def _anchors(size: int):
    """Anchors of each text; of those with equal bytes within a batch only the earliest goes on, the others' windows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
            for held in _slices(batch, size):
                lengths = np.array([len(p) for p, _, _ in held])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                owner, first, n, ah, ch = anchors(np.concatenate([p for p, _, _ in held]), starts, lengths - size + 1, size)
                rows, base = np.array([i for _, i, _ in held])[owner], np.array([s for _, _, s in held])[owner]
                loc = tags[rows].astype(np.int64) << 39 | (first + base) << 7 | n
                kind, ah, ch, did, loc = _settle(ah, ch, dids[rows], loc)
                yield _emit(*(c[kind == ANCHOR] for c in (kind, ah, ch, did, loc)))
                yield _gone(did[kind == GONE], loc[kind == GONE])

    return run


def _settle(ah, ch, did, loc):
    """Rows by hash, then place; all but the first place of equal bytes are GONE."""
    order = np.lexsort((loc, did, ch, ah))
    ah, ch, did, loc = ah[order], ch[order], did[order], loc[order]
    same = np.zeros(len(ah), bool)
    same[1:] = (ah[1:] == ah[:-1]) & (ch[1:] == ch[:-1])
    twin = np.zeros(len(ah), bool)
    twin[1:] = same[1:] & (did[1:] == did[:-1]) & (loc[1:] == loc[:-1])  # a row that repeats whole
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(ah)))) if len(ah) else np.zeros(0, int)
    gone = same & ~((did == did[lead]) & (loc == loc[lead]))
    keep = ~twin
    return gone[keep].astype(np.int8), ah[keep], ch[keep], did[keep], loc[keep]


def _gone(did, loc) -> pa.RecordBatch:
    """Settled windows, runs of neighbouring anchors as one row: ch holds their number.  They need no company, so ah is the document's hash."""
    order = np.lexsort((loc, did))
    did, loc = did[order], loc[order]
    n, first = loc & 127, loc >> 7
    new = np.concatenate(([True], (did[1:] != did[:-1]) | (first[1:] > first[:-1] + n[:-1]))) if len(loc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(loc)) - 1 if len(at) else at
    windows = first[last] + n[last] - first[at]
    return _emit(np.full(len(at), GONE), mix((did[at] ^ (loc[at] >> 39)).view(np.uint64)), windows, did[at], loc[at])


def _emit(kind, ah, ch, did, loc) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), signed(ah), signed(ch), signed(did), signed(loc)], names=["kind", "ah", "ch", "did", "loc"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition that holds whole grams: what is gone, and the earliest anchors whose gram has other surroundings too (OPEN)."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    kind, ah, ch, did, loc = (np.concatenate(c) for c in zip(*held))
    settled = kind == GONE
    if settled.any():
        yield _emit(*(c[settled] for c in (kind, ah, ch, did, loc)))
    ah, ch, did, loc = (c[~settled] for c in (ah, ch, did, loc))
    order = np.argsort(ah, kind="stable")
    again = ah[order][1:] == ah[order][:-1]
    order = order[np.concatenate(([False], again)) | np.concatenate((again, [False]))] if len(order) else order
    kind, ah, ch, did, loc = _settle(ah[order], ch[order], did[order], loc[order])
    if not len(ah):
        return
    yield _gone(did[kind == GONE], loc[kind == GONE])
    ah, ch, did, loc = (c[kind != GONE] for c in (ah, ch, did, loc))
    again = ah[1:] == ah[:-1]
    more = np.concatenate(([False], again)) | np.concatenate((again, [False]))
    yield _emit(np.full(int(more.sum()), OPEN), ah[more], ch[more], did[more], loc[more])


def _contexts(size: int):
    """The bytes of each open anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, out = batch.column("did").to_pylist(), ([], [], [], [])
            for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted").to_pylist())):
                raw = memoryview(text.as_buffer())
                for w in wanted:
                    s, n = w["loc"] >> 7 & 0xFFFFFFFF, w["loc"] & 127
                    for o, x in zip(out, (w["ah"], dids[i], w["loc"], bytes(raw[s : s + n + size - 1]))):
                        o.append(x)
            for i in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(o[i : i + 20_000], k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["ah", "did", "loc", "bytes"])

    return run


class BlindTrie:
    """Strings of one length, their first ``depth`` bytes equal.  Branches hold only the place and byte where strings part; a string goes
    down by these alone and is compared once, with the leaf it reaches."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, None

    def add(self, s: bytes, label: int) -> int:
        """The label of the first string equal to s, or s's own."""
        if self.root is None:
            self.root = (s, label)
            return label
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[0] == s:
            return node[1]
        other = node[0]
        low, high = self.depth, len(s)  # s[:low] == other[:low], s[:high] != other[:high]
        while high - low > 1:
            mid = (low + high) // 2
            if s[:mid] == other[:mid]:
                low = mid
            else:
                high = mid
        place, up, node = low, None, self.root
        while isinstance(node, list) and node[0] < place:
            up, node = node, node[1].get(s[node[0]])
        leaf = (s, label)
        if isinstance(node, list) and node[0] == place:
            node[1][s[place]] = leaf
        else:
            branch = [place, {other[place]: node, s[place]: leaf}]
            if up is None:
                self.root = branch
            else:
                up[1][s[up[0]]] = branch
        return label


def equal_windows(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another of their group, and the class of each: deep-shallow sorting.

    Shallow: multikey quicksort on eight bytes at a time, to a depth of SHALLOW; a window that is alone
    with its prefix leaves.  Deep: groups that are still together share a long prefix; those whose rest
    is one string are one leaf, others go through a blind trie.
    """
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[: len(buffer) + 1], (len(buffer) + 1, 8), (1, 1))
    word = lambda w, d: np.ascontiguousarray(words[at[w] + d]).view(">u8").ravel().astype(np.uint64)
    alive, part = np.arange(len(at)), group
    for d in range(0, SHALLOW, 8):
        key = word(alive, d)
        order = np.lexsort((key, part))
        alive, p, k = alive[order], part[order], key[order]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (k[1:] != k[:-1]))) if len(p) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        again = np.bincount(part, minlength=1)[part] > 1 if len(part) else np.zeros(0, bool)
        alive, part = alive[again], part[again]
        if not len(alive):
            return alive, part
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    sizes = np.diff(np.append(starts, len(part)))
    lead = np.repeat(starts, sizes)
    differs = np.zeros(len(alive), bool)
    for d in [*range(SHALLOW, size - 7, 8), size - 8]:
        key = word(alive, d)
        differs |= key != key[lead]
    label = lead.copy()
    raw = buffer.tobytes()
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if differs[s : s + n].any():
            trie = BlindTrie(SHALLOW)
            for i in range(s, s + n):
                a = int(at[alive[i]])
                label[i] = trie.add(raw[a : a + size], i)
    return alive, label


def _repeats(size: int):
    """Spans of the windows that stand earlier too, of one partition that holds whole grams."""

    def some(ah, did, loc, texts):
        n = loc & 127
        lengths = n + size - 1
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ctx = np.repeat(np.arange(len(ah)), n)
        step = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(ah, return_inverse=True)[1][ctx]
        alive, label = equal_windows(buffer, base[ctx] + step, group, size)
        place = loc[ctx[alive]] + (step[alive] << 7)
        order = np.lexsort((place, did[ctx[alive]], label))
        label, who, place = label[order], did[ctx[alive]][order], place[order] >> 7
        later = np.concatenate(([False], label[1:] == label[:-1])) if len(label) else np.zeros(0, bool)
        who, place = who[later], place[later]  # tag and first byte of a repeated window
        order = np.lexsort((place, who))
        who, place = who[order], place[order]
        new = np.concatenate(([True], (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1) & (place[1:] != place[:-1]))) if len(who) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(who)) - 1 if len(first) else first
        return pa.RecordBatch.from_arrays([pa.array(who[first]), pa.array(place[first] >> 32), pa.array(place[first] & 0xFFFFFFFF), pa.array((place[last] & 0xFFFFFFFF) + size if len(last) else place[first])], names=["did", "tag", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        ah, did, loc = (rows.column(c).to_numpy() for c in ("ah", "did", "loc"))
        order = np.lexsort((loc, did, ah))
        new = np.any([c[order][1:] != c[order][:-1] for c in (ah, did, loc)], axis=0)  # a row that repeats whole counts once
        order = order[np.concatenate(([True], new))]
        ends = np.flatnonzero(np.concatenate((ah[order][1:] != ah[order][:-1], [True]))) + 1
        start = 0
        for e in ends.tolist():  # whole grams, some ten thousand anchors at a time
            if e - start >= 20_000 or e == len(order):
                at = order[start:e]
                start = e
                yield some(ah[at], did[at], loc[at], rows.column("bytes").take(pa.array(at)).to_pylist())

    return run


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """Spans of bytes covered by a string of ``size`` bytes that also starts earlier: did, tag, spans (s, e), unmerged.

    Every window of ``size`` bytes belongs to the least of its 32-byte grams by hash, its anchor; equal
    windows have equal anchors, so the anchor's hash says where windows meet.  Texts' anchors, about one
    in 35 bytes, are shuffled as hashes.  Anchors with equal surroundings are settled by their hash, within each
    batch before the shuffle already, so copies, however many, cost little.  Only where a gram has
    several surroundings, the bytes are fetched, and the suffixes that start there are sorted (``equal_windows``).

    (did, tag) names a document: its id (null: the least long) and 24 bits of its text's hash.  Rows that repeat
    whole are one document; rows that repeat an id with another text are documents in the order of that hash. Null,
    empty and short texts have no spans; an empty table gives no rows.
    """
    if size < GRAM + 16 or size - GRAM + 1 > 127:
        raise ValueError("size must be from 48 to 158 bytes")
    rows = _rows(docs, key, text)
    found = map_texts(rows, _anchors(size), ROWS).repartition("ah").mapInArrow(_classes, ROWS)
    found = cut(found)
    tag, first, windows = F.shiftright("loc", 39), F.shiftright("loc", 7).bitwiseAND(0xFFFFFFFF), F.col("ch")
    wanted = found.where(F.col("kind") == OPEN).groupBy("did", tag.cast("int").alias("tag")).agg(F.collect_list(F.struct("ah", "loc")).alias("wanted"))  # anchors of one document
    contexts = map_texts(rows.join(wanted, ["did", "tag"]).select("did", "text", "wanted"), _contexts(size), "ah long, did long, loc long, bytes binary")
    repeats = contexts.repartition("ah").mapInArrow(_repeats(size), "did long, tag long, s long, e long")
    gone = found.where(F.col("kind") == GONE).select("did", tag.alias("tag"), first.alias("s"), (first + windows + size - 1).alias("e"))
    spans = gone.unionByName(repeats)
    return spans.groupBy("did", F.col("tag").cast("int").alias("tag")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("did"), F.shiftrightunsigned(F.xxhash64(text), 40).cast("int").alias("tag"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """What stays of each document: key, n_bytes, n_removed, spans (maximal removed runs), kept (bytes, perhaps no valid UTF-8).

    Null keys, repeats and empty texts as in ``repeated_spans``."""
    spans = repeated_spans(docs, key=key, text=text, size=size)
    rows = _rows(docs, key, text).withColumn("null_key", F.col("did") == LEAST_LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for raw, found in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = raw.as_py()
                runs = merged([(x["s"], x["e"]) for x in found or ()])
                at, kept = 0, []
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                for o, x in zip(out, (len(raw), sum(e - s for s, e in runs), [{"s": s, "e": e} for s, e in runs], b"".join(kept))):
                    o.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("did"), *(pa.array(o, k) for o, k in zip(out, kinds))], names=["did", "n_bytes", "n_removed", "spans", "kept"])

    joined = rows.join(spans, ["did", "tag"], "left").select("did", "text", "spans")
    out = map_texts(joined, run, "did long, n_bytes long, n_removed long, spans array<struct<s: long, e: long>>, kept binary")
    return out.select(F.when(F.col("did") != LEAST_LONG, F.col("did")).alias(key), "n_bytes", "n_removed", "spans", "kept")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """``remove_repeats`` with the kept bytes as a digest: key, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, key=key, text=text, size=size)
    return out.select(key, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
