"""Phrase collocations, level by level: a phrase is only counted where both phrases of one word less are frequent."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# fixed values: letters that are lower-cased, what ends a piece, and what stands between words
LOWER, BREAKS, BLANK = {c: c + 32 for c in range(65, 91)}, b".,;:!?\n\x0b\x0c\r", b"\t"
TABLE = bytes(LOWER.get(c, 10 if c in BREAKS else 32 if c in BLANK else c) for c in range(256))
SLICE, TOKENS, WORDS = 1 << 20, 1_200_000, 150_000  # bytes cut into words at once; words and distinct words held before counts go on
SEED = 42
PARTS = 32  # of a language, ranked by themselves first
EXACT, BITS = 2_000_000, 28  # hashes that are broadcast as they are; beyond, a bit map of 2 ** BITS bits


def slices(text: str) -> Iterator[bytes]:
    """A text's bytes, lower-cased, pieces ending with a line feed and words with a space, in slices that cut no word."""
    data = text.encode().translate(TABLE)
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        if end < len(data):
            stops = [s for s in (data.rfind(b" ", start, end), data.rfind(b"\n", start, end)) if s > start]
            later = [s for s in (data.find(b" ", end), data.find(b"\n", end)) if s >= 0]
            end = max(stops) if stops else min(later, default=len(data))
        yield data[start:end]
        start = end


class Vocabulary(dict):
    """Numbers for words as they come up: 0 ends a piece, 1 is nothing between two spaces."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})
        self.words = [b"\n", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Frequent:
    """The frequent phrases of a level by their 64-bit hashes: a sorted array, or a bit map of fixed size.  Other phrases that share a hash or a bit only
    mean that more is counted than need be; counts decide in the end."""

    def __init__(self, hashes: np.ndarray | None = None, bitmap: np.ndarray | None = None):
        self.hashes, self.bitmap = hashes, bitmap

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            at = h & np.uint64((1 << BITS) - 1)
            return (self.bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its start and its last word."""
    return ((a << np.uint64(1)) | (a >> np.uint64(63))) ^ b


def _word_hash(c: Column, lang: Column) -> Column:
    return F.xxhash64(lang, c)


def phrase_hash(lang: Column, phrase: Column, k: int) -> Column:
    """``joined`` over a phrase of k words, as ``_count`` has it."""
    words = F.split(phrase, " ")
    h = _word_hash(words[0], lang)
    for i in range(1, k):
        h = F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)).bitwiseXOR(_word_hash(words[i], lang))
    return h


def broadcast_frequent(level: DataFrame, k: int) -> Frequent:
    """The level's hashes for all tasks, 16 MB as they are or 32 MB as a bit map, whichever the number of phrases asks for."""
    hashes = level.select(phrase_hash(F.col("lang"), F.col("phrase"), k).alias("h"))
    if level.count() <= EXACT:
        return Frequent(np.unique(hashes.toArrow().column("h").to_numpy().view(np.uint64)))
    at = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    found = words.toArrow()  # 2 ** (BITS - 6) rows at most
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Frequent(bitmap=bitmap)


def _starts(ids: np.ndarray, words: list[bytes], lang: str, k: int, known: Frequent) -> np.ndarray:
    """Where a phrase of k words begins, both of whose phrases of k - 1 words are frequent."""
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    inside = ids > 1
    if k == 2:
        fine = known.holds(hashes)[ids] & inside
    else:  # of each place, whether the k - 1 words from there are a frequent phrase
        many = max(len(ids) - k + 2, 0)
        h, fine = hashes[ids[:many]], inside[:many].copy()
        for i in range(1, k - 1):
            h = joined(h, hashes[ids[i : i + many]])
            fine &= inside[i : i + many]
        fine[fine] = known.holds(h[fine])
    return np.flatnonzero(fine[:-1] & fine[1:])


def _grouped(ids: np.ndarray, start: np.ndarray, k: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases at ``start``, as a column of word numbers for each of their k words, and how often each stands there."""
    if size**k >= 2**63:
        grams, n = np.unique(np.stack([ids[start + i] for i in range(k)], axis=1), axis=0, return_counts=True)
        return list(grams.T), n
    code = ids[start].astype(np.int64)
    for i in range(1, k):
        code *= size
        code += ids[start + i]
    code.sort()
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    code, n = code[first], np.diff(np.append(first, len(code)))
    grams = []
    for _ in range(k):
        code, own = np.divmod(code, size)
        grams.append(own)
    return grams[::-1], n


def _count(k: int, frequent):
    """Partial counts of the phrases of k words: lang, phrase, n.  A text goes through in slices, and counts go on whenever TOKENS words are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value if frequent else None
        held: dict[str, tuple[Vocabulary, list]] = {}
        tokens = 0

        def counted(lang: str, vocabulary: Vocabulary, arrays: list) -> Iterator[pa.RecordBatch]:
            ids, words = np.concatenate(arrays), vocabulary.words
            arrays.clear()
            if k == 1:
                n = np.bincount(ids, minlength=len(words))
                n[:2] = 0
                at = np.flatnonzero(n)
                yield from rows(lang, words, [at], n[at])
            elif len(start := _starts(ids, words, lang, k, known)):
                yield from rows(lang, words, *_grouped(ids, start, k, len(words)))

        def rows(lang: str, words: list[bytes], grams: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = pa.array(words, pa.binary())
            for i in range(0, len(n), 50_000):
                part = slice(i, i + 50_000)
                phrases = pc.binary_join_element_wise(*(own.take(pa.array(g[part])) for g in grams), b" ") if k > 1 else own.take(pa.array(grams[0][part]))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases.cast(pa.string()), pa.array(n[part].astype(np.int64))], names=["lang", "phrase", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (vocabulary, arrays) in held.items():
                if arrays:
                    yield from counted(lang, vocabulary, arrays)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                carried: list[bytes] = []
                for data in slices(text or ""):
                    if lang not in held:
                        held[lang] = (Vocabulary(), [])
                    vocabulary, arrays = held[lang]
                    if carried:
                        arrays.append(np.fromiter(map(vocabulary.__getitem__, carried), np.int32))
                        carried = []
                    ids = np.fromiter(map(vocabulary.__getitem__, data.replace(b"\n", b" \n ").split(b" ")), np.int32)
                    arrays.append(ids[ids != 1])
                    tokens += len(arrays[-1])
                    if tokens >= TOKENS or sum(len(v.words) for v, _ in held.values()) >= WORDS:
                        if k > 1:
                            last = np.concatenate(arrays)[-(k - 1) :]
                            carried = [vocabulary.words[i] for i in last.tolist()]
                        yield from flush()
                        tokens = 0
                if lang in held:
                    held[lang][1].append(np.zeros(1, np.int32))
        yield from flush()

    return run


def _level(texts: DataFrame, k: int, known) -> DataFrame:
    return texts.mapInArrow(_count(k, known), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def levels(docs: DataFrame, *, lang: str = "lang", text: str = "text", most_words: int = 3, least: int = 10, unknown: str = "und") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for 1 to ``most_words`` words a table (lang, phrase, f) of the phrases found ``least`` times or more.

    Level k reads the texts once, against the broadcast hashes of level k - 1, and sums partial counts by phrase with map-side combine.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(unknown)).alias("lang"), F.col(f"`{text}`").alias("text"))
    words = cut(_level(texts, 1, None))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = [words.where(F.col("f") >= least)]
    for k in range(2, most_words + 1):
        known = docs.sparkSession.sparkContext.broadcast(broadcast_frequent(out[-1], k - 1))
        out.append(cut(_level(texts, k, known).where(F.col("f") >= least)))
    return sizes, out


def _part(phrase: Column, begin: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin + 1, n), " ")


def candidates(tables: list[DataFrame]) -> list[DataFrame]:
    """For each level from 2: lang, phrase, a, l, r, score, by the lowest-scoring cut, ties to the earliest."""
    out = []
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    for k in range(2, len(tables) + 1):
        rows = tables[k - 1].withColumnRenamed("f", "a")
        for j in range(1, k):
            left = tables[j - 1].select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
            right = tables[k - j - 1].select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
            cuts = rows.withColumns({"_left": _part(F.col("phrase"), 0, j), "_right": _part(F.col("phrase"), j, k - j)}).join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).drop("_left", "_right")
            cuts = cuts.withColumns({"_million": F.lit(1_000_000).cast("decimal(7,0)"), "_a": exact("a"), "_l": exact("l"), "_r": exact("r")}).withColumn("score", F.expr("(_million * _a * _a) div (_l * _r)"))
            cut_ = F.struct("score", F.lit(j).alias("j"), "l", "r").alias(f"_cut{j}")
            rows = cuts.select("lang", "phrase", "a", *(f"_cut{i}" for i in range(1, j)), cut_)
        best = F.least(*(F.col(f"_cut{i}") for i in range(1, k))) if k > 2 else F.col("_cut1")
        out.append(rows.withColumn("_best", best).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    return out


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, unknown: str = "und") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    a: occurrences, ``least`` at the least, within pieces that punctuation and line ends bound, overlaps included; l and r: those of the two sides of the
    lowest-scoring cut; n: all words of the language; score: floor(1,000,000 a a / (l r)).  Candidates inside a longer candidate that has
    ``share`` per cent of their occurrences or more are dropped; it is enough to look at candidates of one word more, as what lies between is found at
    least as often.  Order: score, a, then phrase by bytes.

    Null languages are ``unknown``; null and empty texts hold no words; repeated rows count each; texts and words may be of any length; an
    empty table gives no rows; columns by other names are ignored.
    """
    sizes, tables = levels(docs, lang=lang, text=text, most_words=most_words, least=least, unknown=unknown)
    scored = candidates(tables)
    kept = []
    for k, rows in enumerate(scored, 2):
        if k < most_words:
            longer = scored[k - 1].select("lang", F.col("a").alias("theirs"), F.explode(F.array_distinct(F.array(_part(F.col("phrase"), 0, k), _part(F.col("phrase"), 1, k)))).alias("phrase"))
            inside = longer.groupBy("lang", "phrase").agg(F.max("theirs").alias("theirs"))
            rows = rows.join(inside, ["lang", "phrase"], "left").where(F.expr(f"theirs is null or 100 * theirs < {share} * a")).drop("theirs")
        kept.append(rows)
    every = reduce(DataFrame.unionByName, kept)
    by = [F.desc("score"), F.desc("a"), "phrase"]
    parts = every.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))  # so the last ranking gets ``top`` rows a part at most, whatever a language has
    parts = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_rank") <= top).drop("_part", "_rank")
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
