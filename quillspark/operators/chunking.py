"""Cutting documents into chunks that keep their place in the document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import imrad, kept_type, words

LIMIT, SIZE, OVERLAP, TARGET = 512, 400, 80, 300
SEPARATORS = ["\n\n", "\n", ". ", " "]
ROWS, CHARS = 1024, 1 << 22  # what a task turns into Python objects at once, and what it gathers before it passes it on


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Overlapping windows of tokens; the last one ends with the text, and a text of ``size`` or fewer is one window."""
    own = docs.select(key, words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = own.select(key, "n", F.posexplode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("chunk_index", "piece"))
    return cut.select(key, "chunk_index", F.size("piece").alias("token_count"), F.array_join("piece", " ").alias("text"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines of each text that hold something: key, pos, text, token_count."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "text"))
    return lines.withColumn("token_count", F.size(words(F.col("text")))).where("token_count > 0")


def islands(rows: DataFrame, path: str, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """A number for each run of neighbouring rows with an equal path, from 0."""
    order = Window.partitionBy(key).orderBy(pos)
    new = F.when(F.lag(path).over(order).eqNullSafe(F.col(path)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order) - 1).drop("_new")


def merge_paragraphs(rows: DataFrame, target: int = TARGET, group=("doc_id",), pos: str = "pos", text: str = "text", tokens: str = "token_count") -> DataFrame:
    """Neighbouring paragraphs joined while they hold ``target`` tokens at most; one that is longer stays alone.

    Groups (documents or sections) are dealt out by hash and sorted within partitions; a task streams them with the open chunk alone in hand, so the
    work is linear and a group of any length needs no more memory than a chunk.  Equal positions go by text; null texts and counts are empty and 0.
    """
    n = len(group)
    own = rows.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), F.col(pos).alias("pos"), F.col(text).alias("text"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n"))
    names = [f"g{i}" for i in range(n)]
    schema = StructType([*(own.schema[c] for c in names), StructField("chunk_index", IntegerType()), StructField("text", StringType()), StructField("token_count", LongType())])
    ordered = own.repartition(*names).sortWithinPartitions(*names, "pos", "text", "n").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        out: list[list] = [[] for _ in range(n + 3)]
        now, index, texts, held, size = None, 0, [], 0, 0

        def put(*values) -> None:
            for column, v in zip(out, values):
                column.append(v)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=schema.names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            kinds = kinds or [*batch.schema.types[:n], pa.int32(), pa.string(), pa.int64()]
            for *own_, t, k in (row for i in range(0, batch.num_rows, ROWS) for row in zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns))):
                if own_ != now or held + k > target:
                    if now is not None:
                        put(*now, index, "\n\n".join(texts), held)
                        size += sum(map(len, texts))
                    index, now = (index + 1 if own_ == now else 0), own_
                    texts, held = [], 0
                texts += [t] if t is not None else []
                held += k
                if len(out[0]) >= 10 * ROWS or size >= CHARS:
                    yield flush()
                    size = 0
        if now is not None:
            put(*now, index, "\n\n".join(texts), held)
            yield flush()

    merged = ordered.mapInArrow(run, schema)
    return merged.select(*(F.col(f"g{i}").alias(g) for i, g in enumerate(group)), "chunk_index", "text", "token_count")


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] | None = None, length=lambda s: len(s.split())) -> list[str]:
    """Pieces of ``size`` at most, if a separator allows it: cut at the coarsest separator, which stays with what follows, joined
    greedily, each starting with up to ``overlap`` of the one before."""
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if length(text) <= size or at is None:
        return [text] if text.strip() else []
    head, *tail = text.split(separators[at])
    parts = [p for p in [head, *(separators[at] + t for t in tail)] if p]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if length(part) > size:
            out += ["".join(held).strip()] if held else []
            held = []
            out += split_recursively(part, size, overlap, separators[at + 1 :], length)
            continue
        if held and length("".join([*held, part])) > size:
            out.append("".join(held).strip())
            while held and (length("".join(held)) > overlap or length("".join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    return [p for p in [*out, "".join(held).strip()] if p]


def _pieces(last: int, size: int, overlap: int, names: list[str]):
    """Pieces of the texts in column ``last``, each with the columns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, pieces, chars = [], [], [], 0
            for i, t in enumerate(batch.column(last)):
                own = split_recursively(t.as_py() or "", size, overlap)
                at += [i] * len(own)
                places += range(len(own))
                pieces += own
                chars += sum(map(len, own))
                if chars >= CHARS or i == batch.num_rows - 1:
                    took = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in range(last)), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], names=names)
                    at, places, pieces, chars = [], [], [], 0

    return run


def split_texts(rows: DataFrame, text: str, size: int, overlap: int, index: str, piece: str) -> DataFrame:
    """``rows`` with a row for each piece of ``split_recursively`` in place of their text: index from 0, piece.

    Texts are taken from a batch one by one, and pieces go on by CHARS characters, so a task holds one Arrow batch, one text and little more, however many rows there are."""
    others = [c for c in rows.columns if c != text]
    schema = StructType([*(rows.schema[c] for c in others), StructField(index, IntegerType()), StructField(piece, StringType())])
    return rows.select(*others, text).mapInArrow(_pieces(len(others), size, overlap, schema.names), schema)


def strategy_chunks(docs: DataFrame, limit: int = LIMIT, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """Title and text as one chunk if they fit (A_no_split), else pieces of the text with the title before each (B_sliding_window):
    key, chunk_id, chunk_index, total_chunks, text, token_count, split_strategy."""

    whole = F.concat_ws("\n\n", F.col(title), F.col(text))
    fits = docs.select(key, title, text, whole.alias("whole"), F.size(words(whole)).alias("n"))
    small = fits.where(F.col("n") <= limit).select(key, F.lit(0).alias("chunk_index"), F.col("whole").alias("text"), F.lit("A_no_split").alias("split_strategy"))
    large = split_texts(fits.where(F.col("n") > limit).select(key, title, text), text, size, overlap, "chunk_index", "piece")
    large = large.select(key, "chunk_index", F.concat_ws("\n\n", F.col(title), "piece").alias("text"), F.lit("B_sliding_window").alias("split_strategy"))
    out = small.unionByName(large).withColumn("token_count", F.size(words(F.col("text"))))
    out = out.withColumn("total_chunks", F.count("*").over(Window.partitionBy(key)))
    name = F.when(F.col("split_strategy") == "A_no_split", F.col(key).cast("string")).otherwise(F.format_string("%s_chunk_%04d", F.col(key).cast("string"), F.col("chunk_index")))
    return out.select(key, name.alias("chunk_id"), "chunk_index", "total_chunks", "text", "token_count", "split_strategy")


def body_chunks(rows: DataFrame, limit: int = LIMIT, target: int = TARGET, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """Body paragraphs as chunks: key, chunk_id, chunk_index, total_chunks, text, token_count, section_title, section_path, imrad_type,
    split_strategy.

    rows: key, pos, text, section_title, section_path.  Neighbours of one section merge up to ``target`` tokens; with the section's
    title before it that is a chunk (C_body_merged), or, beyond ``limit`` tokens, pieces of it each with the title
    (D_body_recursive).  The kind of section is that of the top title of the path.
    """

    own = rows.select(key, "pos", "text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("section_title", "section_path")))
    parts = islands(own.withColumn("token_count", F.size(words(F.col("text")))), "section_path", key)
    merged = merge_paragraphs(parts, target, (key, "island", "section_title", "section_path")).withColumnRenamed("chunk_index", "part")
    prefix = F.when(F.col("section_title") != "", F.concat("section_title", F.lit("\n\n"))).otherwise(F.lit(""))
    merged = merged.withColumn("prefix", prefix).withColumn("whole", F.concat("prefix", "text"))
    fits = F.size(words(F.col("whole"))) <= limit
    names = [key, "island", "part", "section_title", "section_path"]
    short = merged.where(fits).select(*names, F.lit(0).alias("piece"), F.col("whole").alias("text"), F.lit("C_body_merged").alias("split_strategy"))
    long = split_texts(merged.where(~fits).select(*names, "prefix", "text"), "text", size, overlap, "piece", "own")
    long = long.select(*names, "piece", F.concat("prefix", "own").alias("text"), F.lit("D_body_recursive").alias("split_strategy"))
    order = Window.partitionBy(key).orderBy("island", "part", "piece")
    out = short.unionByName(long).withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("total_chunks", F.count("*").over(Window.partitionBy(key)))
    name = F.format_string("%s_body_%05d", F.col(key).cast("string"), F.col("chunk_index"))
    top = F.element_at(F.split("section_path", " > "), 1)
    return out.select(key, name.alias("chunk_id"), "chunk_index", "total_chunks", "text", F.size(words(F.col("text"))).alias("token_count"), "section_title", "section_path", imrad(top).alias("imrad_type"), "split_strategy")


def article_chunks(articles: DataFrame) -> DataFrame:
    """What becomes of articles: chunks of title and abstract (A, B) and of the body (C, D), with the article's own columns; types that are
    left out have none."""
    kept = articles.where(kept_type(F.col("article_type")))
    kept = kept if "doc_id" in kept.columns else kept.withColumn("doc_id", F.coalesce("pmc_id", "path"))
    head = strategy_chunks(kept, title="title", text="abstract").withColumns({"section_title": F.lit("Abstract"), "section_path": F.lit("Abstract"), "imrad_type": F.lit("abstract"), "chunk_type": F.lit("abstract")})
    paragraphs_ = kept.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    body = body_chunks(paragraphs_).withColumn("chunk_type", F.lit("body"))
    meta = kept.select("doc_id", F.col("title").alias("source_title"), "pmc_id", "pmid", "doi", "journal", "pub_year", "article_type", "abstract_source", "source_url")
    return head.unionByName(body).join(meta, "doc_id")


def overlap_found(chunks: DataFrame, key: str = "doc_id", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """For neighbouring chunks, whether the next one holds characters 11 to 30 of the last 80 of this one."""
    order = Window.partitionBy(key).orderBy(index)
    tail = F.when(F.length(text) > 80, F.expr(f"right(`{text}`, 80)")).otherwise(F.col(text))
    needle = F.trim(F.substring(tail, 11, 20))
    pairs = chunks.withColumns({"needle": needle, "next": F.lead(text).over(order)}).where("next is not null and length(needle) >= 5")
    return pairs.select(key, index, F.contains("next", "needle").alias("found"))
