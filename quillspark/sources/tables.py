"""Manifests, file lists, batches and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import not_retracted
from . import buckets

MANIFEST = StructType([StructField(c, StringType()) for c in ("AccessionID", "PMID", "Article File", "LastUpdated", "Retracted")])
TEXTS = ["chunk_id", "text", "doc_id", "source_title", "chunk_type", "section_title", "section_path", "imrad_type", "split_strategy", "pmc_id", "pmid", "doi", "journal", "article_type", "abstract_source", "source_url"]
CHUNKS = StructType([StructField(c, StringType()) for c in TEXTS] + [StructField(c, LongType()) for c in ("chunk_index", "total_chunks", "token_count", "pub_year")])


def spread(rows: DataFrame) -> DataFrame:
    """Deals out a table that has far fewer splits than there are cores, so one small file doesn't keep one core
    busy; larger tables are left as they are scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name that driver and executors share: below ``spark.checkpoint.dir``, or, for a local session without that, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillspark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, for what is read more than once."""
    path = workspace(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def fetched(rows: DataFrame, hits: DataFrame, key: str, held: int) -> DataFrame:
    """The ``rows`` whose key some hit has.  Up to ``held`` hits are counted and sent to where the rows lie, so that rows that nobody hit aren't shuffled; with more
    of them all rows are left to the join that follows."""
    return rows.join(F.broadcast(hits.select(key).distinct()), key, "left_semi") if hits.count() <= held else rows


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return clean_manifest(spark.read.option("header", True).schema(MANIFEST).option("enforceSchema", True).csv(path), limit)


def clean_manifest(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """All text, renamed, without what was retracted; a missing flag stays."""
    out = raw.select(F.col("AccessionID").alias("pmc_id"), F.col("PMID").alias("pmid_csv"), F.col("`Article File`").alias("article_file"), F.col("LastUpdated").alias("last_updated"), F.col("Retracted").alias("retracted"))
    out = out.where(not_retracted(F.col("retracted")))
    return out.limit(limit) if limit else out


def union_distinct(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """All rows; of those with the same key the first by ``order``; rows with an empty key all stay."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return every.where(~empty).withColumn("_n", nth).where("_n = 1").drop("_n").unionByName(every.where(empty))


def file_index(spark: SparkSession, path: str, suffix: str = "xml") -> DataFrame:
    """stem and path of every file below; of equal stems the last path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    return found.select("path", F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("stem")).groupBy("stem").agg(F.max("path").alias("path"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and MD5 of every file below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.md5("content").alias("md5"))


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return every.join(done.select(key).distinct(), key, "left_anti")


def write_chunks(chunks: DataFrame, path: str, rows: int = 200_000) -> None:
    chunks.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", rows).parquet(path)


def upsert(index: DataFrame | None, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index after a batch: its rows replace those of equal keys, others stay.  Of rows in the batch that repeat a key the one with
    the greatest hash of all columns counts, so the choice doesn't depend on their order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.xxhash64(*rows.columns))))
    own = rows.withColumn("_n", nth).where("_n = 1").drop("_n")
    if index is None:
        return own
    return index.join(own.select(key), key, "left_anti").select(index.columns).unionByName(own, allowMissingColumns=True)


def write_index(rows: DataFrame, path: str, key: str = "chunk_id") -> str:
    """Upserts a batch into the index at ``path``, a table of ``buckets``: only the batch is written, and a call that stops half-way leaves the index as it was."""
    return buckets.upsert(rows, path, key)


def read_index(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    return buckets.read(spark, path, key)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with the path of their file, by the stem of article_file or else the accession id; null where there is none."""
    stem = F.regexp_extract(F.coalesce("article_file", F.lit("")), r"([^/]+?)(\.[A-Za-z]+)*$", 1)
    own = manifest.withColumn("stem", F.coalesce(F.nullif(stem, F.lit("")), F.col("pmc_id")))
    return own.join(files.select("stem", "path"), "stem", "left")


def merge_batches(spark: SparkSession, paths: list[str], key: str = "chunk_id") -> DataFrame:
    """All batches as one table, one row a key: that of the first path that has it.  Columns are those of the first path, in its types; what others have besides is
    left out, what they lack is null."""
    first = spark.read.parquet(paths[0])
    every = []
    for i, p in enumerate(paths):
        own = spark.read.parquet(p)
        columns = [(F.col(f"`{f.name}`") if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in first.schema.fields]
        every.append(own.select(*columns, F.lit(i).alias("_batch")))
    out = every[0]
    for f in every[1:]:
        out = out.unionByName(f)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_batch"))).where("_n = 1").drop("_n", "_batch")


def sample_chunks(spark: SparkSession, merged: str, batches: list[str], n: int) -> DataFrame:
    """The first n rows of the merged table, or, where that isn't written yet, of the first batch."""
    for path in (merged, *batches):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(path).limit(n)
    raise ValueError("nothing is written yet")


def lookup(rows: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """The rows of some keys with ``place``, the first place of their key in the list (or the column ``place`` of a table of keys); keys without a row are left out."""
    if isinstance(ids, list):
        kind = rows.schema[key].dataType.simpleString()
        ids = rows.sparkSession.createDataFrame(list({k: (k, i) for i, k in reversed(list(enumerate(ids)))}.values()), f"`{key}` {kind}, place int")
    return rows.join(ids.select(key, "place"), key)


def read_vocabulary(spark: SparkSession, path: str, whitelist: list[str] | None = None, most: int = 15) -> DataFrame:
    """(term, expansions) of fetched JSON lines {"term", "synonyms": [{"name", "source"}]}: terms lower-cased, one row each, the distinct names of the sources
    that are wanted in the order in which they stand, without the term itself, ``most`` at most."""
    raw = spark.read.schema("term string, synonyms array<struct<name: string, source: string>>").json(path)
    names = F.transform(F.filter(F.coalesce("synonyms", F.array().cast(raw.schema["synonyms"].dataType)), lambda s: s["source"].isin(whitelist) if whitelist else F.lit(True)), lambda s: F.trim(s["name"]))
    own = raw.where("trim(term) <> ''").select(F.lower(F.trim("term")).alias("term"), names.alias("names"))
    once = own.groupBy("term").agg(F.max_by("names", F.struct(F.size("names"), "names")).alias("names"))
    return once.select("term", F.slice(F.array_distinct(F.filter("names", lambda x: x.isNotNull() & (x != "") & (F.lower(x) != F.col("term")))), 1, most).alias("expansions"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept, numbers that JSON doesn't know (NaN, infinite) as null."""
    plain = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")}
    (rows.withColumns(plain) if plain else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def head_each(rows: DataFrame, file: str, order: str, n: int) -> DataFrame:
    """The first n rows of each file."""
    nth = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def finished_files(rows: DataFrame, file: str, key: str, index: DataFrame) -> DataFrame:
    """Files whose first key is in the index already: what a lost checkpoint would have held."""
    first = rows.groupBy(file).agg(F.min(key).alias(key))
    return first.join(index.select(key), key, "left_semi").select(file, F.col(key).alias("first_key"))


def alignment(chunks: DataFrame, vectors: DataFrame, key: str, vector_key: str) -> DataFrame:
    """One row: chunks, vectors, chunks with a vector, and whether all three agree."""
    both = chunks.select(F.col(key).alias("_k"), F.lit(1).alias("_c")).join(vectors.select(F.col(vector_key).alias("_k"), F.lit(1).alias("_v")), "_k", "full_outer")
    out = both.agg(F.count("_c").alias("n_chunks"), F.count("_v").alias("n_vectors"), F.count_if(F.col("_c").isNotNull() & F.col("_v").isNotNull()).alias("n_matched"))
    return out.withColumn("agrees", (F.col("n_chunks") == F.col("n_vectors")) & (F.col("n_vectors") == F.col("n_matched")))
