"""From a manifest and article files to chunks, as one call with counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import markup


def articles(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Every row of the manifest with what became of it, ``status``: no_file, no_parse, type or kept; where it was parsed with the article's columns.

    manifest: pmc_id (unique) and pmid_csv.  files: stem, path (unique) and content, the stem being the pmc_id.  A PMID that the article lacks is taken from the
    manifest if it is a number other than 0, and then decides the source URL.  doc_id is the manifest's pmc_id.
    """
    located = manifest.select(F.col("pmc_id").alias("doc_id"), F.trim("pmid_csv").alias("pmid_csv")).join(files.select(F.col("stem").alias("doc_id"), "path"), "doc_id", "left")
    parsed = markup.read_articles(files.join(manifest.select(F.col("pmc_id").alias("stem")), "stem", "left_semi"))
    both = located.join(parsed, "path", "left").withColumn("_given", F.when(F.col("pmid_csv").rlike("^[0-9]+$") & (F.col("pmid_csv") != "0"), F.col("pmid_csv")))
    lacks = F.col("article_type").isNotNull() & F.col("pmid").isNull() & F.col("_given").isNotNull()
    both = both.withColumns({"source_url": F.when(lacks, T.source_url(F.col("_given"), F.lit(None).cast("string"), F.lit(None).cast("string"))).otherwise(F.col("source_url")), "pmid": F.when(lacks, F.col("_given")).otherwise(F.col("pmid"))})
    status = F.when(F.col("path").isNull(), "no_file").when(F.col("article_type").isNull(), "no_parse").when(~T.kept_type(F.col("article_type")), "type").otherwise("kept")
    return both.withColumn("status", status).drop("_given", "pmid_csv")


def run(manifest: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """Writes ``target``/articles and ``target``/chunks and returns one row of counters: n, skipped_no_file, skipped_no_parse, skipped_type, n_parsed, n_with_pmid and
    chunks by strategy.  Articles are parsed once; what follows reads them as written, so a run that is lost starts at the table it has."""
    spark = manifest.sparkSession
    articles(manifest, files).write.mode("overwrite").parquet(f"{target}/articles")
    done = spark.read.parquet(f"{target}/articles")
    chunking.article_chunks(done.where("status = 'kept'")).write.mode("overwrite").parquet(f"{target}/chunks")
    return counters(done, spark.read.parquet(f"{target}/chunks"))


def counters(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: what became of the manifest's rows, and how many chunks of each strategy there are."""
    kept = F.col("status") == "kept"
    first = done.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"skipped_{s}") for s in ("no_file", "no_parse", "type")), F.count_if(kept).alias("n_parsed"), F.count_if(kept & F.col("pmid").isNotNull()).alias("n_with_pmid"))
    names = ("A_no_split", "B_sliding_window", "C_body_merged", "D_body_recursive")
    second = chunks.agg(*(F.count_if(F.col("split_strategy") == s).alias(f"n_{s[0].lower()}") for s in names), F.countDistinct(F.when(F.col("split_strategy") == names[3], F.col("doc_id"))).alias("n_split_bodies"))
    return first.crossJoin(F.broadcast(second))  # one row each
