"""Profiles of a corpus: token statistics, histograms, rollups, samples, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_stats(rows: DataFrame, value: str, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, interpolated percentiles, extremes, deviation, and how many exceed ``limit``."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"), F.count_if(F.col(value) > limit).alias("n_over"))
    names = ("median", "p90", "p95", "p99")
    return out.select(*by, "n", F.round("mean", 4).alias("mean"), *(F.round(F.col("p")[i], 4).alias(x) for i, x in enumerate(names)), "least", "most", F.round("deviation", 4).alias("deviation"), "n_over", F.round(100 * F.col("n_over") / F.col("n"), 4).alias("pct_over"))


def recommend(stats: DataFrame, limit: int) -> DataFrame:
    """How to cut texts of these percentiles so that chunks fit into ``limit``."""
    return stats.withColumn("strategy", F.when(F.col("p95") <= limit, "truncate").when(F.col("p95") <= 1.5 * limit, "sliding_window").otherwise("larger_model_or_sentences")).withColumn("long_tail", F.col("p99") > 1.5 * limit)


def histogram(rows: DataFrame, value: str, bounds: list[int]) -> DataFrame:
    """Counts for lo <= value < hi; buckets without rows have 0; the last bucket is open."""
    edges = list(zip(bounds, [*bounds[1:], None]))
    bucket = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(edges):
        bucket = F.when((F.col(value) >= lo) & (F.lit(True) if hi is None else F.col(value) < hi), i).otherwise(bucket)
    counts = rows.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(edges)], "bucket int, lo int, hi int")
    return names.join(counts, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_to(rows: DataFrame, value: str, bounds: list[int], most: int | None = None) -> DataFrame:
    """Counts for lo < value <= hi, each bucket closed on the right; rows outside of all buckets don't count.  ``most``: greater values count as that one."""
    capped = F.least(F.col(value), F.lit(most)) if most is not None else F.col(value)
    edges = list(zip(bounds, bounds[1:]))
    bucket = F.coalesce(*(F.when((capped > lo) & (capped <= hi), i) for i, (lo, hi) in enumerate(edges)))
    counts = rows.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    every = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(edges)))
    names = rows.sparkSession.range(1).select(F.inline(every))
    return names.join(counts, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def row_quality(rows: DataFrame, required: list[str], text: str, year: str, tokens: str, years: tuple[int, int] = (1950, 2025), most: int = 1024, vector: str | None = None, dimension: int = 768) -> DataFrame:
    """One row of counts: rows that lack each required field, have no text, a year outside of ``years`` (none is one as well), tokens outside of 1 to ``most`` or a
    vector of another length; and rows without any such fault."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    faults = {f"missing_{c}": empty(c) for c in required} | {"no_text": empty(text), "bad_year": ~F.coalesce(F.col(year).between(*years), F.lit(False)), "bad_tokens": ~F.coalesce(F.col(tokens).between(1, most), F.lit(False))}
    if vector:
        faults["bad_vector"] = ~F.coalesce(F.size(vector) == dimension, F.lit(False))
    sound = ~F.greatest(*faults.values())
    return rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{name}") for name, c in faults.items()), F.count_if(sound).alias("n_sound"))


def tops(rows: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """field, member, n, place: the commonest values of each column, at most as many as it says (None: all), ties by value; nulls don't count.  All columns are counted in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("member"), F.lit(k).cast("int").alias("k")) for c, k in columns.items()))
    counts = rows.select(F.inline(cells)).where("member is not null").groupBy("field", "member", "k").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "member"))
    return counts.withColumn("place", place).where("k is null or place <= k").select("field", "member", "n", "place")


def distribution(rows: DataFrame, by: str) -> DataFrame:
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def by_each(rows: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """Count, sum and mean for each value of each dimension, in one pass."""
    sets = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *(F.grouping(d).alias(f"g_{d}") for d in dimensions))
    name = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dimensions))
    what = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dimensions))
    return sets.select(name.alias("dimension"), what.alias("member"), "n", "total", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


def nulls(rows: DataFrame) -> DataFrame:
    """For each column how many values are null, as rows."""
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(rows.columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(rows.columns)))
    return one.select("n", F.explode(cells).alias("x")).select("x.column_name", "x.n_null", F.round(F.coalesce(F.try_divide(100 * F.col("x.n_null"), F.col("n")), F.lit(0.0)), 4).alias("pct"))


def top_terms(rows: DataFrame, terms: Column, k: int) -> DataFrame:
    """The k commonest terms, ties by term."""
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def rollup_documents(chunks: DataFrame, key: str, preferred: Column, order: str) -> DataFrame:
    """One row a document: its first preferred chunk, or its first chunk, with the number of chunks."""
    own = Window.partitionBy(key)
    best = F.row_number().over(own.orderBy(preferred.cast("int").desc(), order))
    return chunks.withColumns({"chunk_count": F.count("*").over(own), "first_seen": F.min(order).over(own), "_n": best}).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sample_each(rows: DataFrame, stratum: Column, n: int, key: str, seed: int) -> DataFrame:
    """n rows of each stratum, chosen by a hash of key and seed, so the same for every run and layout."""
    draw = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("stratum").orderBy("draw", key)
    return rows.withColumn("stratum", stratum).withColumn("draw", draw).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "draw")


def sample_clusters(rows: DataFrame, cluster: str, at_least: int, seed: int) -> DataFrame:
    """Whole clusters in hashed order until ``at_least`` rows are there: cluster, n, n_before."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n")).withColumn("draw", F.md5(F.concat_ws("-", F.col(cluster).cast("string"), F.lit(str(seed)))))
    before = F.sum("n").over(Window.orderBy("draw", cluster)) - F.col("n")
    return sizes.withColumn("n_before", before).where(F.col("n_before") < at_least).select(cluster, "n", "n_before")


def sanitize(rows: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """Metadata without nulls: text columns become '', numbers 0, also where a column is missing or no number."""
    have = set(rows.columns)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in texts}
    number = {c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")) if c in have else F.lit(0).cast("long") for c in numbers}
    return rows.withColumns(text | number)


def approximate(rows: DataFrame, value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """share, value: percentiles by a mergeable sketch, for tables whose values are too many to sort."""
    found = rows.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), accuracy).alias("p"))
    return found.select(F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("p").alias("value"))).alias("x")).select("x.share", "x.value")


def first_counts(rows: DataFrame, key: Column, order: str, by: str) -> DataFrame:
    """How many keys have each value of ``by`` in their first row; the first rows are found by a partial aggregation, so a
    key with very many rows is no bottleneck."""
    first = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(by), order).alias("f"))
    return first.groupBy(F.col(f"f.{by}").alias(by)).agg(F.count("*").alias("n"))


def shape(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, rows a key on average and at most."""
    each = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_documents"), F.avg("n").alias("_mean"), F.max("n").alias("most"))
    return out.select("n_rows", "n_documents", F.round(F.coalesce("_mean", F.lit(0.0)), 4).alias("rows_each"), "most")


def longest(rows: DataFrame, key: str) -> DataFrame:
    """The rows of the key with the most rows, ties to the smaller key."""
    best = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(1)  # one row
    return rows.join(F.broadcast(best.select(key)), key, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, by a partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def completeness(rows: DataFrame, fields: list[str], text: str, least: int = 50) -> DataFrame:
    """One row: how many rows lack each field, have a text shorter than ``least``, or none."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return rows.agg(F.count("*").alias("n"), *(F.count_if(empty(c)).alias(f"missing_{c}") for c in fields), F.count_if(~empty(text) & (F.length(text) < least)).alias("n_short"), F.count_if(empty(text)).alias("n_without_text"))


def counters(rows: DataFrame, skips: dict[str, Column], kinds: dict[str, Column]) -> DataFrame:
    """One row of counters: rows skipped for the first reason that holds, and of the others how many are of each kind."""
    why = F.lit(None).cast("string")
    for reason, holds in reversed(skips.items()):
        why = F.when(holds, reason).otherwise(why)
    own = rows.withColumn("_why", why)
    kept = F.col("_why").isNull()
    return own.agg(F.count("*").alias("n"), *(F.count_if(F.col("_why") == r).alias(f"skipped_{r}") for r in skips), F.count_if(kept).alias("n_kept"), *(F.count_if(kept & c).alias(f"n_{k}") for k, c in kinds.items()))
