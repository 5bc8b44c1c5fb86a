"""A keyed table that grows by upserts: rows in buckets by the hash of their key, a delta a call, the newest row of a key wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
DELTA, BASE = "d", "b"


def steps(spark: SparkSession, path: str) -> tuple[dict[int, list[str]], int]:
    """For each bucket its folders that count, oldest first: from its newest base on.  And the number of the next step.

    A step is a folder, step=<number><d or b>, that counts once Spark has committed it; what comes to the driver are names of folders.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda pattern: [f.getPath().toString() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, pattern)) or []]
    named = [re.search(r"/step=(\d+)[db]$", p) for p in listed("step=*")]
    done = {re.search(r"/(step=\w+)/_SUCCESS$", p)[1] for p in listed("step=*/_SUCCESS")}
    found: dict[int, list[str]] = {}
    for folder in sorted(listed("step=*/bucket=*"), key=lambda p: re.search(r"step=\w+", p)[0]):
        step, bucket = re.search(r"/(step=\w+)/bucket=(\d+)$", folder).groups()
        if step in done:
            if step.endswith(BASE):
                found[int(bucket)] = []
            found.setdefault(int(bucket), []).append(folder)
    return found, max((int(m[1]) for m in named if m), default=-1) + 1


def upsert(rows: DataFrame, path: str, key: str = "chunk_id", buckets: int = BUCKETS, compact_at: int = 8) -> str:
    """Adds a batch: its rows replace those of equal keys, all others stay.  Returns the step's name.

    Only the batch is written, into the buckets that its keys fall into; nothing else is read.  Of rows that repeat a key in the batch the one with the
    greatest hash of all columns counts.  A call that stops half-way leaves a step without its mark, which doesn't count.  Buckets that have got
    ``compact_at`` folders are compacted afterwards.  One writer at a time; ``buckets`` must stay the same.
    """
    spark = rows.sparkSession
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.xxhash64(*rows.columns))))
    own = rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    number = steps(spark, path)[1]
    name = f"step={number:09d}{DELTA}"
    own.write.partitionBy("bucket").parquet(f"{path}/{name}")
    compact(spark, path, key, compact_at)
    return name


def _newest(spark: SparkSession, path: str, folders: list[str], key: str) -> DataFrame:
    rows = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)
    order = Window.partitionBy("bucket", key).orderBy(F.desc("step"))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def read(spark: SparkSession, path: str, key: str = "chunk_id", bucket: bool = False) -> DataFrame:
    """The table as it is now, without ``bucket`` if that isn't asked for.  Buckets with one folder are scanned as they are; of the others each key's newest row counts."""
    found, _ = steps(spark, path)
    if not found:
        raise ValueError(f"nothing is written below {path}")
    one = [f[0] for f in found.values() if len(f) == 1]
    more = [x for f in found.values() if len(f) > 1 for x in f]
    parts = [spark.read.option("basePath", path).option("mergeSchema", True).parquet(*one)] if one else []
    parts += [_newest(spark, path, more, key)] if more else []
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.drop("step", *([] if bucket else ["bucket"]))


def compact(spark: SparkSession, path: str, key: str = "chunk_id", least: int = 2) -> int:
    """Writes a new base for each bucket of ``least`` folders or more, and says how many buckets that were.  Other buckets aren't read; old folders stay
    until ``clean``, so readers that have begun go on."""
    found, number = steps(spark, path)
    due = [f for f in found.values() if len(f) >= max(2, least)]
    if due:
        _newest(spark, path, [x for f in due for x in f], key).drop("step").write.partitionBy("bucket").parquet(f"{path}/step={number:09d}{BASE}")
    return len(due)


def clean(spark: SparkSession, path: str) -> int:
    """Deletes the folders of buckets that a newer base replaces, and steps that were never finished; says how many."""
    found, _ = steps(spark, path)
    counts = {x for f in found.values() for x in f}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "step=*/bucket=*")) or []:
        if status.getPath().toString() not in counts:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
