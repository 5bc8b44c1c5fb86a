"""What several operators share: cutting lineage, connected components, small helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import spread

LEAST_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for rows that hold whole texts.  Arrow batches end at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch) or at one
    text that is longer; ``run`` should take texts from a batch one by one, not as a list."""
    return rows.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place(docs: DataFrame, name: str) -> int:
    """Where the column of that name stands: as it is written, or else whatever the case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if found := [i for i, c in enumerate(docs.columns) if same(c)]:
            return found[0]
    raise ValueError(f"no column {name}")


def any_names(docs: DataFrame, run, *columns: str) -> DataFrame:
    """``run(rows, *names)``, where ``rows`` are ``docs`` under names that clash with nothing and ``names`` those of ``columns``; of what it returns
    the columns of ``docs``, under their own names again.  Columns are told apart by place, so names may hold dots or differ only in case."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return run(docs.toDF(*names), *(names[place(docs, c)] for c in columns)).select(*names).toDF(*docs.columns)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs a read, not a recomputation.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session without one gets a
    temporary folder; on a cluster a missing setting is an error, as no other folder is known to be shared.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def span(n: int, near) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over 0..n-1, where ``near(i, others)`` marks the neighbours of i.

    Every visited item is compared only with those not reached yet, so a dense group costs about n
    comparisons and n - 1 edges however many of its pairs are near.
    """
    left, frontier, a, b = np.arange(n), [], [], []
    while left.size:
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        i = frontier.pop()
        hit = near(i, left)
        new = left[hit]
        if new.size:
            left = left[~hit]
            a.extend([i] * new.size)
            b.extend(new.tolist())
            frontier.extend(new.tolist())
    return a, b


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a partition: at most one edge a node goes on."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of a graph given as links of long ids: (node, component), the smallest id reachable.

    Each partition first keeps a spanning forest of its own links.  Then large-star and small-star
    steps alternate until nothing changes; each is an aggregation with map-side combine and a join that
    adaptive execution can split, so a node with very many links is no bottleneck.  Nodes without a link
    to another node aren't in the result.  Each round is checkpointed; only a count and a checksum come
    to the driver.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = cut(edges.mapInArrow(_forest, "u long, v long").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = state(edges)
    for _ in range(most_rounds if now[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.expr("array(struct(u as u, m as v), struct(v as u, m as v))")).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, before = cut(small), now
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if now[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def keep_one(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The row of ``docs`` with the smallest key of each component, null keys last; of rows that repeat key and text any one.

    classes: row (xxhash64 of key and text), id, component.  The kept rows' hashes are dealt out like the
    documents, so the choice among repeated rows needs no shuffle of its own.
    """
    row, nth = fresh(docs.columns, "row"), fresh(docs.columns, "nth")
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    kept = docs.withColumn(row, F.xxhash64(key, text)).join(first.select(F.col("first.row").alias(row)), row)
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
