"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKET_BITS = 10


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """The virtual nodes in clockwise order: arc, pos, shard.  Arc i ends at the i-th virtual node.

    A node's place comes from its shard and its number there alone, so another count of shards leaves the others' nodes where they are."""
    nodes = spark.range(0, shards * vnodes, 1, 1).select(F.expr(f"cast(id % {shards} as int)").alias("shard"), F.expr(f"id div {shards}").alias("copy"))
    nodes = nodes.select("shard", F.expr("xxhash64('ring', shard, copy)").alias("pos"))
    return nodes.select((F.row_number().over(Window.orderBy("pos", "shard")) - 1).alias("arc"), "pos", "shard")


def allocation(arcs: DataFrame, nodes: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """How many keys of each arc go where: arc, shard, lo, hi, slot0 (ranks lo..hi-1 of the arc start at slot0).

    Capacities add up to the number of keys and differ by one at most.  In round r each arc, clockwise,
    sends what is left of its keys to the r-th distinct shard after it, as far as that has room.  The
    input is a count for each arc, so the fold runs over a table bounded by the ring, whatever the data.
    """
    last = shards * vnodes
    order = nodes.agg(F.expr("transform(array_sort(collect_list(struct(arc, shard))), x -> x.shard)").alias("r"))
    order = order.select(F.expr(f"transform(sequence(0, {last}), a -> array_distinct(concat(slice(r, a % {last} + 1, {last}), slice(r, 1, a % {last}))))").alias("prefs"))
    needs = arcs.agg(F.expr("map_from_entries(collect_list(struct(arc, n)))").alias("m"), F.expr("coalesce(sum(n), 0L)").alias("total"))
    needs = needs.select("total", F.expr(f"transform(sequence(0, {last}), a -> coalesce(try_element_at(m, a), 0L))").alias("need"))
    state = needs.crossJoin(F.broadcast(order)).select(  # one row with one row
        "prefs", "need",
        F.expr(f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))").alias("caps"),
    )
    a, r = f"cast(k % {last + 1} as int)", f"cast(k div {last + 1} as int)"
    to, most = f"prefs[{a}][{r}]", f"least(s.need[{a}], s.caps[prefs[{a}][{r}]])"
    done = f"(need[{a}] - s.need[{a}])"
    fold = f"""aggregate(sequence(0, {shards * (last + 1) - 1}),
        named_struct('caps', caps, 'need', need, 'got', cast(array() as array<struct<arc: int, shard: int, lo: bigint, hi: bigint>>)),
        (s, k) -> if({most} <= 0, s, named_struct(
            'caps', transform(s.caps, (c, i) -> if(i = {to}, c - {most}, c)),
            'need', transform(s.need, (c, i) -> if(i = {a}, c - {most}, c)),
            'got', concat(s.got, array(named_struct('arc', {a}, 'shard', {to}, 'lo', {done}, 'hi', {done} + {most}))))),
        s -> s.got)"""
    got = state.select(F.explode(F.expr(fold)).alias("g")).select("g.*")
    before = Window.partitionBy("shard").orderBy("arc", "lo")
    return got.withColumn("slot0", F.sum(F.expr("hi - lo")).over(before) - F.expr("hi - lo"))


def shard_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16, vnodes: int = 32) -> DataFrame:
    """Put every row into one of ``shards`` shards; the law is ``rows``: counts are at most one apart.

    A key's place on the ring is its xxhash64; it belongs to the next virtual node clockwise, and if
    that shard is full it continues clockwise to the next shard with room.  Within an arc, keys are
    taken in ring order, so which of them overflow doesn't depend on how the input is laid out.

    The rows, without their text, are range-partitioned by ring place and checkpointed.  A row's rank in
    its arc is its index in its partition plus the rows of that arc in earlier partitions; no sort or
    window ever holds a whole arc or shard.  Ties (repeated keys) are dealt by row number of the scan, so
    a key that fills a third of the table still spreads over partitions.

    Null keys are a key like any other; a null text has size 1 and CRC 0; an empty table gives no rows.
    Other columns are ignored.  Result: key, size, text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null: that is for another law).
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, vnodes)
    shift = 64 - BUCKET_BITS
    buckets = spark.range(0, 2**BUCKET_BITS, 1, 1).select((F.col("id") - 2 ** (BUCKET_BITS - 1)).alias("bucket")).join(nodes.select(F.shiftright("pos", shift).alias("bucket"), "pos"), "bucket", "left")
    buckets = buckets.groupBy("bucket").agg(F.collect_list("pos").alias("ends"))
    buckets = buckets.select("bucket", "ends", (F.sum(F.size("ends")).over(Window.orderBy("bucket")) - F.size("ends")).alias("before"))

    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.xxhash64(key).alias("pos"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = rows.repartitionByRange("pos", "key", "tie").sortWithinPartitions("pos", "key", "text_crc32", "size", "tie").drop("tie")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("pos", shift))
    rows = rows.join(F.broadcast(buckets), "bucket")  # 2 ** BUCKET_BITS rows
    rows = cut(rows.select("key", "size", "text_crc32", F.expr("cast(before + size(filter(ends, e -> e < pos)) as int)").alias("arc"), F.shiftright("at", 33).alias("part"), "at"))

    parts = rows.groupBy("part", "arc").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = parts.select("part", "arc", "n", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    where = allocation(parts.groupBy("arc").agg(F.sum("n").alias("n")), nodes, shards, vnodes)
    ranked = rows.join(parts.drop("n"), ["part", "arc"]).withColumn("rank", F.col("at") + F.col("shift"))
    placed = ranked.join(F.broadcast(where), (ranked["arc"] == where["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # shards x arcs rows at most
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
