"""Tables that grow: new files are taken once, states are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sessions import mean


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "chunk_id", once: bool = True) -> StreamingQuery:
    """Appends new Parquet files of ``source`` to ``target``, each exactly once; a batch that is repeated overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def windowed_stats(calls: DataFrame, ts: str, failed, latency: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls, failures and mean latency in tumbling windows; works on tables and, with a watermark, on streams."""
    rows = calls.withWatermark(ts, late) if calls.isStreaming else calls
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n_calls"), F.count_if(failed).alias("n_failed"), mean(latency).alias("mean_latency"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_calls", "n_failed", "mean_latency")


def sessions(events: DataFrame, ts: str, user: str, idle: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions that end after ``idle`` without an event."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(user, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("last_active"))
    return out.select(user, F.col("w.start").alias("start"), "last_active", "n_events")
