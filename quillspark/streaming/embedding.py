"""Embedding a growing table in two phases that each take up where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.embedding import Hashing, embed_documents
from ..sources import buckets


def _started(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def embed_stream(spark: SparkSession, source: str, schema: StructType, staged: str, checkpoint: str, key: str = "chunk_id", text: str = "text", model: Callable[[], object] = Hashing, once: bool = True, files: int = 1000, **how) -> StreamingQuery:
    """Phase one: new Parquet files below ``source`` are embedded, each key once, into ``staged``, a folder a batch.

    Keys that have been seen are streaming state, kept with the checkpoint; of rows that repeat a key any one is embedded.  A run that stops after a
    batch's folder was written but before the checkpoint knows embeds the same batch again and replaces its folder, so nothing is lost or doubled.
    """

    def put(batch: DataFrame, number: int) -> None:
        embed_documents(batch, text, model=model, **how).write.mode("overwrite").parquet(f"{staged}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).dropDuplicates([key])
    return _started(stream.writeStream.foreachBatch(put), checkpoint, once)


def load_stream(spark: SparkSession, staged: str, schema: StructType, index: str, checkpoint: str, key: str = "chunk_id", once: bool = True, files: int = 1000) -> StreamingQuery:
    """Phase two: staged vectors go into the index, a table of ``sources.buckets``.  A batch that is loaded again after a stop replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        buckets.upsert(batch.drop("batch"), index, key)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{staged}/batch=*")
    return _started(stream.writeStream.foreachBatch(put), checkpoint, once)
