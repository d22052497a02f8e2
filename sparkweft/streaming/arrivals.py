"""Fact files that arrive over time: each micro-batch replaces the units that it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweft.sources import facts
from sparkweft.sources.store import Store


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """stream, text of every new file of a folder."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = source.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("stream"), F.decode("content", "utf-8").alias("text"))


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, root: str = "/", once: bool = True) -> StreamingQuery:
    """Ingest arrivals; a batch that runs twice replaces the same units by the same facts."""

    def take(batch: DataFrame, _: int) -> None:
        found, _judged = facts.decode(facts.from_texts(batch), root)
        store.ingest(found)

    writer = arrivals(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
