"""Streaming ingest: a file stream over the landing folder; each micro-batch becomes one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provisio.plans.typed import ingest_files
from provisio.sources.documents import decoded
from provisio.sources.store import GraphStore

#: Files of one micro-batch.
BATCH_FILES = 10_000


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """filename, content_hash, document_id, status, message, counts and batch of every file taken in so far."""
    return GraphStore(spark, store).table("Ingested")


def stream_ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, name: str = "landing") -> StreamingQuery:
    """Take in text files that are new in landing, then stop.

    A micro-batch is one commit of all tables, what became of its files included, under the name and number of the batch: one that is replayed after a failure, before or after
    its commit, changes nothing twice. What is known of hashes and names is read from the buckets of the batch's files, not from all files so far.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", BATCH_FILES).load(landing)

    def take(batch: DataFrame, number: int) -> None:
        new = batch.select(F.element_at(F.split("path", "/"), -1).alias("filename"), decoded("content").alias("text"), F.sha2("content", 256).alias("content_hash"))
        ingest_files(GraphStore(spark, store), new, (name, number))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; on a stream, state is dropped after the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
