"""Streams: files to blocks, chunks to vectors, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of events by event time; later ones than ``late`` are dropped from a stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def tail_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest_files(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Blocks of new text and Markdown files, appended once each; ends when all files that are there are done."""
    from quern.sources.files import read_text_blocks

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("document_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), "length", "content")

    def write(batch: DataFrame, number: int) -> None:
        read_text_blocks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(spark: SparkSession, chunks_path: str, schema, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Vectors of chunks as they arrive: ``embed`` takes a batch to rows of vectors; a batch that is repeated overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        embed(batch.where("status = 'active'").dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tail_parquet(spark, chunks_path, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
