"""Streams: new documents into the vector table, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from estimora.operators.chunking import chunked
from estimora.operators.embedding import hashed
from estimora.sources.corpus import vector_table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Chunk and embed each batch of new documents(doc_id, text, source) and hand it to `sink`. Ids
    are made of document and chunk, so a batch that runs twice gives the same rows."""

    def batch(docs: DataFrame, number: int) -> None:
        chunks = hashed(chunked(docs).withColumnRenamed("chunk", "text"))
        sink(vector_table(chunks), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than the watermark are dropped
    on a stream, none in a batch."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events that follow one another within the gap."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
