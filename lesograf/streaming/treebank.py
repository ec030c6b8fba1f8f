"""The same treebank files as a stream, with state across records; and, as an extension, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lesograf.sources.conllu import metadata, parse_lines


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, text, tokens`` of every block of the files that arrive in a folder."""
    b = spark.readStream.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return b.select(metadata(F.col("value")).alias("meta"), parse_lines(F.col("value")).alias("tokens")).select(F.col("meta")["sent_id"].alias("sent_id"), F.col("meta")["text"].alias("text"), "tokens")


def first_of_each(stream: DataFrame) -> DataFrame:
    """Later deliveries of a sent_id are dropped; the ids seen so far are kept in the state store."""
    return stream.dropDuplicates(["sent_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended to Parquet; ends by itself."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by tumbling window and type; rows later than the watermark are dropped when
    it runs as a stream. NULL times are in no window."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
