"""Live variants: transcripts as they arrive, and savings by window with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.operators.telemetry import is_saving, saved
from mnemoq.sources import line_files
from mnemoq.sources.transcripts import parse


def stream_messages(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Messages of the transcripts in a folder, of both shapes, as their lines are finished; files that are read again add
    nothing within the watermark. A message without an id of its own has its file and place as one."""
    line_files.register(spark)
    m = parse(spark.readStream.format("line_files").load(folder)).withColumn("ts", F.to_timestamp("ts"))
    return m.select("id", "session_id", "role", "content", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def windowed_savings(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Savings by window and feature of a stream of events with a timestamp."""
    w = events.withWatermark("ts", late).where(is_saving())
    return w.groupBy(F.window("ts", window), "feature").agg(F.count("*").alias("n"), F.sum(saved()).alias("saved"))
