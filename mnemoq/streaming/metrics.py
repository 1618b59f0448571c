"""Counters and a histogram of a stream of events, a delta for each batch: a batch that runs again replaces its own delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemoq.operators import telemetry
from mnemoq.sources import domain, store

_SUMS = ("n", "input_tokens", "output_tokens", "saved")


def start(events: DataFrame, path: str, value: str = "latency_ms", **trigger) -> StreamingQuery:
    """Each batch's counters by kind and feature, and its histogram of ``value``, go to a folder of the batch's number."""
    def send(batch: DataFrame, number: int) -> None:
        for name, delta in (("counters", telemetry.metrics(batch)), ("histogram", telemetry.histogram(batch, value))):
            delta.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", f"{path}/state").trigger(**trigger or {"availableNow": True}).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counters").groupBy("kind", "feature").agg(*[F.sum(c).cast("long").alias(c) for c in _SUMS])


def histogram(spark: SparkSession, path: str) -> DataFrame:
    return telemetry.merged(spark.read.parquet(f"{path}/histogram").drop("batch"))


# ---- queries -------------------------------------------------------------------------------------
def _sent(s: SparkSession, d: str) -> DataFrame:
    """All events in four files, one a batch; the histogram of their input tokens."""
    path, e = store.folder(s, "metrics"), domain.tel_events(s, d)
    e.repartition(4, "seq").write.parquet(f"{path}/in")
    start(s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path, "input_tokens").awaitTermination()
    return histogram(s, path)


QUERIES = {"a34_histogram": lambda s, d: telemetry.histogram(domain.tel_events(s, d), "input_tokens"), "a34_histogram_stream": _sent}
_B = ", ".join(map(str, telemetry.BOUNDS))
ORACLES = {k: f"""{domain.duck('tel_events')} SELECT kind, feature, len(list_filter([{_B}], lambda b: b < input_tokens))::INT AS bucket, count(*) AS n, sum(input_tokens)::BIGINT AS total,
    min(input_tokens) AS least, max(input_tokens) AS most FROM tel_events WHERE input_tokens IS NOT NULL GROUP BY ALL""" for k in QUERIES}
