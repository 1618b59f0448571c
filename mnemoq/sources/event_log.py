"""Events and bugs as tables that grow by checked batches: a batch with a wrong row is refused whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.sources import domain, store

# fixed values: kinds of events, and the kind that each feature's events have
KINDS = ("compress", "retrieve", "hook", "wrapped_cmd", "index")
FEATURES = {
    "compress": "compress", "compress_ingest": "compress", "compress_sweep": "compress", "output_filter": "wrapped_cmd", "recall": "retrieve", "subgraph": "retrieve",
    "codegraph_index": "index", "session_brief": "hook", "session_ingest": "hook", "cmd_rewrite": "hook", "grep_redirect": "hook", "read_augment": "hook",
}
EVENT = "id string, session_id string, kind string, feature string, filter_id string, input_tokens long, output_tokens long, latency_ms long"
BUG = "id string, project string, summary string, content string, resolved boolean"
_COMMIT = "batch string"


def kind_of(feature: Column) -> Column:
    """A feature's kind of event; null for features that are none."""
    return F.coalesce(*[F.when(feature == f, k) for f, k in FEATURES.items()])


def _append(path: str, rows: DataFrame, schema: str, wrong: Column, what: str) -> int:
    """Rows are written aside, with ids that say batch and row, so that a task that runs again gives the same; then they are
    checked, and published by one row."""
    spark, batch = rows.sparkSession, store.folder(rows.sparkSession, "b").rsplit("/", 1)[-1]
    names = [c.split()[0] for c in schema.split(", ")][1:]
    rows.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("n"), *names).drop("batch").write.parquet(f"{path}/rows/batch={batch}")
    bad = spark.read.parquet(f"{path}/rows/batch={batch}").where(F.coalesce(wrong, F.lit(True))).count()
    if bad:
        raise ValueError(f"{bad} rows {what}")
    return store.commit(spark, path, _COMMIT, batch=batch)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    names = [c for c in schema.split(", ")][1:]
    if not store.exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(", ".join(["n long", *names, "batch string"])).parquet(f"{path}/rows").join(store.commits(spark, path, _COMMIT).select("batch"), "batch")
    return rows.select(F.concat_ws("-", "batch", "n").alias("id"), *[c.split()[0] for c in names])


def record(path: str, events: DataFrame) -> int:
    """Append events (all columns but id). One with an unknown or null kind makes the batch an error, and nothing is published."""
    return _append(path, events, EVENT, ~F.col("kind").isin(*KINDS), "have an unknown kind")


def events(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, EVENT)


def log_bugs(path: str, bugs: DataFrame) -> int:
    """Append bugs (project, summary, content or null); they are open. One without project or summary makes the batch an error."""
    return _append(path, bugs.withColumn("resolved", F.lit(False)), BUG, F.col("project").isNull() | F.col("summary").isNull(), "lack a project or a summary")


def bugs(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, BUG)


# ---- queries -------------------------------------------------------------------------------------
def _b11(s: SparkSession, d: str) -> DataFrame:
    e, path = domain.tel_events(s, d).withColumn("latency_ms", F.col("seq") % 100), store.folder(s, "events")
    record(path, e.where("seq % 2 = 0"))
    record(path, e.where("seq % 2 = 1"))
    return events(s, path).groupBy("kind", "feature").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("input_tokens").alias("input_tokens"), F.sum("latency_ms").alias("latency_ms"))


def _j2(s: SparkSession, d: str) -> DataFrame:
    path = store.folder(s, "bugs")
    log_bugs(path, domain.bugs(s, d).select("project", "summary", "content"))
    return bugs(s, path).groupBy("project", "resolved").agg(F.count("*").alias("n"), F.count("content").alias("n_content"), F.sum(F.length("summary")).alias("chars"))


QUERIES = {"b11_record_events": _b11, "j2_log_bugs": _j2, "j5_feature_kinds": lambda s, d: domain.tel_events(s, d).groupBy("feature", kind_of(F.col("feature")).alias("due"), "kind").agg(F.count("*").alias("n"))}
_CASES = " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in FEATURES.items())
ORACLES = {
    "b11_record_events": f"{domain.duck('tel_events')} SELECT kind, feature, count(*) AS n, count(*) AS ids, sum(input_tokens)::BIGINT AS input_tokens, sum(seq % 100)::BIGINT AS latency_ms FROM tel_events GROUP BY 1, 2",
    "j2_log_bugs": f"{domain.duck('bugs')} SELECT project, false AS resolved, count(*) AS n, count(content) AS n_content, sum(length(summary))::BIGINT AS chars FROM bugs GROUP BY 1",
    "j5_feature_kinds": f"{domain.duck('tel_events')} SELECT feature, CASE feature {_CASES} END AS due, kind, count(*) AS n FROM tel_events GROUP BY ALL",
}
