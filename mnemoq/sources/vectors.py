"""Vectors by (kind, id, model): bytes and numbers, a table where the latest vector of a key holds, and embedding what has none yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from mnemoq.sources import domain, store

KEY = ["target_kind", "target_id", "model"]
_COMMIT, _ROWS = "segment string", "target_kind string, target_id string, model string, vector binary, segment string"


@pandas_udf(BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """Numbers as 32-bit floats, the lowest byte first; null stays null, a null entry is not a number."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@pandas_udf(ArrayType(FloatType()))
def decode(data: pd.Series) -> pd.Series:
    """The floats of such bytes; up to three bytes at the end that make no number are left out."""
    return data.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4", count=len(b) // 4))


def upsert(path: str, rows: DataFrame) -> int:
    """Add (target_kind, target_id, model, vector array<float>) as a segment of its own, published by one row. A key that is
    repeated within the rows keeps its vector of the greatest ``seq``, where there is such a column, and of these the one with
    the greatest bytes (not numbers), so that a task that runs again writes the same."""
    spark, segment = rows.sparkSession, store.folder(rows.sparkSession, "s").rsplit("/", 1)[-1]
    order = ["seq"] if "seq" in rows.columns else []
    one = rows.select(*KEY, *order, encode("vector").alias("vector")).groupBy(*KEY).agg(F.max_by("vector", F.struct(*order, "vector")).alias("vector"))
    one.write.parquet(f"{path}/vectors/segment={segment}")
    return store.commit(spark, path, _COMMIT, segment=segment)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(target_kind, target_id, model, vector binary): the vector of each key's latest segment. Segments that weren't published are not
    read; the list of segments has a row for each batch that was ever added."""
    published = store.commits(spark, path, _COMMIT)
    if not store.exists(spark, f"{path}/vectors"):
        return spark.createDataFrame([], _ROWS).drop("segment")
    rows = spark.read.schema(_ROWS).parquet(f"{path}/vectors").join(published, "segment")
    return rows.groupBy(*KEY).agg(F.max_by("vector", "commit").alias("vector"))


def missing(rows: DataFrame, spark: SparkSession, path: str, kind: str, model: str) -> DataFrame:
    """The rows (id, ..) that have no vector of this model."""
    have = stored(spark, path).where((F.col("target_kind") == kind) & (F.col("model") == model)).select(F.col("target_id").alias("id")).distinct()
    return rows.join(have, "id", "left_anti")


def reindex(rows: DataFrame, path: str, kind: str, model: str, embed: Callable[[list[str]], list], dim: int, batch: int | None = None, order: str = "id", texts: int = 64) -> int:
    """Embed the first ``batch`` rows (id, content, ..) by ``order`` that have no vector of the model (None: all of them) and
    add them; returns how many. ``embed`` is called in the tasks with up to ``texts`` texts, null as empty; a vector that has
    not ``dim`` entries is an error, and nothing is published then."""
    spark = rows.sparkSession
    todo = missing(rows, spark, path, kind, model)
    if batch is not None:
        todo = todo.orderBy(order, "id").limit(batch)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), texts):
                part = frame.iloc[i:i + texts]
                got = [list(map(float, v)) for v in embed([t or "" for t in part["content"]])]
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise ValueError(f"the model gives no {len(part)} vectors of {dim} entries")
                yield pd.DataFrame({"target_id": part["id"], "vector": got})

    made = todo.select("id", "content").mapInPandas(work, "target_id string, vector array<float>")
    made = store.written(made.select(F.lit(kind).alias("target_kind"), "target_id", F.lit(model).alias("model"), "vector"), "embedded")
    n = made.count()
    if n:
        upsert(path, made)
    return n


# ---- queries -------------------------------------------------------------------------------------
def letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often four vowels occur, and the length."""
    return [[float(t.count(x)) for x in "aeio"] + [float(len(t))] for t in texts]


def _e14(s: SparkSession, d: str) -> DataFrame:
    v = domain.read(s, d, "embeddings").selectExpr("'message' as target_kind", "cast(vec_id as string) as target_id", "concat('m', label % 2) as model", "embedding as vector")
    path = store.folder(s, "vectors")
    upsert(path, v)
    upsert(path, v.where("target_id % 3 = 0").withColumn("vector", F.reverse("vector")))
    return stored(s, path).select("target_id", "model", F.round(F.get(decode("vector"), F.lit(0)).cast("double"), 5).alias("first"))


def _e15(s: SparkSession, d: str) -> DataFrame:
    m, path = domain.messages(s, d), store.folder(s, "vectors")
    reindex(m, path, "message", "letters", letters, 5, batch=500)
    reindex(m, path, "message", "letters", letters, 5)
    return stored(s, path).select("target_id", F.array_join(F.transform(decode("vector"), lambda x: x.cast("long").cast("string")), ",").alias("vector"))


QUERIES = {
    "e13_codec": lambda s, d: domain.read(s, d, "embeddings").select("vec_id", "embedding", encode("embedding").alias("b")).select("vec_id", F.octet_length("b").alias("n"), (decode("b") == F.col("embedding").cast("array<float>")).alias("same")),
    "e14_latest_vectors": _e14, "e15_reindex": _e15,
}
_COUNT = " || ',' || ".join(f"(length(t) - length(replace(t, '{x}', '')))" for x in "aeio")
ORACLES = {
    "e13_codec": "SELECT vec_id, (4 * len(embedding))::INT AS n, CASE WHEN embedding IS NOT NULL THEN true END AS same FROM embeddings",
    "e14_latest_vectors": "SELECT vec_id::VARCHAR AS target_id, 'm' || (label % 2) AS model, round((CASE WHEN vec_id % 3 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END)::FLOAT::DOUBLE, 5) AS first FROM embeddings",
    "e15_reindex": f"SELECT conv_id || '-' || turn AS target_id, {_COUNT} || ',' || length(t) AS vector FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)",
}
