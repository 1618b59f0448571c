"""Where tables of the engine's own go: new folders in the shared folder of the cluster, and versions that one small row publishes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a folder below /tmp; on a
    cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file:///tmp/spark-mnemoq-" + uuid.uuid4().hex)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The commits of a table: one row each, with its number and what it says. What no commit names isn't part of the table."""
    return spark.read.schema("commit long, " + schema).parquet(f"{path}/commits") if exists(spark, f"{path}/commits") else spark.createDataFrame([], "commit long, " + schema)


def commit(spark: SparkSession, path: str, schema: str, *rows: dict, **values) -> int:
    """Publish what was written aside: one row, or several that count together, in one file, under the next numbers; returns the first."""
    last = commits(spark, path, schema).agg(F.max("commit")).first()[0]
    number = 0 if last is None else last + 1
    names = [c.split()[0] for c in schema.split(", ")]
    said = [(number + i, *[r[n] for n in names]) for i, r in enumerate(rows or [values])]
    spark.createDataFrame(said, "commit long, " + schema).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new folder and read from there: what is read several times is made once, and a lost executor costs no more than a reading."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
