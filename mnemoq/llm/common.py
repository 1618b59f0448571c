"""What several operators here share: the scratch folder, ASCII lower case, input columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    (local[n], as in tests) gets a folder below /tmp; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file:///tmp/spark-mnemoq-" + uuid.uuid4().hex)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partitions: int | None = None, by: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    out = (df if partitions is None else df.coalesce(partitions)).write
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that what is made of very long texts doesn't add up to more than a task's memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by stored() which nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number that is the same wherever the result is read again.

    Numbers come from the place of a row in its partition. A scan's partitions are always the same; what
    lies behind an exchange may be cut otherwise by the next job, so such rows are written down first.
    """
    out = df.withColumn(name, F.monotonically_increasing_id())
    return stored(out, "numbered") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else out


def keep_heap() -> None:
    """Let this worker keep up to 256 MB of freed memory, so that arrays made again and again aren't paged in anew each time."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc alone
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), with the condition kept above the projections that made its columns: pushed below
    them, it would hold their array expressions once more, to be computed for each element of a lambda."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where(condition & (F.col("_fence") >= 0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. lower() does just that where all is ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sql_strings(values) -> str:
    """SQL literals for an IN list; raw strings keep backslashes, and words here hold no quotes."""
    return ", ".join("r'" + v.replace("'", "''") + "'" for v in values)
