"""Compressing rows that are already stored, in batches: what a batch makes is written aside and published by one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoq.functions import text
from mnemoq.sources import domain, store

_COMMIT = "batch string, last long"


def create(rows: DataFrame) -> str:
    """A table of rows (rowid long, id, content): its path. Row numbers are unique, and rows that are added later have greater ones."""
    path = store.folder(rows.sparkSession, "swept")
    rows.select(F.col("rowid").cast("long").alias("rowid"), "id", "content").write.parquet(f"{path}/rows")
    return path


def add(path: str, rows: DataFrame) -> None:
    rows.select(F.col("rowid").cast("long").alias("rowid"), "id", "content").write.mode("append").parquet(f"{path}/rows")


def step(spark: SparkSession, path: str, batch: int, least: int | None = None) -> dict | None:
    """Sweep the next rows, ``batch`` of them by row number: those over the gate are compressed, those below it are kept as they
    are, and all count as swept. Returns what was done, or None where nothing is left. A sweep that stops before its commit
    leaves the table as it was, and the next one does the same rows."""
    return next(iter(_batches(spark, path, batch, least, 1)), None)


def drain(spark: SparkSession, path: str, batch: int, least: int | None = None, at_once: int = 64) -> list[dict]:
    """Steps until nothing is left: what each batch did. Up to ``at_once`` batches are made by the same jobs and published
    together, so that the number of jobs and of looks at the rows follows the batches divided by that; a sweep that stops
    loses these batches at most."""
    out = []
    while done := _batches(spark, path, batch, least, at_once):
        out += done
    return out


def _batches(spark: SparkSession, path: str, batch: int, least: int | None, at_once: int) -> list[dict]:
    last = store.commits(spark, path, _COMMIT).agg(F.max("last")).first()[0]
    rows = spark.read.parquet(f"{path}/rows").where("rowid is not null")
    todo = rows if last is None else rows.where(F.col("rowid") > last)
    # numbers of batch * at_once rows alone come to one task, and one for each batch to the driver
    numbers = todo.select("rowid").orderBy("rowid").limit(batch * at_once).withColumn("k", F.row_number().over(W.orderBy("rowid")) - 1)
    ends = sorted(r[0] for r in numbers.groupBy(F.expr(f"k div {batch}")).agg(F.max("rowid")).select("max(rowid)").collect())
    if not ends:
        return []
    names = [store.folder(spark, "b").rsplit("/", 1)[-1] for _ in ends]
    made = text.gated(todo.where(F.col("rowid") <= ends[-1]), "content", **({} if least is None else {"least": least}))
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col("rowid")))
    made = made.select("rowid", "id", "stored", "was_compressed", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("sha256"),
                       F.octet_length("content").alias("before"), F.octet_length("stored").alias("after"), F.get(F.array(*map(F.lit, names)), place).alias("batch"))
    made.write.mode("append").partitionBy("batch").parquet(f"{path}/patches")
    done = spark.read.schema("was_compressed boolean, before int, after int, batch string").option("basePath", f"{path}/patches").parquet(*[f"{path}/patches/batch={n}" for n in names])
    big = F.col("was_compressed")
    sums = done.groupBy("batch").agg(F.count("*").alias("scanned"), F.count_if(big).alias("compressed"), F.coalesce(F.sum(F.when(big, F.col("before"))), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum(F.when(big, F.col("after"))), F.lit(0)).alias("bytes_after"))
    got = {r["batch"]: {k: v for k, v in r.asDict().items() if k != "batch"} for r in sums.collect()}
    store.commit(spark, path, _COMMIT, *[{"batch": n, "last": e} for n, e in zip(names, ends, strict=True)])
    return [got[n] for n in names]


def table(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, id, content, swept, was_compressed, sha256): the rows as they are now; sha256 is of the text before it was swept."""
    rows, commits = spark.read.parquet(f"{path}/rows"), store.commits(spark, path, _COMMIT)
    plain = rows.select("rowid", "id", "content", F.lit(False).alias("swept"), F.lit(False).alias("was_compressed"), F.lit(None).cast("string").alias("sha256"))
    if not store.exists(spark, f"{path}/patches"):
        return plain
    schema = T.StructType([rows.schema["rowid"], rows.schema["id"], *[T.StructField(n, t) for n, t in (("stored", T.StringType()), ("was_compressed", T.BooleanType()), ("sha256", T.StringType()), ("batch", T.StringType()))]])
    patches = spark.read.schema(schema).parquet(f"{path}/patches").join(commits.select("batch"), "batch")
    swept = patches.select("rowid", "id", F.col("stored").alias("content"), F.lit(True).alias("swept"), F.coalesce("was_compressed", F.lit(False)).alias("was_compressed"), "sha256")
    return swept.unionByName(plain.join(patches.select("rowid"), "rowid", "left_anti"))


# ---- queries -------------------------------------------------------------------------------------
def _a14(s: SparkSession, d: str) -> DataFrame:
    path = create(domain.context_items(s, d).select(F.col("id").cast("long").alias("rowid"), "id", "content"))
    drain(s, path, 5000, 300)
    return table(s, path).where("swept").select("id", "was_compressed", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("sha"))


QUERIES = {"a14_sweep": _a14}
# no twin where the compressor has none: the gate's own
ORACLES = {"a14_sweep": text.ORACLES["g17_gate"]} if "g17_gate" in text.ORACLES else {}
