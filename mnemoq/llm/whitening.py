"""Embedding whitening by shifted CholeskyQR: passes over the rows sum up Gram matrices, whose Cholesky factors
orthogonalise the centred rows by triangular solves; the composed factor's singular values and vectors give the
whitening components.

1. Entries become whole numbers, floor(scale * entry), so counts, sums and deviations are exact. Components are
   fitted on each distinct vector once. Equal vectors meet in a grouped shuffle, after the task has put its own
   together, so a vector of a third of all rows is one row a task.
2. Rows are centred exactly, (n * x - S) / n, before anything is multiplied. With A the centred rows, the first
   pass factors A'A + s * I = R1'R1 with the shift s = 11 * (rows * d + d * (d + 1)) * u * |A'A|, so that the
   factor exists whatever the condition of A. The next passes take rows of A through the solves with all factors
   so far, Q = A / R1 / R2 .., and factor Q'Q, without a shift where that works, until Q'Q is the identity up to
   rounding (or MAX_PASSES). The squared condition of A'A never enters: what counts is R = .. R2 R1.
3. A = Q R, so R's singular values are those of A, and its right vectors V's eigenvectors.

Each pass is a narrow scan of the stored distinct vectors: a task keeps one d x d matrix, and the rows of the
tasks' matrices are added up by row number in a shuffle. What is sent to the tasks is d x d numbers a pass;
``max_dims`` bounds d.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are empty vectors
and those of another length than most rows have (ties: the longer); repeated rows are rows of their own, whitened
alike; an empty table gives no rows; a component without variance (one distinct vector, or a rank below it) has null
in place of whitened values, and vectors that all are equal have null for the explained share; a deviation beyond a
long is null; entries are held to +-2**52 after scaling. Eigenvalues that tie leave the choice of components open:
the first entry of largest size in a component is positive, else any basis may come. Extra columns pass through
``transform``, whatever their names (but for the prefix ``_wh_``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

COMPONENTS = 4
SCALE = 256
MAX_DIMS = 4096
MAX_PASSES = 6
TOLERANCE = 1e-13  # of Q'Q against the identity, for each of d
UNIT = 2.0**-53
ROWS = 4096  # worked on at once


@dataclass
class Model:
    """What a fit leaves: n distinct vectors, their sums, unit components (one a row) with their eigenvalues, and figures."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float
    passes: int
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float | None]:
        return [float(e / self.total) if self.total > 0 else None for e in self.eigenvalues]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """The vector's entries as whole numbers; null where the vector or one of its entries is null or not finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = float(1 << 52)
    return F.when(good, F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-far)), F.lit(far))).cast("long")))


def usable(df: DataFrame, column: str, scale: int = SCALE, max_dims: int = MAX_DIMS) -> tuple[DataFrame, int]:
    """The rows that are not dropped, with _wh_x, stored; and the length of their vectors."""
    rows = df.withColumn("_wh_x", whole_numbers(F.col(f"`{column}`"), scale)).where(F.size("_wh_x") > 0)
    rows = stored(rows, "whitening-rows")
    lengths = rows.groupBy(F.size("_wh_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0].d if lengths else 0
    if dims > max_dims:
        raise ValueError(f"vectors of {dims} entries; max_dims is {max_dims}")
    return rows.where(F.size("_wh_x") == dims), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pieces(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.column(at).slice(k, ROWS)
            if len(part):
                yield _matrix(part, dims)


def totals(fit_rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """How many rows, and the exact sums by dimension: one partial sum a task, in Python's whole numbers."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dims
        for x in _pieces(batches, 0, dims):
            n += len(x)
            # halves of 32 bits can't overflow in a piece
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            s = [a + (h << 32) + b for a, h, b in zip(s, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in s]])], names=["n", "s"])

    parts = fit_rows.select("_wh_x").mapInArrow(sums, "n long, s array<string>")
    by_dim = parts.select("n", F.posexplode("s").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    out = np.zeros(dims, object)
    for r in by_dim:
        out[r.dim] = int(r.s)
    return (int(by_dim[0].n) if by_dim else 0), out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact n * x - S."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(v) for v in sums), default=0)
    exact = x * n - sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * n - sums
    return (exact / n).astype(np.float64)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows / factor, for an upper triangular factor: forward substitution by columns, in blocks."""
    d, step, out = len(factor), 32, rows.copy()
    for k in range(0, d, step):
        end = min(k + step, d)
        if k:
            out[:, k:end] -= out[:, :k] @ factor[:k, k:end]
        for j in range(k, end):
            if j > k:
                out[:, j] -= out[:, k:j] @ factor[k:j, j]
            out[:, j] /= factor[j, j]
    return out


def gram(fit_rows: DataFrame, dims: int, made: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the outer product of what ``made`` gives for them."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        some = False
        for x in _pieces(batches, 0, dims):
            q = made(x)
            g += q.T @ q
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), width), strict=True):
                rows[k] = rows[k] + v if k in rows else v
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], names=["row", "sums"])

    parts = fit_rows.select("_wh_x").mapInArrow(products, "row int, sums array<double>")
    out = np.zeros((width, width))
    for r in parts.repartition("row").mapInArrow(add, "row int, sums array<double>").collect():  # width rows
        out[r.row] = r.sums
    return (out + out.T) / 2


def factored(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular R with R'R = g + shift * I; where rounding leaves g + shift * I indefinite, the shift grows."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T.copy()
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(g) * UNIT * float(np.abs(g).max()))


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS, max_passes: int = MAX_PASSES) -> Model:
    """The model of the distinct vectors in ``_wh_x``."""
    if not dims:
        return Model(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    distinct = stored(rows.select("_wh_x").distinct(), "whitening-fit")
    n, sums = totals(distinct, dims)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, sums)
        for r in factors:
            q = solved(q, r)
        return q

    whole = np.eye(dims)
    for k in range(max_passes):
        g = gram(distinct, dims, orthogonal, dims)
        norm = float(np.abs(np.linalg.eigvalsh(g)).max())
        if norm == 0:  # all vectors are equal
            break
        if k and np.abs(g - np.eye(dims)).max() <= dims * TOLERANCE:
            break
        r = factored(g, 0.0 if k else 11 * (n * dims + dims * (dims + 1)) * UNIT * norm)
        factors = [*factors, r]
        whole = r @ whole
    if not factors:
        whole = np.zeros((dims, dims))
    _, s, vectors = np.linalg.svd(whole)
    # below this the variance of a direction can't be told from rounding
    s = np.where(s > dims * UNIT * 4 * s.max(initial=0), s, 0.0)
    vectors = vectors * np.where(vectors[np.arange(dims), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    values = s**2 / n
    k = min(components, dims)
    model = Model(n, sums, vectors[:k], values[:k], float(values.sum()), len(factors))
    live = model.eigenvalues > 0
    if live.any():
        some = Model(n, sums, model.components[live], model.eigenvalues[live], model.total, 0)
        cov = gram(distinct, dims, lambda x: projected(x, some), int(live.sum())) / n
        model.identity_error = float(np.abs(cov - np.eye(len(cov))).max())
    return model


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)**2, exactly; None beyond a long."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * model.n + max((abs(v) for v in model.sums), default=0)
    if most * most * model.dims < 1 << 63:
        return ((x * model.n - model.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in (x.astype(object) * model.n - model.sums).tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with _wh_x), and _wh_white (a value a component, null for those without variance) and _wh_deviation in place of it."""
    names = [c for c in rows.columns if c != "_wh_x"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("_wh_white", T.ArrayType(T.DoubleType())), T.StructField("_wh_deviation", T.LongType())])
    live = model.eigenvalues > 0
    scaled = Model(model.n, model.sums, model.components, np.where(live, model.eigenvalues, 1.0), model.total, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                x = _matrix(b.column(len(names)), model.dims)
                white = [[v if good else None for v, good in zip(row, live.tolist(), strict=True)] for row in projected(x, scaled).tolist()]
                yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(len(names))], pa.array(white, pa.list_(pa.float64())), pa.array(deviations(x, model), pa.int64())], names=[*names, "_wh_white", "_wh_deviation"])

    return rows.select(*[F.col(f"`{c}`") for c in names], "_wh_x").mapInArrow(run, schema)


def whiten(df: DataFrame, column: str, components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Model]:
    """The usable rows of df with _wh_white and _wh_deviation, and the model."""
    rows, dims = usable(df, column, scale)
    model = fit(rows, dims, components)
    return transform(rows, model), model


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained()]) if model.dims else F.lit(None).cast("array<double>")
    return (out.select("vec_id", "_wh_deviation", F.posexplode("_wh_white").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_wh_deviation").alias("deviation"), "whitened",
                    F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error")))
