"""Whitening of vectors by shifted CholeskyQR.

The centred rows Y are never held together. A Gram pass sums Q'Q over all rows, Q being Y behind the triangular factors found so
far (each row is solved through them anew); its Cholesky factor is the next one. The first pass, and any later one whose Gram
matrix isn't safely positive, adds a shift, so that columns that depend on each other don't stop it. When Q'Q is the identity (or
nothing, along directions without variance), the product R of the factors holds all of Y'Y, and the singular value decomposition
of R gives components and variances without squaring the condition number.

The driver and each task hold matrices of the vectors' width, never rows of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from docrecon.llm.common import free_names, load

SCALE, OFFSET = 64, 1_000_000
#: Rows that one numpy step works on.
ROWS = 4096
PASSES = 8
#: Eigenvalues of Q'Q this near 1 are settled; those below NOTHING belong to directions without variance.
SETTLED, NOTHING = 1e-10, 1e-14
EPS = float(np.finfo(np.float64).eps)
#: An entry beyond this counts as this.
LARGEST = float(1 << 62)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """n rows with exact sums (one an entry) were fitted; components are unit rows by falling variance, total is the trace of the
    covariance, identity_error the measured distance of the whitened rows' covariance from the identity."""

    width: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def _integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as integers, floor(64 * c) + 1000000."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    sound = np.isfinite(values).all(axis=1)
    fits[fits] = sound
    return fits, np.clip(np.floor(SCALE * values[sound]), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly; Python's integers where 64 bits aren't enough."""
    most = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums))
    if most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(z: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row; the largest long stands for what is beyond."""
    most = max((abs(int(v)) for v in (z.min(initial=0), z.max(initial=0))), default=0)
    if z.dtype != object and most * most * z.shape[1] <= LONG:
        return (z * z).sum(axis=1)
    return np.array([min(LONG, sum(int(v) ** 2 for v in row)) for row in z], np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def _solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y behind the upper triangular factors, one solve after the other."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            _, x = _integers(batch.slice(at, ROWS).column(0), width)
            if len(x):
                yield x


def _sums(vectors: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _blocks(batches, width):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    wide = "decimal(20,0)"
    rows = vectors.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    told = {r.i: (int(r.high) << 32) + int(r.low) for r in rows}
    return (rows[0].n if rows else 0), tuple(told[i] for i in range(width) if told)


def _gram(vectors: DataFrame, width: int, rows_of) -> np.ndarray:
    """The sum of q'q over all rows, q = rows_of(integer rows): each task sums its own, Spark sums those entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, width):
            q = rows_of(x)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    t = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = v
    out[j, i] = v
    return out


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """Components of the rows of df whose vector counts: not null, of the width that most vectors have (of the longer one on a
    tie), without null and non-finite entries. None if there is none. Rows that repeat count each time. Directions without
    variance are no components, so there may be fewer than asked for: none at all where all vectors are equal."""
    vectors = _vectors(df, vector)
    widths = vectors.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if not widths:
        return None
    width = widths.w
    n, sums = _sums(vectors, width)
    if not n:
        return None
    factors: list[np.ndarray] = []
    product, eye, scale = np.eye(width), np.eye(width), float(np.sqrt(n))
    shift = 11 * (ROWS * width + width * (width + 1)) * EPS
    for _ in range(PASSES):
        gram = _gram(vectors, width, lambda x: _solved(_centred(x, n, sums) / scale, factors))
        values = np.linalg.eigvalsh(gram)
        if not factors and values[-1] <= 0 or factors and np.all((np.abs(values - 1) <= SETTLED) | (values <= NOTHING)):
            break
        more = shift * values[-1] if not factors or values[0] <= shift * values[-1] else 0.0
        factors = [*factors, np.linalg.cholesky(gram + more * eye).T]
        product = factors[-1] @ product
    # What the last pass found Q'Q to be belongs to R too: along directions without variance it is nothing.
    values, axes = np.linalg.eigh(gram)
    rest = (axes * np.sqrt(np.maximum(values, 0))) @ axes.T
    _, size, right = np.linalg.svd(rest @ product)
    keep = min(components, int((size > size[0] * width * EPS).sum()) if size[0] > 0 else 0)
    axes = right[:keep]
    axes = axes * np.sign(axes[np.arange(keep), np.abs(axes).argmax(axis=1)])[:, None] if keep else axes
    variances = size[:keep] ** 2
    error = 0.0
    if keep:
        turn = axes.T / np.sqrt(variances)
        both = _gram(vectors, width, lambda x: np.hstack([_centred(x, n, sums) @ turn, np.ones((len(x), 1))])) / n
        mean = both[:keep, keep]
        error = float(np.abs(both[:keep, :keep] - np.outer(mean, mean) - np.eye(keep)).max())
    return Whitening(width, n, sums, axes, variances, float((size**2).sum()), error)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of df whose vector counts (see fit_whitening), with all columns and deviation long (the exact sum of
    (n * x - S)^2 over the entries; the largest long where it is beyond), whitened array<double> (one a component). A column
    of df with one of these names is left out."""
    df = free_names(df, ["deviation", "whitened", "_vector"]).withColumn("_vector", F.col(vector).cast("array<double>"))
    width, n, sums, turn = model.width, model.n, model.sums, model.components.T / np.sqrt(model.variances)
    schema = StructType([*df.schema.fields, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fits, x = _integers(part.column(part.num_columns - 1), width)
                z = _deviations(x, n, sums)
                w = (z.astype(np.float64) / n) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                kept = part.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(_squares(z), pa.int64()), lists], names=schema.names)

    return df.mapInArrow(run, schema).drop("_vector")


def whitened_rows(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 32) -> DataFrame:
    """vec_id, component int, n, deviation long, whitened, explained, identity_error double: a row for each vector and component.
    An empty table, or one without variance, gives no rows; a null key stays null."""
    model = fit_whitening(df, vector, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.variances])
    out = whiten(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")), model, "vector")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_rows(load(spark, sf_dir, "embeddings"))
