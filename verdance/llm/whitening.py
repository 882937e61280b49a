"""Whitening of vectors by matrix-free block subspace iteration.

Components become integers, x = floor(64 c) + 1,000,000, so that counts, sums and deviations are exact. The covariance V is
never formed: a Spark pass over the centred rows gives V Q for a block Q of columns, as the sum over rows of x (x Q). From it
the driver, which only ever holds a few columns as long as a vector, takes Rayleigh-Ritz values and vectors and their
residuals V u - e u; the passes end when the residuals certify every wanted component, else the block is orthonormalised (QR)
and goes out again. A block has twice as many columns as components are wanted, so an error shrinks by the ratio of
eigenvalue 2k+1 to eigenvalue k in each pass.

Rows are centred before they are multiplied: with the whole part m of the mean S/n and the rest r = S - n m, a centred
component is (x - m) - r/n, free of the cancellation that raw second moments would bring.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; a null id is kept as such;
repeated rows are vectors of their own; components whose eigenvalue is nothing but round-off (fewer vectors or directions than
components) are left out; vectors of different lengths, or components beyond 2**40 / 64, are an error, as are sums beyond 63
bits; equal eigenvalues give some orthonormal basis of their space; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import table
from verdance.llm.topk import usable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Residual of a certified component, as a share of its eigenvalue.
TOLERANCE = 1e-12
MAX_PASSES = 500
#: Integers beyond this are refused.
LARGEST = float(2**40)
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """What a fit knows: rows, whole and rest of n times the mean, eigenvalues (falling) and vectors, total variance, passes."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n


def integers(column: pa.Array) -> np.ndarray:
    """A batch of vectors as rows of integers."""
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.to_pylist()[:2]}")
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError("a component is too large for exact sums")
    return scaled.astype(np.int64).reshape(len(column), -1) + SHIFT


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.filter(usable(column))


def _cells(values: np.ndarray, dim: int, kind: pa.DataType) -> pa.RecordBatch:
    flat = values.ravel()
    return pa.record_batch([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.tolist(), kind)], ["dim", "cell", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, then sums by dimension, of a task's rows."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column(0))
            part = np.concatenate([[len(x)], x.sum(axis=0)]).astype(object)
            if total is not None and len(total) != len(part):
                raise ValueError(f"vectors of different lengths: {len(total) - 1} and {len(part) - 1}")
            total = part if total is None else total + part
    if total is not None:
        yield _cells(total, len(total) - 1, pa.int64())


def _summed(vectors: DataFrame, column: str, task, kind: str) -> list[tuple[int, int, float]]:
    """Sums over all tasks of what ``task`` yields; as many rows as it has cells, whatever the input."""
    parts = _usable(vectors, column).select(F.col(column)).mapInArrow(task, f"dim int, cell int, value {kind}")
    return [(r.dim, r.cell, r.value) for r in parts.groupBy("dim", "cell").agg(F.sum("value").alias("value")).orderBy("dim", "cell").collect()]


def _products(model: Whitening, q: np.ndarray):
    """A task's part of the covariance times ``q``, and of the total variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.size + 1)
        for batch in batches:
            if batch.num_rows:
                c = model.centred(integers(batch.column(0)))
                total[1:] += (c.T @ (c @ q)).ravel()
                total[0] += float((c * c).sum())
        yield _cells(total, len(q), pa.float64())

    return run


def fit(vectors: DataFrame, k: int = COMPONENTS, column: str = "embedding", tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> Whitening | None:
    """The ``k`` strongest components of all usable vectors, fewer if they have fewer directions; None without a vector."""
    sums = _summed(vectors, column, _sums, "long")
    if len({dim for dim, _, _ in sums}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({dim for dim, _, _ in sums})[:2]}")
    if not sums:
        return None
    n, s = sums[0][2], [v for _, _, v in sums[1:]]
    d = len(s)
    whole = np.array([v // n for v in s], np.int64)
    rest = np.array([v - n * (v // n) for v in s], np.int64)
    model = Whitening(n, whole, rest, np.empty(0), np.empty((d, 0)), 0.0, 0)
    k, block = min(k, d), min(d, 2 * k)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, block)))[0]
    for passes in range(1, max_passes + 1):
        got = np.array([v for _, _, v in _summed(vectors, column, _products(model, q), "double")]) / n
        y = got[1:].reshape(d, block)
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        floor = 16 * d * EPS * max(values[0], 0.0)
        residual = np.linalg.norm(image - ritz * values, axis=0)[:k]
        if (residual <= np.maximum(tolerance * values[:k], floor)).all():
            real = values[:k] > floor
            model.values, model.vectors, model.trace, model.passes = values[:k][real], ritz[:, :k][:, real], float(got[0]), passes
            return model
        q = np.linalg.qr(image)[0]
    raise RuntimeError(f"{max_passes} passes don't certify {k} components")


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S)**2, exact."""
    a, n = x - model.whole, model.n
    most = n * (int(np.abs(a).max(initial=0)) + 1)
    if x.shape[1] * most * most < 2**63:
        return pa.array(((n * a - model.rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * a.astype(object) - model.rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([Decimal(int(v)) for v in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened): each usable vector's exact deviation and its projections over the root of their variance."""
    onto = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1)) if batch.num_rows else np.empty((0, len(onto)), np.int64)
            w = model.centred(x) @ onto
            ends = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
            yield pa.record_batch([batch.column(0), deviations(x, model), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w.ravel()))], ["key", "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    out = _usable(vectors, column).select(F.col(key).alias("key"), F.col(column)).mapInArrow(run, f"key {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest entry, in size, of the covariance of the whitened vectors less the identity; a pass of its own."""
    onto = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((onto.shape[1] + 1, onto.shape[1]))
        for batch in batches:
            if batch.num_rows:
                w = model.centred(integers(batch.column(0))) @ onto
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield _cells(total, len(onto), pa.float64())

    got = np.array([v for _, _, v in _summed(vectors, column, run, "double")]).reshape(-1, onto.shape[1]) / model.n
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(onto.shape[1])).max(initial=0))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e) / model.trace) for e in model.values])
    error = identity_error(vectors, model)
    each = whiten(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
