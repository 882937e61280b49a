"""Curves fitted to time series of objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT = "scale double, rate double, interc double, sse double, n long, status string"
#: Values that are fitted together, padding included.
MOST_CELLS = 1_000_000


def fit_curves(t: np.ndarray, v: np.ndarray, start: tuple[float, float, float] = (2.8, 1.0, 0.0), least_times: int = 3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, rate, intercept by row), squared errors and statuses of v = scale * (e * u)^rate + intercept, u being time on 0..1.

    One series a row; cells where time or value is not finite take no part. Damped least squares (Levenberg and Marquardt)
    of all rows at once: the step between Newton's and the gradient's is chosen by whether a row's error went down, and rows
    that have settled leave.
    """
    rows = len(t)
    ok = np.isfinite(t) & np.isfinite(v)
    sorted_t = np.sort(np.where(ok, t, np.nan), axis=1)
    times = (np.diff(sorted_t, axis=1) > 0).sum(axis=1) + ok.any(axis=1)
    params, sse, status = np.full((rows, 3), np.nan), np.full(rows, np.nan), np.full(rows, "too few times", object)
    left = np.nonzero(times >= least_times)[0]
    if not len(left):
        return params, sse, status
    status[left] = "not converged"
    params[left] = start
    ok, v = ok[left], np.where(ok[left], v[left], 0.0)
    low = np.nanmin(sorted_t[left], axis=1, keepdims=True)
    base = np.e * np.where(ok, t[left] - low, 0.0) / (np.nanmax(sorted_t[left], axis=1, keepdims=True) - low)
    log = np.log(np.where(base > 0, base, 1.0))

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale, rate, interc = p[:, :1], p[:, 1:2], p[:, 2:]
        power = np.where(base > 0, np.exp(np.clip(rate * log, -700, 700)), np.where(rate > 0, 0.0, 1.0))
        return np.where(ok, scale * power + interc, 0.0), np.where(ok[:, :, None], np.stack([power, scale * power * log, np.ones_like(power)], axis=2), 0.0)

    def error_of(fit: np.ndarray) -> np.ndarray:
        return ((v - fit) ** 2).sum(axis=1)

    with np.errstate(over="ignore", invalid="ignore"):
        p, damp = params[left], np.full(len(left), 1e-3)
        fit, slope = model(p)
        error = error_of(fit)
        for _ in range(rounds):
            normal, right = np.einsum("rki,rkj->rij", slope, slope), np.einsum("rki,rk->ri", slope, v - fit)
            diagonal = np.maximum(np.einsum("rii->ri", normal), 1e-12)
            system = normal + damp[:, None, None] * diagonal[:, :, None] * np.eye(3)
            usable = np.isfinite(system).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
            inverse = np.linalg.pinv(np.where(usable[:, None, None], system, np.eye(3)), rcond=3 * np.finfo(float).eps, hermitian=True)
            new = p + np.einsum("rij,rj->ri", inverse, right)
            new_fit, new_slope = model(new)
            new_error = error_of(new_fit)
            better = usable & np.isfinite(new_error) & (new_error <= error)
            small = error - new_error <= 1e-12 * np.maximum(error, 1e-12)
            damp = np.where(better, damp / 10, damp * 10)
            p, error = np.where(better[:, None], new, p), np.where(better, new_error, error)
            fit, slope = np.where(better[:, None], new_fit, fit), np.where(better[:, None, None], new_slope, slope)
            params[left], sse[left] = p, error
            done = (better & small) | (~better & (damp > 1e12))
            if done.any():
                status[left[done]] = "ok"
                on = ~done
                left, p, damp, fit, slope, error, ok, v, base, log = (x[on] for x in (left, p, damp, fit, slope, error, ok, v, base, log))
            if not len(left):
                break
    return params, sse, status


def fit_series(df: DataFrame, key: str, time: str, value: str, start: tuple[float, float, float] = (2.8, 1.0, 0.0), least_times: int = 3) -> DataFrame:
    """One fit for each object; ``time`` is a date, a timestamp or a number. A failed fit has a status instead of numbers.

    A series becomes one row, and the rows of an Arrow batch are fitted together, those of like lengths side by side.
    """
    kind = dict(df.dtypes)[time]
    number = F.unix_date(F.col(time)) if kind == "date" else F.col(time).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(time)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            flat, ends = points.flatten(), np.append(0, np.cumsum(points.value_lengths().to_numpy()))
            t, v = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("t", "v"))
            sizes = np.diff(ends)
            order, at = np.argsort(-sizes, kind="stable"), 0
            params, sse, status = np.empty((len(sizes), 3)), np.empty(len(sizes)), np.empty(len(sizes), object)
            while at < len(order):
                width = int(sizes[order[at]])
                some = order[at : at + max(1, MOST_CELLS // max(width, 1))]
                at += len(some)
                inside = np.arange(width) < sizes[some][:, None]
                cells = np.where(inside, ends[some][:, None] + np.arange(width), 0)
                params[some], sse[some], status[some] = fit_curves(np.where(inside, t[cells], np.nan), np.where(inside, v[cells], np.nan), start, least_times)
            columns = [batch.column(key), *[pa.array(c, from_pandas=True) for c in (*params.T, sse)], pa.array(sizes.astype(np.int64)), pa.array(status, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "scale", "rate", "interc", "sse", "n", "status"])

    points = df.select(key, number.cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    rows = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("points"))
    return rows.mapInArrow(fit, f"{key} {dict(df.dtypes)[key]}, {FIT}")
