"""Maximum-entropy density of presences over a background.

Of all densities over the background rows whose feature means lie within a bound of the presences' own means, the one with the
highest entropy is q(x) = exp(w . f(x)) / Z, where w minimises log Z - w . mean + sum of bound * |w|. A bound is ``beta`` times
the feature's standard deviation among the presences over the root of their number.

A pass over the background gives Z and the mean and second moments of the features under the present w: a task adds up its
rows, and the sums of tasks meet by feature. The driver, which holds as many numbers as there are pairs of features, takes a
Newton step on them with the penalty (coordinate descent), until every feature's mean meets its condition of optimality. The problem is
convex, so that certifies the one solution.

Features of covariates on a 0..1 scale: linear, square, thresholds, and products of pairs. New rows are clamped to the scale.
Rows with a missing or non-finite covariate take no part and get null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest violation of a condition of optimality, in feature units (0..1).
TOLERANCE = 1e-7
#: A feature's deviation counts as at least this much, so that no bound is zero.
LEAST_DEVIATION = 0.01
#: Rows of a matrix that are summed as one block.
ROWS = 128


@dataclass(frozen=True)
class Features:
    """``knots`` thresholds a covariate; ``pairs`` of covariate numbers whose products are features."""

    covariates: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    knots: int = 3
    pairs: tuple[tuple[int, int], ...] = ()

    @property
    def names(self) -> list[str]:
        k = range(1, len(self.covariates) + 1)
        return [*(f"l{i}" for i in k), *(f"q{i}" for i in k), *(f"t{i}_{h}" for h in range(1, self.knots + 1) for i in k), *(f"p{i + 1}_{j + 1}" for i, j in self.pairs)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        low, high = np.array(self.low), np.array(self.high)
        s = np.clip((x - low) / np.where(high > low, high - low, 1.0), 0, 1)
        steps = [s > h / (self.knots + 1) for h in range(1, self.knots + 1)]
        products = [s[:, i : i + 1] * s[:, j : j + 1] for i, j in self.pairs]
        return np.hstack([s, s * s, *steps, *products]).astype(float)


def all_pairs(n: int) -> tuple[tuple[int, int], ...]:
    return tuple(combinations(range(n), 2))


def neighbouring_pairs(n: int) -> tuple[tuple[int, int], ...]:
    return tuple((k, k + 1) for k in range(n - 1))


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def _complete(df: DataFrame, covariates: tuple[str, ...]) -> DataFrame:
    """Covariates as one array of doubles in ``_x``; rows that lack one are left out."""
    return df.withColumn("_x", F.array(*[F.col(f"`{c}`").cast("double") for c in covariates])).filter(F.forall("_x", finite))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, d: int, task) -> np.ndarray:
    """Sum over tasks of the matrices that ``task`` makes of covariates; blocks of their rows meet by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = task(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            parts = [total[k : k + ROWS] for k in range(0, len(total), ROWS)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array([p.ravel() for p in parts])], ["part", "n", "v"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("v").combine_chunks()
        return pa.table({"part": table.column("part").slice(0, 1), "n": table.column("n").slice(0, 1), "v": [_matrix(values, len(values[0])).sum(axis=0)]})

    schema = "part int, n int, v array<double>"
    found = rows.select("_x").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).orderBy("part").collect()
    return np.concatenate([np.array(r.v).reshape(r.n, -1) for r in found]) if found else np.empty((0, 0))


@dataclass
class MaxEnt:
    features: Features
    weights: np.ndarray
    log_z: float
    entropy: float
    presence_mean: np.ndarray
    bound: np.ndarray
    passes: int

    def predict(self, df: DataFrame, out: str = "p", kind: str = "raw", byte: bool = False) -> DataFrame:
        """``df`` with its density: ``raw`` sums to 1 over the background, ``logistic`` is on 0..1; ``byte`` takes it to 0..255, halves to even."""
        if kind not in ("raw", "logistic"):
            raise ValueError(f"no output {kind}")
        features, weights, log_z, entropy = self.features, self.weights, self.log_z, self.entropy

        @F.pandas_udf("double")
        def density(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            score = features(np.stack([np.asarray(v, float) for v in x])) @ weights - log_z
            return pd.Series(np.exp(score) if kind == "raw" else 1 / (1 + np.exp(-score - entropy)))

        x = F.array(*[F.col(f"`{c}`").cast("double") for c in features.covariates])
        known = F.forall(x, finite)
        nothing = F.array_repeat(F.lit(0.0), len(features.covariates))
        p = F.when(known, density(F.when(known, x).otherwise(nothing)))
        return df.withColumn(out, F.bround(255 * p).cast("short") if byte else p)


def _step(g: np.ndarray, h: np.ndarray, w: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Where g . d + d h d / 2 + sum of bound * |w + d| is least, by coordinate descent."""
    d, hd, diagonal = np.zeros_like(w), np.zeros_like(w), np.diag(h).copy()
    for _ in range(1000):
        most = 0.0
        for j in range(len(w)):
            z = w[j] + d[j] - (g[j] + hd[j]) / diagonal[j]
            new = math.copysign(max(abs(z) - bound[j] / diagonal[j], 0.0), z) - w[j]
            if (move := new - d[j]) != 0.0:
                d[j] = new
                hd += move * h[:, j]
                most = max(most, abs(move) * diagonal[j])
        if most < 1e-10:
            break
    return d


def fit(frame: DataFrame, covariates: list[str], presence: str = "pres", beta: float = 1.0, knots: int = 3, pairs: tuple[tuple[int, int], ...] = (), max_passes: int = 200) -> MaxEnt:
    """The density of the rows with ``presence`` 1 over all rows of ``frame``."""
    names, d = tuple(covariates), len(covariates)
    rows = _complete(frame, names)
    limits = rows.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{k}") for k, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if limits["lo0"] is None:
        raise ValueError("no row has all covariates")
    features = Features(names, tuple(limits[f"lo{k}"] for k in range(d)), tuple(limits[f"hi{k}"] for k in range(d)), knots, pairs)

    def moments(x: np.ndarray) -> np.ndarray:
        f = features(x)
        return np.array([np.full(f.shape[1], float(len(f))), f.sum(axis=0), (f * f).sum(axis=0)])

    found = _summed(rows.filter(F.col(presence) == 1), d, moments)
    if not len(found):
        raise ValueError("no presence has all covariates")
    n, mean = found[0, 0], found[1] / found[0, 0]
    deviation = np.sqrt(np.maximum(found[2] / n - mean**2, 0))
    bound = beta * np.maximum(deviation, LEAST_DEVIATION) / math.sqrt(n)

    def under(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, and means and second moments of the features under ``w``."""
        most = float(np.maximum(w, 0).sum())  # no score is higher, as features are at most 1

        def task(x: np.ndarray) -> np.ndarray:
            f = features(x)
            q = np.exp(f @ w - most)
            f1 = np.hstack([np.ones((len(f), 1)), f])
            return (f1 * q[:, None]).T @ f1

        s = _summed(rows, d, task)
        return math.log(s[0, 0]) + most, s[0, 1:] / s[0, 0], s[1:, 1:] / s[0, 0]

    w = np.zeros(len(mean))
    log_z, expected, second = under(w)
    goal = log_z
    for passes in range(1, max_passes + 1):
        gap = mean - expected
        broken = np.where(w == 0, np.maximum(np.abs(gap) - bound, 0), np.abs(gap - bound * np.sign(w)))
        if broken.max() <= TOLERANCE:
            return MaxEnt(features, w, log_z, log_z - float(w @ expected), mean, bound, passes)
        h = second - np.outer(expected, expected) + 1e-9 * np.eye(len(w))
        move, share = _step(-gap, h, w, bound), 1.0
        promised = float(-gap @ move + bound @ (np.abs(w + move) - np.abs(w)))
        while True:  # half the step until the goal falls as the step promises
            new = w + share * move
            found_z, found_e, found_s = under(new)
            reached = found_z - float(new @ mean) + float(bound @ np.abs(new))
            if reached <= goal + 1e-4 * share * promised + 1e-13 * abs(goal) or share < 1e-6:
                break
            share /= 2
        w, log_z, expected, second, goal = new, found_z, found_e, found_s, reached
    raise RuntimeError(f"{max_passes} passes don't meet the conditions of optimality")


def feature_means(df: DataFrame, model: MaxEnt, density: str = "p") -> DataFrame:
    """(feature, expected): means of the features over the rows of ``df``, weighted by their ``density``."""
    features = model.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(q)  # rows without a density lack a covariate
            if known.any():
                x = _matrix(batch.column(0), len(features.covariates))[known]
                yield pa.record_batch([pa.array(features.names), pa.array(features(x).T @ q[known])], ["feature", "expected"])

    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in features.covariates]).alias("_x"), density)
    return rows.mapInArrow(run, "feature string, expected double").groupBy("feature").agg(F.sum("expected").alias("expected"))
