"""Thin-plate-spline warping from pairs of control points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators.graph import stored
from verdance.operators.spatial import nearest
from verdance.operators.vector import RINGS, centroid

#: Different control pairs that a spline is solved for at most: the system is dense, 8 * n * n bytes on the driver.
MOST_PAIRS = 5000
#: Decimals to which sources must differ: those computed twice are the same point.
DIGITS = 7
#: Distances that a task holds at a time.
AT_ONCE = 2_000_000


def _kernel(d2: np.ndarray) -> np.ndarray:
    """r^2 log r, 0 at 0."""
    return np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)) / 2, 0.0)


class Spline:
    """Maps the plane so that each source control point goes to its target, bending as little as possible."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        keep = np.unique(source, axis=0, return_index=True)[1]  # of copies of a source point the first one counts
        self.source, target = source[np.sort(keep)], target[np.sort(keep)]
        n = len(self.source)
        if n < 3:
            raise ValueError("a spline needs three different control points")
        self.shift, self.scale = self.source.mean(axis=0), max(float(np.ptp(self.source, axis=0).max()), 1e-12)
        s = (self.source - self.shift) / self.scale
        p = np.hstack([np.ones((n, 1)), s])
        k = _kernel(((s[:, None, :] - s[None, :, :]) ** 2).sum(axis=2))
        system = np.block([[k, p], [p.T, np.zeros((3, 3))]])
        right = np.vstack([target, np.zeros((3, 2))])
        # points on one line leave the plane open: the least solution then
        flat = np.linalg.matrix_rank(p) < 3
        self.weights = np.linalg.lstsq(system, right, rcond=None)[0] if flat else np.linalg.solve(system, right)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        s, every = (self.source - self.shift) / self.scale, (points - self.shift) / self.scale
        step, out = max(1, AT_ONCE // len(s)), [np.empty((0, 2))]
        for k in range(0, len(every), step):
            q = every[k : k + step]
            d2 = (q[:, None, 0] - s[None, :, 0]) ** 2 + (q[:, None, 1] - s[None, :, 1]) ** 2
            out.append(_kernel(d2) @ self.weights[:-3] + np.hstack([np.ones((len(q), 1)), q]) @ self.weights[-3:])
        return np.concatenate(out)


def fit_spline(pairs: DataFrame, sample: int | None = None, seed: int = 0) -> Spline:
    """From all ``pairs`` (sx, sy, tx, ty) with different sources (to DIGITS decimals), of copies of a source the first by a hash.

    At most MOST_PAIRS of them; with more, an error unless ``sample`` says how many to draw.
    """
    given = pairs.select(*[F.col(c).cast("double") for c in ("sx", "sy", "tx", "ty")]).dropna()
    first = F.struct(F.xxhash64(F.lit(seed), "sx", "sy", "tx", "ty").alias("h"), "sx", "sy", "tx", "ty")
    one = given.groupBy(F.round("sx", DIGITS), F.round("sy", DIGITS)).agg(F.min(first).alias("t")).select("t.*")
    most = MOST_PAIRS if sample is None else min(sample, MOST_PAIRS)
    rows = one.orderBy("h", "sx", "sy").limit(most + (sample is None)).select("sx", "sy", "tx", "ty").toPandas().to_numpy()
    if len(rows) > most:
        raise ValueError(f"more than {MOST_PAIRS} control pairs with different sources: name a sample")
    return Spline(rows[:, :2], rows[:, 2:])


def warp_points(points: DataFrame, spline: Spline) -> DataFrame:
    """Points moved by the spline; where they were stays as primalX and primalY unless these columns are there already."""

    @F.pandas_udf("x double, y double")
    def moved(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(spline(np.column_stack([x, y])) if len(x) else np.empty((0, 2)), columns=["x", "y"])

    kept = points if {"primalX", "primalY"} <= set(points.columns) else points.withColumns({"primalX": F.col("x"), "primalY": F.col("y")})
    return kept.withColumn("_to", moved("x", "y")).withColumns({"x": F.col("_to.x"), "y": F.col("_to.y")}).drop("_to")


def warp_polygons(polygons: DataFrame, spline: Spline, first_ring_only: bool = False) -> DataFrame:
    """Polygons moved corner by corner; ``first_ring_only`` drops holes and further parts."""

    @F.pandas_udf(RINGS)
    def moved(rings: pd.Series) -> pd.Series:
        kept = [list(rs[:1] if first_ring_only else rs) for rs in rings]
        corners = [(q["x"], q["y"]) for rs in kept for r in rs for q in r["pts"]]
        to = iter(spline(np.array(corners, float).reshape(-1, 2)).tolist())
        return pd.Series([[{"part": r["part"], "hole": r["hole"], "pts": [dict(zip("xy", next(to), strict=True)) for _ in r["pts"]]} for r in rs] for rs in kept])

    return polygons.withColumn("rings", moved("rings"))


def linked_pairs(links: DataFrame, source: DataFrame, target: DataFrame, source_id: str = "source_fid", target_id: str = "target_fid", offset: int = 1, key: str = "fid") -> DataFrame:
    """Control pairs from a table of links whose ids count from 0, while those of the points count from ``offset``."""
    s = source.select((F.col(key) - offset).alias(source_id), F.col("x").alias("sx"), F.col("y").alias("sy"))
    t = target.select((F.col(key) - offset).alias(target_id), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return links.dropna(subset=[source_id, target_id]).join(s, source_id).join(t, target_id).select("sx", "sy", "tx", "ty")


def nearest_pairs(source: DataFrame, target: DataFrame, key: str = "fid") -> DataFrame:
    """Control pairs: each source point with its nearest target; several may share one."""
    near = nearest(source, target, 1, key, key)
    t = target.select(F.col(key).alias(f"b_{key}"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return source.select(key, F.col("x").alias("sx"), F.col("y").alias("sy")).join(near, key).join(t, f"b_{key}").select("sx", "sy", "tx", "ty")


def shift_polygons_to_points(polygons: DataFrame, targets: DataFrame, sources: DataFrame | None = None, box: tuple[float, float, float, float] | None = None, keep: list[str] | None = None, sample: int | None = None, key: str = "fid") -> DataFrame:
    """Polygons warped so that their centres (or ``sources``) go to the nearest targets.

    ``box``: extent (xmin, xmax, ymin, ymax) to which all inputs are cut by their points; ``keep``: attributes to retain, all
    if None; ``sample``: of the control pairs, all if None.
    """
    if sources is None:
        # written, so that each centre is worked out once
        sources = stored(polygons.select(key, centroid(F.col("rings")).alias("c")), "centres").select(key, "c.x", "c.y")
    if box:
        inside = lambda df: df.filter(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
        sources, targets = inside(sources), inside(targets)
        polygons = polygons.join(sources.select(key), key, "left_semi")
    spline = fit_spline(nearest_pairs(sources, targets, key), sample)
    out = warp_polygons(polygons, spline)
    return out if keep is None else out.select(key, "rings", *[c for c in keep if c not in (key, "rings")])
