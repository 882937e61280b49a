"""Rough crowns by watershed: masked and smoothed image, segments by tile, repaired across tile borders."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators.focal import focal_mean
from verdance.operators.graph import components


def mask_below(pixels: DataFrame, value: str, conditions: list[tuple[str, float]]) -> DataFrame:
    """``value`` set to null where any of the named columns lies below its cut-off or is missing."""
    keep = F.lit(True)
    for column, cut in conditions:
        keep = keep & F.coalesce(F.col(f"`{column}`") >= cut, F.lit(False))
    return pixels.withColumn(value, F.when(keep, F.col(f"`{value}`")))


def watershed(image: np.ndarray, tolerance: float, reach: int = 1) -> np.ndarray:
    """Labels from 1 of the basins around maxima, 0 where the image is missing.

    Cells are taken from high to low. One without a labelled neighbour within ``reach`` cells starts a segment, others join
    the one with the highest peak; where two segments meet, the one whose peak rises less than ``tolerance`` above the
    meeting cell is taken over by the other. Ties go by row and column.
    """
    h, w = image.shape
    labels = np.zeros((h, w), int)
    parent, peak = [0], [np.inf]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    heap = [(-image[i, j], i, j) for i, j in zip(*np.nonzero(np.isfinite(image)), strict=True)]
    heapq.heapify(heap)
    while heap:
        low, i, j = heapq.heappop(heap)
        around = labels[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1]
        near = sorted({find(k) for k in np.unique(around[around > 0]).tolist()}, key=lambda k: (-peak[k], k))
        if not near:
            parent.append(len(parent))
            peak.append(-low)
            labels[i, j] = len(parent) - 1
            continue
        labels[i, j] = near[0]
        for other in near[1:]:
            if peak[other] + low < tolerance:
                parent[other] = near[0]
    roots = np.array([find(k) for k in range(len(parent))])
    return roots[labels]


def segment_tiles(cells: DataFrame, value: str, tolerance: float, reach: int = 1, tile: str = "tile") -> DataFrame:
    """(row, col, cell, tile, label): watershed of each tile; a label is the smallest cell of its segment, so names are global."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        image = np.full((int(pdf["row"].max()) - top + 1, int(pdf["col"].max()) - left + 1), np.nan)
        image[pdf["row"] - top, pdf["col"] - left] = pdf[value]
        found = pdf.assign(label=watershed(image, tolerance, reach)[pdf["row"] - top, pdf["col"] - left])
        found = found[found["label"] > 0]
        return found.assign(label=found.groupby("label")["cell"].transform("min"))[["row", "col", "cell", tile, "label"]]

    narrow = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("cell").cast("long").alias("cell"), F.col(tile).cast("long").alias(tile), F.col(value).cast("double").alias(value))
    return narrow.groupBy(tile).applyInPandas(one, f"row long, col long, cell long, {tile} long, label long")


def merge_across_tiles(segments: DataFrame, tile: str = "tile", value: str | None = None, tolerance: float | None = None) -> DataFrame:
    """Segments cut by a tile border, put together: those with touching cells in different tiles share the smallest label.

    With ``tolerance`` only those are put together of which the lower peak rises less than it above the highest place where
    they touch, as inside a tile; ``segments`` then holds the image's ``value``. Cells of neighbouring tiles meet by an
    equi-join on the cell's place; only cells at borders find a partner.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    height = F.lit(0.0) if tolerance is None else F.col(value).cast("double")
    moved = segments.withColumn("_s", F.explode(steps)).select((F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"), F.col(tile).alias("_tile"), F.col("label").alias("a"), height.alias("_va"))
    touching = moved.join(segments.select("row", "col", tile, F.col("label").alias("b"), height.alias("_vb")), ["row", "col"]).filter(F.col("_tile") != F.col(tile))
    edges = touching.groupBy("a", "b").agg(F.max(F.least("_va", "_vb")).alias("saddle"))
    if tolerance is not None:
        peaks = segments.groupBy("label").agg(F.max(F.col(value).cast("double")).alias("peak"))
        for side in ("a", "b"):
            edges = edges.join(peaks.select(F.col("label").alias(side), F.col("peak").alias(f"peak_{side}")), side)
        edges = edges.filter(F.least("peak_a", "peak_b") - F.col("saddle") < tolerance)
    named = components(edges.select("a", "b"))
    return segments.join(named.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def watershed_crowns(cells: DataFrame, value: str, tile: str = "tile", tolerance: float = 0.008, reach: int = 1, conditions: list[tuple[str, float]] | None = None, smooth: bool = True, border_tolerance: float | None = None) -> DataFrame:
    """Mask, 3 x 3 mean, watershed by tile and repair of the borders, in one; with ``border_tolerance`` only of cuts below it."""
    masked = mask_below(cells, value, conditions or [])
    if smooth:
        masked = focal_mean(masked, value, "_smooth").drop(value).withColumnRenamed("_smooth", value)
    segments = segment_tiles(masked, value, tolerance, reach, tile)
    if border_tolerance is None:
        return merge_across_tiles(segments, tile)
    return merge_across_tiles(segments.join(masked.select("cell", value), "cell"), tile, value, border_tolerance).drop(value)
