"""Exact Euclidean distances to the nearest presence cell, and buffers around zones, in two separable passes.

First each cell finds the nearest presence in its own column: the last one above and the next one below, by windows over bands of
rows whose ends are carried from band to band. Then the squares of these distances are combined along rows: blocks of columns
with a margin as wide as the reach take the least of (steps to the side)**2 + (distance in that column)**2. The work grows with
cells times reach, not with its square, and no cell is copied to its neighbours except into margins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a band, and columns of a block.
BAND, SPAN = 64, 256


def column_distance(cells: DataFrame, presence: str, out: str = "steps") -> DataFrame:
    """``cells`` (row, col, presence) with the rows between a cell and the nearest presence in its column, null without one."""
    at = F.when(F.coalesce(F.col(presence), F.lit(False)), F.col("row"))
    banded = cells.withColumn("_band", F.floor(F.col("row") / BAND)).withColumn("_at", at)
    ends = banded.groupBy("col", "_band").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    bands = Window.partitionBy("col").orderBy("_band")
    carried = ends.select(
        "col", "_band",
        F.last("_high", ignorenulls=True).over(bands.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
        F.first("_low", ignorenulls=True).over(bands.rowsBetween(1, Window.unboundedFollowing)).alias("_below"),
    )
    inside = Window.partitionBy("col", "_band").orderBy("row")
    near = banded.withColumn("_up", F.last("_at", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_down", F.first("_at", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    )
    both = near.join(carried, ["col", "_band"])
    steps = F.least(F.col("row") - F.coalesce("_up", "_above"), F.coalesce("_down", "_below") - F.col("row"))
    return both.withColumn(out, steps).drop("_band", "_at", "_up", "_down", "_above", "_below")


def distance_to(cells: DataFrame, presence: str, reach: float, xres: float, yres: float | None = None, out: str = "distance") -> DataFrame:
    """``cells`` (row, col, ...) with the distance of their centres from the nearest presence cell, null beyond ``reach``.

    ``cells`` are a whole grid, a row for each of its cells; a missing presence counts as none.
    """
    yres = yres or xres
    margin = int(reach // xres)
    narrow = column_distance(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), presence), presence)
    # a column is a step apart even where it has no presence in reach: cells only ask, they hand nothing on
    give = F.col("steps") * yres <= reach
    low, high = F.floor((F.col("col") - margin) / SPAN), F.floor((F.col("col") + margin) / SPAN)
    own = F.floor(F.col("col") / SPAN)
    spread = narrow.withColumn("_block", F.explode(F.when(give, F.sequence(low, high)).otherwise(F.array(own)))).withColumn("_band", F.floor(F.col("row") / BAND))

    def along(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, top = int(key[0]) * SPAN - margin, int(key[1]) * BAND
        rows, cols = (pdf["row"] - top).to_numpy(), (pdf["col"] - left).to_numpy()
        square = np.full((BAND, SPAN + 2 * margin), np.inf)
        square[rows, cols] = (pdf["steps"].to_numpy(float, na_value=np.inf) * yres) ** 2
        best = np.full((BAND, SPAN), np.inf)
        for k in range(2 * margin + 1):
            np.minimum(best, square[:, k : k + SPAN] + ((k - margin) * xres) ** 2, out=best)
        mine = (cols >= margin) & (cols < margin + SPAN)
        found = np.sqrt(best[rows[mine], cols[mine] - margin])
        return pd.DataFrame({"row": pdf["row"][mine], "col": pdf["col"][mine], out: np.where(found <= reach * (1 + 1e-12), found, np.nan)})

    found = spread.groupBy("_block", "_band").applyInPandas(along, f"row long, col long, {out} double")
    clean = found.withColumn(out, F.when(~F.isnan(out) & F.col(out).isNotNull(), F.col(out)))
    return cells.join(clean, ["row", "col"], "left")


def buffer(cells: DataFrame, presence: str, radius: float, xres: float, yres: float | None = None, out: str = "near") -> DataFrame:
    """``cells`` with whether their centre lies within ``radius`` of the centre of a presence cell."""
    yres_ = yres or xres
    if radius < min(xres, yres_) and math.isfinite(radius):
        return cells.withColumn(out, F.coalesce(F.col(presence), F.lit(False)) & F.lit(radius >= 0))
    return distance_to(cells, presence, radius, xres, yres, "_d").withColumn(out, F.col("_d").isNotNull()).drop("_d")
