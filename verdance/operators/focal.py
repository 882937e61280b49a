"""Neighbourhood statistics on grids (row, col, cell and a value)."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets up to which cells are copied to their neighbours; larger kernels work on blocks with a margin.
MOST_OFFSETS = 64


def circle_offsets(radius: float, xres: float, yres: float | None = None) -> list[tuple[int, int]]:
    """(row, col) steps to the cells whose centres are at most ``radius`` away."""
    yres = yres or xres
    h, w = int(radius // yres), int(radius // xres)
    return [(i, j) for i in range(-h, h + 1) for j in range(-w, w + 1) if math.hypot(i * yres, j * xres) <= radius]


def donut_offsets(outer: float, inner: float, res: float) -> list[tuple[int, int, float]]:
    """(row, col, distance in cells) to the cells between both radii; diameters in map units, made odd in cells."""
    def radius(diameter: float) -> float:
        cells = round(diameter / res)
        return ((cells + 1 if cells % 2 == 0 else cells) - 1) / 2

    out, inn = radius(outer), radius(inner)
    r = int(out) + 2
    return [(i, j, math.hypot(i, j)) for i in range(-r, r + 1) for j in range(-r, r + 1) if inn < math.hypot(i, j) <= out]


def _shifted(cells: DataFrame, offsets: Iterable[tuple]) -> DataFrame:
    """Each cell copied to those that have it as a neighbour: (row, col) of theirs, the weight and all other columns."""
    steps = F.array(*[F.struct(F.lit(o[0]).alias("i"), F.lit(o[1]).alias("j"), F.lit(float(o[2]) if len(o) > 2 else 1.0).alias("w")) for o in offsets])
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return cells.withColumn("_o", F.explode(steps)).select((F.col("row") - F.col("_o.i")).alias("row"), (F.col("col") - F.col("_o.j")).alias("col"), F.col("_o.w").alias("w"), *rest)


def focal_mean(cells: DataFrame, value: str, out: str = "mean", size: int = 3) -> DataFrame:
    """Mean over a square of cells; null where any of them is missing, so at the grid's edges too."""
    r = size // 2
    square = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    sums = _shifted(cells.select("row", "col", F.col(value).alias("_v")), square).groupBy("row", "col").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    whole = F.when(F.col("_n") == size * size, F.col("_s") / float(size * size))
    return cells.join(sums, ["row", "col"], "left").withColumn(out, whole).drop("_s", "_n")


def clump_filter(cells: DataFrame, presence: str, radius: float, res: float, least: int, out: str = "clump") -> DataFrame:
    """1 where more than ``least`` presence cells lie in the circle around the cell, else 0. Only presence cells are copied."""
    offsets = circle_offsets(radius, res)
    if len(offsets) > MOST_OFFSETS:
        return focal_blocks(cells.withColumn("_p", F.col(presence).cast("double")), "_p", [(i, j, 1.0) for i, j in offsets], out).withColumn(out, (F.coalesce(F.col(out), F.lit(0.0)) > least).cast("int")).drop("_p")
    counts = _shifted(cells.filter(F.col(presence)).select("row", "col"), offsets).groupBy("row", "col").agg(F.count("*").alias("_n"))
    return cells.join(counts, ["row", "col"], "left").withColumn(out, (F.coalesce(F.col("_n"), F.lit(0)) > least).cast("int")).drop("_n")


def remoteness(cells: DataFrame, value: str, outer: float, inner: float, res: float, out: str = "remoteness", scale: float = 1.0) -> DataFrame:
    """Mean distance (in cells, times ``scale``) to the presences in a ring around each cell; null without one or where the cell is missing."""
    offsets = donut_offsets(outer, inner, res)
    if len(offsets) > MOST_OFFSETS:
        weighted = focal_blocks(cells, value, offsets, "_s")
        sums = focal_blocks(weighted, value, [(i, j, 1.0) for i, j, _ in offsets], "_c")
    else:
        moved = _shifted(cells.select("row", "col", F.col(value).cast("double").alias("_v")), offsets)
        sums = cells.join(moved.groupBy("row", "col").agg(F.sum(F.col("w") * F.col("_v")).alias("_s"), F.sum("_v").alias("_c")), ["row", "col"], "left")
    return sums.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("_c") > 0), F.col("_s") / F.col("_c") * scale)).drop("_s", "_c")


def focal_blocks(cells: DataFrame, value: str, offsets: list[tuple[int, int, float]], out: str, side: int = 256) -> DataFrame:
    """Weighted sum over many offsets: blocks of cells with a margin as wide as the kernel, each summed in one array.

    A cell is copied to the blocks in whose margin it lies (nine at most while the kernel is narrower than a block).
    Missing cells count nothing.
    """
    reach = max(max(abs(i), abs(j)) for i, j, _ in offsets)
    span = max(side, reach)
    schema = f"row long, col long, {out} double"

    def near(c: str):
        return F.sequence(F.floor((F.col(c) - reach) / span), F.floor((F.col(c) + reach) / span))

    narrow = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    spread = narrow.withColumn("bi", F.explode(near("row"))).withColumn("bj", F.explode(near("col")))

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * span, int(key[1]) * span
        grid = np.zeros((span + 2 * reach, span + 2 * reach))
        grid[pdf["row"] - top + reach, pdf["col"] - left + reach] = np.nan_to_num(pdf["v"].to_numpy())
        sums = np.zeros((span, span))
        for i, j, w in offsets:
            sums += w * grid[reach + i : reach + i + span, reach + j : reach + j + span]
        own = pdf[(pdf["row"] >= top) & (pdf["row"] < top + span) & (pdf["col"] >= left) & (pdf["col"] < left + span)]
        return pd.DataFrame({"row": own["row"], "col": own["col"], out: sums[own["row"] - top, own["col"] - left]})

    return cells.join(spread.groupBy("bi", "bj").applyInPandas(total, schema), ["row", "col"], "left")
