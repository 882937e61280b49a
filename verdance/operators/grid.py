"""Raster geometry: cells, windows, tiles and neighbours."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RasterMeta:
    """A grid: numbers of rows, columns and layers, and its extent. Cells count from 1, row by row from the top."""

    nrow: int
    ncol: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    layers: int = 1
    crs: str = ""

    @property
    def xres(self) -> float:
        return (self.xmax - self.xmin) / self.ncol

    @property
    def yres(self) -> float:
        return (self.ymax - self.ymin) / self.nrow

    def row_of(self, y: Column) -> Column:
        """The row of a coordinate; the lower edge belongs to the last row, outside is null."""
        r = F.floor((self.ymax - y) / self.yres)
        return F.when((y <= self.ymax) & (y >= self.ymin), F.least(r, F.lit(self.nrow - 1)))

    def col_of(self, x: Column) -> Column:
        c = F.floor((x - self.xmin) / self.xres)
        return F.when((x >= self.xmin) & (x <= self.xmax), F.least(c, F.lit(self.ncol - 1)))

    def cell_of(self, x: Column, y: Column) -> Column:
        return self.row_of(y) * self.ncol + self.col_of(x) + 1

    def centre(self, cell: Column) -> tuple[Column, Column]:
        row, col = F.floor((cell - 1) / self.ncol), (cell - 1) % self.ncol
        return self.xmin + (col + 0.5) * self.xres, self.ymax - (row + 0.5) * self.yres


def check_crs(*metas: RasterMeta) -> None:
    """Operators work in one reference system; there is no reprojection."""
    if len({m.crs for m in metas}) > 1:
        raise ValueError(f"reference systems differ: {sorted({m.crs for m in metas})}")


def tiles_per_side(meta: RasterMeta, max_pixels: float) -> int:
    """How many tiles a side so that a tile has about ``max_pixels`` values at most, all layers counted."""
    n = meta.nrow * meta.ncol * meta.layers
    return 1 if n < max_pixels else math.ceil(math.sqrt(math.ceil(n / max_pixels)))


def tile_extents(spark: SparkSession, meta: RasterMeta, max_pixels: float) -> DataFrame:
    """(tile, xmin, xmax, ymin, ymax): equal extents, x fastest."""
    k = tiles_per_side(meta, max_pixels)
    w, h = (meta.xmax - meta.xmin) / k, (meta.ymax - meta.ymin) / k
    i, j = F.col("id") % k, F.expr(f"id div {k}")
    return spark.range(k * k).select(F.col("id").alias("tile"), (meta.xmin + i * w).alias("xmin"), (meta.xmin + (i + 1) * w).alias("xmax"), (meta.ymin + j * h).alias("ymin"), (meta.ymin + (j + 1) * h).alias("ymax"))


def tile_of(meta: RasterMeta, max_pixels: float) -> Column:
    """The tile of a pixel by its x and y."""
    k = tiles_per_side(meta, max_pixels)
    w, h = (meta.xmax - meta.xmin) / k, (meta.ymax - meta.ymin) / k
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(k - 1))
    return (inside(F.floor((F.col("x") - meta.xmin) / w)) + k * inside(F.floor((F.col("y") - meta.ymin) / h))).cast("long")


def window_size(radius: float, xres: float, yres: float | None = None) -> tuple[int, int]:
    """Columns and rows of the window around a cell that holds a circle."""
    return tuple(math.ceil(radius / r) * 2 + 1 for r in (xres, yres or xres))


def odd_sized(pixels: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """The grid without its last row or column where their number is even."""
    return pixels.filter((F.col("row") < nrow - (nrow % 2 == 0)) & (F.col("col") < ncol - (ncol % 2 == 0)))


def proximity(spark: SparkSession, nrow: int, ncol: int) -> DataFrame:
    """(pixnr, dist, place): cells of an odd-sized window, numbered down the columns, by distance from its centre."""
    if nrow % 2 == 0 or ncol % 2 == 0:
        raise ValueError("sizes must be odd")
    n = F.col("id")
    i, j = n % nrow - nrow // 2, F.expr(f"id div {nrow}") - ncol // 2
    cells = spark.range(nrow * ncol).select((n + 1).alias("pixnr"), F.sqrt((i * i + j * j).cast("double")).alias("dist"))
    from pyspark.sql import Window

    return cells.withColumn("place", F.row_number().over(Window.orderBy("dist", "pixnr")).cast("long"))  # a window's cells


def neighbours(cells: DataFrame, nrow: int, ncol: int, diagonals: bool = True) -> DataFrame:
    """(cell, neighbour): 4 or 8 for each cell, fewer at the edges; cells count row by row from 1."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonals or not (i and j))]
    row, col = F.floor((F.col("cell") - 1) / ncol), (F.col("cell") - 1) % ncol
    around = F.array(*[F.struct((row + i).alias("r"), (col + j).alias("c")) for i, j in steps])
    out = cells.select("cell", F.explode(around).alias("n")).filter(F.col("n.r").between(0, nrow - 1) & F.col("n.c").between(0, ncol - 1))
    return out.select("cell", (F.col("n.r") * ncol + F.col("n.c") + 1).cast("long").alias("neighbour"))
