"""What a crown inspector shows, as data: the pixels around each crown or point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chips(points: DataFrame, crowns: DataFrame, pixels: DataFrame, bands: list[str], margin: float = 10.0) -> DataFrame:
    """(fid, found, xmin, xmax, ymin, ymax, pixels): the chip of each point, pixels as sorted (row, col, band values).

    A point's crown is found by exact equality of primalX and primalY; its bounds (xmin, xmax, ymin, ymax) give the window,
    the point itself where there is none. Windows meet pixels by buckets as wide as a margin; a chip is as large as its window.
    """
    bounds = crowns.select("primalX", "primalY", *[F.col(c).alias(f"c_{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
    at = points.join(bounds, ["primalX", "primalY"], "left")
    window = at.select(
        "fid", F.col("c_xmin").isNotNull().alias("found"),
        *[(F.coalesce(f"c_{c}", p) + s * margin).alias(c) for c, p, s in (("xmin", "primalX", -1), ("xmax", "primalX", 1), ("ymin", "primalY", -1), ("ymax", "primalY", 1))],
    )
    bucket = lambda c: F.floor(F.col(c) / margin)
    spread = window.withColumn("_i", F.explode(F.sequence(bucket("xmin"), bucket("xmax")))).withColumn("_j", F.explode(F.sequence(bucket("ymin"), bucket("ymax"))))
    cells = pixels.select("row", "col", "x", "y", F.array(*[F.col(f"`{b}`").cast("double") for b in bands]).alias("v"), bucket("x").alias("_i"), bucket("y").alias("_j"))
    inside = spread.join(cells, ["_i", "_j"]).filter("x between xmin and xmax and y between ymin and ymax")
    held = inside.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("row", "col", "v"))).alias("pixels"))
    return window.join(held, "fid", "left")
