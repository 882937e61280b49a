"""Polygons as arrays of rings: struct(part, hole, pts: array of struct(x, y)), each ring closed by its first point."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.operators.grid import RasterMeta
from verdance.operators.zonal import zone_extreme

RINGS = "array<struct<part:int,hole:boolean,pts:array<struct<x:double,y:double>>>>"


def _edges(pts: Column) -> Column:
    """(p, q) for each side of a ring."""
    n = F.size(pts)
    return F.zip_with(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + f(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def ring_area(pts: Column) -> Column:
    """Area with the sign of the ring's direction."""
    return _sum(_edges(pts), _cross) / 2


def polygon_area(rings: Column) -> Column:
    """Area of all parts less that of the holes, whatever the rings' directions."""
    return _sum(rings, lambda r: F.when(r["hole"], -F.abs(ring_area(r["pts"]))).otherwise(F.abs(ring_area(r["pts"]))))


def perimeter(rings: Column) -> Column:
    """Length of all rings."""
    return _sum(rings, lambda r: _sum(_edges(r["pts"]), lambda e: F.sqrt(F.pow(e["p"]["x"] - e["q"]["x"], 2) + F.pow(e["p"]["y"] - e["q"]["y"], 2))))


def centroid(rings: Column) -> Column:
    """struct(x, y): the area's centre, holes taken out."""
    def moment(axis: str) -> Column:
        def one(r: Column) -> Column:
            m = _sum(_edges(r["pts"]), lambda e: (e["p"][axis] + e["q"][axis]) * _cross(e)) / 6
            m = F.when(ring_area(r["pts"]) < 0, -m).otherwise(m)
            return F.when(r["hole"], -m).otherwise(m)

        return _sum(rings, one)

    area = polygon_area(rings)
    return F.struct((moment("x") / area).alias("x"), (moment("y") / area).alias("y"))


def remove_holes(rings: Column) -> Column:
    return F.filter(rings, lambda r: ~r["hole"])


def in_ring(pts: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring: an odd number of its sides cross the ray to the right."""
    crossed = F.filter(_edges(pts), lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < e["p"]["x"] + (y - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0))))
    return F.size(crossed) % 2 == 1


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """In a part and in none of the holes."""
    return F.exists(rings, lambda r: ~r["hole"] & in_ring(r["pts"], x, y)) & ~F.exists(rings, lambda r: r["hole"] & in_ring(r["pts"], x, y))


def keep_part_with(rings: Column, x: Column, y: Column) -> Column:
    """The part that holds the point, with its holes; null if none does. Polygons of one part stay as they are."""
    parts = F.array_distinct(F.transform(rings, lambda r: r["part"]))
    home = F.element_at(F.transform(F.filter(rings, lambda r: ~r["hole"] & in_ring(r["pts"], x, y)), lambda r: r["part"]), 1)
    return F.when(F.size(parts) <= 1, rings).when(F.exists(rings, lambda r: ~r["hole"] & in_ring(r["pts"], x, y)), F.filter(rings, lambda r: r["part"] == home))


def remove_small(polygons: DataFrame, least: float) -> DataFrame:
    """Polygons of at least that area."""
    return polygons.filter(polygon_area(F.col("rings")) >= least)


def with_bounds(polygons: DataFrame) -> DataFrame:
    """Adds xmin, xmax, ymin, ymax."""
    every = F.flatten(F.transform("rings", lambda r: r["pts"]))
    of = lambda f, axis: f(F.transform(every, lambda p: p[axis]))
    return polygons.withColumns({"xmin": of(F.array_min, "x"), "xmax": of(F.array_max, "x"), "ymin": of(F.array_min, "y"), "ymax": of(F.array_max, "y")})


def clip_ring(pts: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A closed ring cut to a box (xmin, xmax, ymin, ymax), side by side; empty if nothing is left."""
    xmin, xmax, ymin, ymax = box
    pts = pts[:-1]
    for axis, limit, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        out = []
        for k, q in enumerate(pts):
            p = pts[k - 1]
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if b >= 0:
                out.append(q)
        pts = out
        if not pts:
            return []
    return [*pts, pts[0]]


def _area(pts: list[tuple[float, float]]) -> float:
    a = np.asarray(pts)
    return abs(float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum())) / 2 if len(a) > 3 else 0.0


def clip_to_extents(polygons: DataFrame, boxes: DataFrame, key: str = "fid") -> DataFrame:
    """(key, box, rings): the polygons cut to each extent of ``boxes`` (box, xmin, xmax, ymin, ymax) that they meet.

    The bounds meet in a range join; ``boxes`` are image extents, a few rows that Spark broadcasts.
    """
    p = with_bounds(polygons.select(key, "rings")).toDF(key, "rings", "_x0", "_x1", "_y0", "_y1")
    met = p.join(boxes, (F.col("_x0") <= F.col("xmax")) & (F.col("_x1") >= F.col("xmin")) & (F.col("_y0") <= F.col("ymax")) & (F.col("_y1") >= F.col("ymin")))

    @F.pandas_udf(RINGS)
    def cut(rings: pd.Series, xmin: pd.Series, xmax: pd.Series, ymin: pd.Series, ymax: pd.Series) -> pd.Series:
        def one(rs, box):
            out = [{"part": r["part"], "hole": r["hole"], "pts": clip_ring([(q["x"], q["y"]) for q in r["pts"]], box)} for r in rs]
            return [{**r, "pts": [{"x": x, "y": y} for x, y in r["pts"]]} for r in out if len(r["pts"]) > 3]

        return pd.Series([one(r, b) for r, *b in zip(rings, xmin, xmax, ymin, ymax, strict=True)])

    return met.select(key, "box", cut("rings", "xmin", "xmax", "ymin", "ymax").alias("rings")).filter(F.size("rings") > 0)


def cell_shares(polygons: DataFrame, meta: RasterMeta, key: str = "fid") -> DataFrame:
    """(key, cell, share): the cells that each polygon touches and the share of the cell that it covers."""
    kind = polygons.schema[key].dataType.simpleString()

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fid, rings in zip(pdf[key], pdf["rings"], strict=True):
                shares: dict[int, float] = {}
                for r in rings:
                    pts = [(q["x"], q["y"]) for q in r["pts"]]
                    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
                    c0, c1 = max(0, int((min(xs) - meta.xmin) // meta.xres)), min(meta.ncol - 1, int((max(xs) - meta.xmin) // meta.xres))
                    r0, r1 = max(0, int((meta.ymax - max(ys)) // meta.yres)), min(meta.nrow - 1, int((meta.ymax - min(ys)) // meta.yres))
                    for i in range(r0, r1 + 1):
                        for j in range(c0, c1 + 1):
                            box = (meta.xmin + j * meta.xres, meta.xmin + (j + 1) * meta.xres, meta.ymax - (i + 1) * meta.yres, meta.ymax - i * meta.yres)
                            part = _area(clip_ring(pts, box)) / (meta.xres * meta.yres)
                            shares[i * meta.ncol + j + 1] = shares.get(i * meta.ncol + j + 1, 0.0) + (-part if r["hole"] else part)
                rows += [(fid, cell, share) for cell, share in shares.items() if share > 1e-12]
            yield pd.DataFrame(rows, columns=[key, "cell", "share"])

    return polygons.select(key, "rings").mapInPandas(cover, f"{key} {kind}, cell long, share double")


def polygon_cells(polygons: DataFrame, meta: RasterMeta, key: str = "fid") -> DataFrame:
    """(key, cell): cells whose centres lie in the polygons, found by exploding each polygon's bounds."""
    p = with_bounds(polygons.select(key, "rings"))
    lo = lambda c, n: F.greatest(F.floor(c), F.lit(0)).cast("long")
    cols = F.sequence(lo((F.col("xmin") - meta.xmin) / meta.xres, 0), F.least(F.floor((F.col("xmax") - meta.xmin) / meta.xres), F.lit(meta.ncol - 1)).cast("long"))
    rows = F.sequence(lo((meta.ymax - F.col("ymax")) / meta.yres, 0), F.least(F.floor((meta.ymax - F.col("ymin")) / meta.yres), F.lit(meta.nrow - 1)).cast("long"))
    met = p.filter((F.col("xmax") >= meta.xmin) & (F.col("xmin") < meta.xmax) & (F.col("ymax") > meta.ymin) & (F.col("ymin") <= meta.ymax))
    cells = met.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    x, y = meta.xmin + (F.col("col") + 0.5) * meta.xres, meta.ymax - (F.col("row") + 0.5) * meta.yres
    return cells.filter(in_polygon(F.col("rings"), x, y)).select(key, (F.col("row") * meta.ncol + F.col("col") + 1).alias("cell"))


def polygons_to_seeds(polygons: DataFrame, pixels: DataFrame | None = None, value: str | None = None, meta: RasterMeta | None = None, key: str = "fid") -> DataFrame:
    """(key, x, y): a seed for each polygon: its centroid, or with pixels the cell with the highest value inside.

    Polygons without a finite value have no seed then.
    """
    if pixels is None:
        return polygons.select(key, centroid(F.col("rings")).alias("c")).select(key, "c.x", "c.y")
    inside = polygon_cells(polygons, meta, key).join(pixels.select("cell", "x", "y", value), "cell")
    return zone_extreme(inside, key, value).select(key, "x", "y")


def outlines(polygons: DataFrame, key: str = "fid") -> DataFrame:
    """(key, ring, place, x, y): the rings' points in drawing order, for an overlay on a map."""
    rings = polygons.select(key, F.posexplode("rings").alias("ring", "r"))
    return rings.select(key, "ring", F.posexplode("r.pts").alias("place", "p")).select(key, "ring", "place", "p.x", "p.y")


def tile_borders(extents: Iterable[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2): sides of tiles that two tiles share, the outer border left out."""
    sides: dict[tuple, int] = {}
    for x0, x1, y0, y1 in extents:
        for side in ((x0, y0, x0, y1), (x1, y0, x1, y1), (x0, y0, x1, y0), (x0, y1, x1, y1)):
            sides[side] = sides.get(side, 0) + 1
    return [s for s, n in sides.items() if n > 1]
