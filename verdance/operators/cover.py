"""Points in polygons by a join on cells: each polygon is covered with cells of sizes that fit its outline.

Cells are squares with sides of powers of four, so that a coordinate's cell is exact arithmetic at every size. Where a polygon's
outline doesn't enter a cell, the whole cell lies inside or outside; else the cell is cut into sixteen until few sides are left.
Such a border cell keeps the sides that enter it, and for the sides to its right only the heights at which their number turns
odd or even: a ray from a point to the right then crosses as many sides as it would of the whole polygon, by the same arithmetic.
Points meet cells of all sizes in use by equality, so no pair of a point and a polygon far from it is ever made.

Inside is even-odd over all rings: in a part and in none of the holes, for polygons whose parts don't overlap. A point
on an outline belongs to the polygon where the outline is its left or lower side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides that a border cell may keep, and cuts after which it may keep any number (many sides in one corner stay together).
FEW_SIDES, MOST_CUTS = 8, 10
#: Rounding that a side's place may have, as a share of its coordinates.
SLACK = 1e-12
CELLS = "power int, ci long, cj long, inner boolean, odd boolean, turns array<double>, sides array<struct<x0:double,y0:double,x1:double,y1:double>>"


def sides_of(rings: list[dict]) -> np.ndarray:
    """(x0, y0, x1, y1) of all rings' sides."""
    parts = [np.array([(p["x"], p["y"]) for p in r["pts"]], float).reshape(-1, 2) for r in rings]
    return np.concatenate([np.hstack([p[:-1], p[1:]]) for p in parts if len(p) > 1] or [np.empty((0, 4))])


def cover(sides: np.ndarray) -> Iterator[tuple]:
    """Rows of CELLS that cover one polygon."""
    sides = sides[sides[:, 1] != sides[:, 3]]  # level ones are never crossed by a ray to the right
    if not len(sides):
        return
    low, high = np.minimum(sides[:, :2], sides[:, 2:]), np.maximum(sides[:, :2], sides[:, 2:])
    slope = (sides[:, 2] - sides[:, 0]) / (sides[:, 3] - sides[:, 1])
    extent = float((high.max(axis=0) - low.min(axis=0)).max())
    power = 2 * math.ceil(math.log2(extent) / 2)
    first, last = (np.floor(v * 2.0**-power).astype(int) for v in (low.min(axis=0), high.max(axis=0)))
    todo = [(power, i, j, np.arange(len(sides)), 0) for i in range(first[0], last[0] + 1) for j in range(first[1], last[1] + 1)]
    while todo:
        power, i, j, some, cuts = todo.pop()
        size = 2.0**power
        x0, y0, x1, y1 = i * size, j * size, (i + 1) * size, (j + 1) * size
        some = some[(low[some, 1] < y1) & (high[some, 1] > y0)]
        # where a side runs inside the cell's rows; it is kept if rounding leaves it in doubt
        one, two = (sides[some, 0] + (np.clip(y, low[some, 1], high[some, 1]) - sides[some, 1]) * slope[some] for y in (y0, y1))
        near = SLACK * (np.abs(sides[some]).max(axis=1, initial=0) + size)
        right = np.minimum(one, two) > x1 + near
        some = some[kept := np.maximum(one, two) >= x0 - near]
        right = right[kept]
        real, beyond = some[~right], some[right]
        # a side to the right counts from its lower end to its upper one; where two of them meet, their turns cancel
        at, n = np.unique(np.concatenate([np.maximum(low[beyond, 1], y0), high[beyond, 1]]), return_counts=True)
        at = at[n % 2 == 1]
        odd, turns = bool((at <= y0).sum() % 2), at[(at > y0) & (at < y1)]
        if not len(real) and not len(turns):
            if odd:
                yield power, i, j, True, True, [], []
        elif len(real) + len(turns) <= FEW_SIDES or cuts >= MOST_CUTS:
            yield power, i, j, False, odd, turns.tolist(), [dict(zip(("x0", "y0", "x1", "y1"), s, strict=True)) for s in sides[real].tolist()]
        else:
            todo += [(power - 2, 4 * i + a, 4 * j + b, some, cuts + 1) for a in range(4) for b in range(4)]


def polygon_cover(polygons: DataFrame, key: str = "fid") -> DataFrame:
    """(key, cells as in CELLS) of each polygon."""
    names = [key, *(c.split()[0] for c in CELLS.split(", "))]
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.list_(side)]
        for batch in batches:
            which, rows = [], []
            for k, rings in enumerate(batch.column(1).to_pylist()):
                for row in cover(sides_of(rings or [])):
                    which.append(k)
                    rows.append(row)
                if len(rows) > 20_000:
                    yield pa.record_batch([batch.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                    which, rows = [], []
            if rows:
                yield pa.record_batch([batch.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return polygons.select(key, "rings").mapInArrow(run, f"`{key}` {kind}, {CELLS}")


def _inside(x: Column, y: Column) -> Column:
    """Whether a point of a cell lies in the cell's polygon."""
    turns = F.size(F.filter("turns", lambda t: t <= y))
    crossed = F.size(F.filter("sides", lambda s: ((s["y0"] > y) != (s["y1"] > y)) & (x < s["x0"] + (y - s["y0"]) * (s["x1"] - s["x0"]) / F.nullif(s["y1"] - s["y0"], F.lit(0.0)))))
    return F.col("inner") | ((F.col("odd").cast("int") + turns + crossed) % 2 == 1)


def points_in_polygons(points: DataFrame, cells: DataFrame, key: str = "fid", zone: str = "zone", x: str = "x", y: str = "y", same: tuple[str, str] | None = None) -> DataFrame:
    """``points`` with the ``key`` of each polygon that they lie in as ``zone``; ``cells``: polygon_cover(), already written.

    A point comes once for each polygon around it, and not at all where there is none. Places are looked up, not points: those in
    one place share the test, and get its polygons by a join on the place, which adaptive execution splits where it is hot.
    ``same``: a column of the points and a field of the polygons' key that must agree.
    """
    powers = sorted(r.power for r in cells.select("power").distinct().collect())  # as many as there are sizes of cells
    at = [F.struct(F.lit(p).alias("power"), F.floor(F.col("_x") * 2.0**-p).alias("ci"), F.floor(F.col("_y") * 2.0**-p).alias("cj")) for p in powers]
    place = ["_x", "_y", *(["_same"] if same else [])]
    whole = points.select(F.struct(*points.columns).alias("_point"), F.col(x).alias("_x"), F.col(y).alias("_y"), *([F.col(same[0]).alias("_same")] if same else []))
    placed = whole.select(*place).distinct().withColumn("_at", F.explode(F.array(*at) if at else F.expr("cast(array() as array<struct<power:int,ci:long,cj:long>>)")))
    placed = placed.select(*place, F.col("_at.power").alias("power"), F.col("_at.ci").alias("ci"), F.col("_at.cj").alias("cj"))
    named = cells.withColumnRenamed(key, "_zone")
    meet = ["power", "ci", "cj"]
    if same:
        named, meet = named.withColumn("_same", F.col(f"_zone.{same[1]}")), [*meet, "_same"]
    met = placed.join(named, meet).filter(_inside(F.col("_x"), F.col("_y"))).select(*place, "_zone")
    return whole.join(met, place).select("_point.*", F.col("_zone").alias(zone))
