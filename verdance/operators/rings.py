"""Boundary tracing: from cells, or from directed sides, to polygons as arrays of rings.

Cells hand in their four sides with the inside on the left; sides that two cells of one polygon share cancel by aggregation.
The sides left are dealt to blocks by their first point and linked there, always by the sharpest left turn, so that parts that touch
in a point stay apart. Most rings close inside one block. Those that cross blocks are left as chains, a few for each
block: they are brought together as connected components, and put in order by pointer doubling, so that a ring of any length needs rounds as the
logarithm of the number of its chains and no task holds more than a block.

A ring turns left around a part and right around a hole; a hole goes to the smallest part of its polygon that contains it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.cover import points_in_polygons, polygon_cover
from verdance.operators.graph import components, stored
from verdance.operators.grid import RasterMeta
from verdance.operators.vector import RINGS, polygon_area, ring_area

#: Side of a block in units of the sides' coordinates, by default: cells.
BLOCK = 128.0
POINTS = "array<struct<x:double,y:double>>"


def cell_sides(cells: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1): the outlines of sets of cells (key, row, col), the inside on the left, in columns and rows upwards.

    A cell given twice is one cell; rows with a null among the three are no cells.
    """
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    side = lambda x, y, up, way: F.struct(x.alias("x"), y.alias("y"), F.lit(up).alias("up"), F.lit(way).alias("way"))
    four = F.array(side(c, -r - 1, False, 1), side(c + 1, -r - 1, True, 1), side(c, -r, False, -1), side(c, -r - 1, True, -1))
    each = cells.filter(F.col(key).isNotNull() & r.isNotNull() & c.isNotNull()).select(key, F.explode(four).alias("s")).select(key, "s.*")
    kept = each.groupBy(key, "x", "y", "up").agg(F.min("way").alias("way"), F.max("way").alias("other")).filter("way = other")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ex, ey = F.when(F.col("up"), x).otherwise(x + 1), F.when(F.col("up"), y + 1).otherwise(y)
    ahead = F.col("way") == 1
    return kept.select(key, *[F.when(ahead, a).otherwise(b).alias(n) for n, a, b in (("x0", x, ex), ("y0", y, ey), ("x1", ex, x), ("y1", ey, y))])


def _left_turn(dx: float, dy: float, ex: float, ey: float) -> float:
    """Angle from one direction to another, positive to the left; straight back counts as the sharpest right turn."""
    a = math.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    return -math.pi if a >= math.pi - 1e-12 else a


def chains_of(name: str):
    """Links the sides of a block: a row for each ring that closes and for each chain that leaves the block."""

    def run(key: tuple, sides: pa.Table) -> pa.Table:
        names = sides.column(name).combine_chunks().dictionary_encode()
        who = np.asarray(names.indices)
        p = np.stack([sides.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        n = len(p)
        points = np.concatenate([np.column_stack([who, p[:, :2]]), np.column_stack([who, p[:, 2:]])])
        at = np.unique(points, axis=0, return_inverse=True)[1].ravel()
        start, end = at[:n], at[n:]
        order = np.argsort(start, kind="stable")
        first, last = np.searchsorted(start[order], end), np.searchsorted(start[order], end, side="right")
        after = np.where(last > first, order[np.minimum(first, n - 1)], -1)
        d = p[:, 2:] - p[:, :2]
        for k in np.flatnonzero(last - first > 1):
            after[k] = max(order[first[k] : last[k]].tolist(), key=lambda m: _left_turn(*d[k], *d[m]))
        before = np.full(n, -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        follow, seen, rows = after.tolist(), np.zeros(n, bool), []
        for k in [*np.flatnonzero(before < 0).tolist(), *range(n)]:
            if seen[k]:
                continue
            run_of, m = [], k
            while m >= 0 and not seen[m]:
                seen[m] = True
                run_of.append(m)
                m = follow[m]
            q = np.array(run_of)
            straight = np.zeros(len(q), bool)
            if len(q) > 1:
                cross = d[q[:-1], 0] * d[q[1:], 1] - d[q[:-1], 1] * d[q[1:], 0]
                straight[1:] = (cross == 0) & ((d[q[:-1]] * d[q[1:]]).sum(axis=1) > 0)
            rows.append((int(who[k]), *p[k, :2], *d[k], *p[q[-1], 2:], *d[q[-1]], bool(m == k and before[k] >= 0), p[q[~straight], :2]))
        which, sx, sy, sdx, sdy, ex, ey, edx, edy, closed, pts = zip(*rows, strict=True) if rows else ([],) * 11
        flat = np.concatenate(pts) if rows else np.empty((0, 2))
        ends = np.cumsum([0, *map(len, pts)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))
        floats = {c: pa.array(v, pa.float64()) for c, v in zip(("sx", "sy", "sdx", "sdy", "ex", "ey", "edx", "edy"), (sx, sy, sdx, sdy, ex, ey, edx, edy), strict=True)}
        return pa.table({name: names.dictionary.take(pa.array(which, pa.int32())), **floats, "closed": pa.array(closed, pa.bool_()), "pts": listed})

    return run


def _turn(ax: str, ay: str, bx: str, by: str) -> Column:
    a = F.atan2(F.col(ax) * F.col(by) - F.col(ay) * F.col(bx), F.col(ax) * F.col(bx) + F.col(ay) * F.col(by))
    return F.when(a >= math.pi - 1e-12, -math.pi).otherwise(a)


def linked_rings(sides: DataFrame, key: str, block: float = BLOCK) -> DataFrame:
    """(key, pts): the closed rings that the directed ``sides`` (key, x0, y0, x1, y1) form; corners only, the first one repeated at the end.

    Each point must have as many sides of a key that end in it as start from it.
    """
    kind = sides.schema[key].dataType.simpleString()
    placed = sides.select(F.col(key), "x0", "y0", "x1", "y1", F.floor(F.col("x0") / block).alias("_i"), F.floor(F.col("y0") / block).alias("_j"))
    schema = f"`{key}` {kind}, sx double, sy double, sdx double, sdy double, ex double, ey double, edx double, edy double, closed boolean, pts {POINTS}"
    found = stored(placed.groupBy("_i", "_j").applyInArrow(chains_of(key), schema).withColumn("no", F.monotonically_increasing_id()), "chains")
    whole, open_ = found.filter("closed").select(key, "pts"), found.filter("not closed")
    if not open_.isEmpty():
        heads = open_.select(key, F.col("sx").alias("ex"), F.col("sy").alias("ey"), "sdx", "sdy", F.col("no").alias("next"))
        met = open_.select(key, "no", "ex", "ey", "edx", "edy").join(heads, [key, "ex", "ey"]).groupBy("no").agg(F.max_by("next", _turn("edx", "edy", "sdx", "sdy")).alias("next"))
        links = stored(met, "chain-links")
        home = components(links.select(F.col("no").alias("a"), F.col("next").alias("b")), "chain-rings")
        links = links.join(home.select(F.col("node").alias("no"), F.col("component").alias("ring")), "no", "left").withColumn("ring", F.coalesce("ring", "no"))
        # the chain that a ring is named after is its first; others count the steps to it
        at = stored(links.select("no", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("steps")), "chain-order")
        while not at.filter("next is not null").isEmpty():
            further = at.select(F.col("no").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"))
            moved = at.filter("next is not null").join(further, "next").select("no", "ring", F.col("then").alias("next"), (F.col("steps") + F.col("more")).alias("steps"))
            at = stored(at.filter("next is null").unionByName(moved), "chain-order")
        parts = open_.select(key, "no", "pts").join(at.select("no", "ring", "steps"), "no")
        joined = parts.groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("place"), "pts"))).alias("all"))
        whole = whole.unionByName(joined.select(key, F.flatten(F.transform("all", lambda c: c["pts"])).alias("pts")))
    corners = whole.withColumn("pts", closed_corners(F.col("pts")))
    return corners.select(key, "pts").mapInArrow(simple_rings, f"`{key}` {kind}, pts {POINTS}")


def simple_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings that meet themselves in a point, cut there: a loop may turn out to be a hole that touches its part's outline."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends, which, loops = lists.flatten(), np.cumsum([0, *np.diff(lists.offsets.to_numpy())]), [], []
        xy = np.column_stack([f.to_numpy(zero_copy_only=False) for f in flat.flatten()]) if len(flat) else np.empty((0, 2))
        for k in range(len(lists)):
            ring = xy[ends[k] : ends[k + 1] - 1]
            if len(np.unique(ring, axis=0)) == len(ring):
                which.append(k)
                loops.append(xy[ends[k] : ends[k + 1]])
                continue
            path, at = [], {}
            for p in map(tuple, ring.tolist()):
                if p in at:
                    loop = path[at[p] :]
                    which.append(k)
                    loops.append(np.array([*loop, p]))
                    for q in loop[1:]:
                        del at[q]
                    del path[at[p] + 1 :]
                else:
                    at[p] = len(path)
                    path.append(p)
            which.append(k)
            loops.append(np.array([*path, path[0]]))
        points = np.concatenate(loops) if loops else np.empty((0, 2))
        sizes = np.cumsum([0, *map(len, loops)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
        yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), listed], batch.schema.names)


def closed_corners(pts: Column) -> Column:
    """The points of a ring where it turns, the first one repeated at the end."""
    n = F.size(pts)

    def turns(p: Column, i: Column) -> Column:
        a, b = F.element_at(pts, (i + n - 1) % n + 1), F.element_at(pts, (i + 1) % n + 1)
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    corners = F.filter(pts, turns)
    return F.concat(corners, F.slice(corners, 1, 1))


def polygons_of(rings: DataFrame, key: str) -> DataFrame:
    """(key, rings) from closed rings (key, pts): parts by the place of their lowest left corner, holes with the part around them."""
    named = stored(rings.withColumn("area", ring_area(F.col("pts"))).withColumn("ring", F.monotonically_increasing_id()), "rings")
    outer, holes = named.filter("area > 0"), named.filter("area < 0")
    low = F.array_min(F.transform("pts", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    home = outer.select("ring", F.col("ring").alias("home"))
    if not holes.isEmpty():
        with_holes = outer.join(holes.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi")
        shell = F.array(F.struct(F.lit(1).alias("part"), F.lit(False).alias("hole"), "pts")).cast(RINGS)
        cells = stored(polygon_cover(with_holes.select(F.struct(F.col(key).alias("key"), "ring", "area").alias("shell"), shell.alias("rings")), "shell"), "shell-cover")
        a, b = F.element_at("pts", 1), F.element_at("pts", 2)
        inside = holes.select("ring", F.col(key).alias("key"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
        around = points_in_polygons(inside, cells, "shell", same=("key", "key"))
        home = home.unionByName(around.groupBy("ring").agg(F.min_by("zone.ring", F.struct("zone.area", "zone.ring")).alias("home")))
    order = Window.partitionBy(key).orderBy("low", "ring")
    parts = outer.select(key, "ring", low.alias("low")).withColumn("part", F.row_number().over(order)).select(F.col("ring").alias("home"), "part")
    each = named.select(key, "ring", "pts", (F.col("area") < 0).alias("hole")).join(home, "ring").join(parts, "home")
    listed = F.sort_array(F.collect_list(F.struct("part", "hole", "pts")))
    return each.groupBy(key).agg(listed.cast(RINGS).alias("rings"))


def cells_to_polygons(cells: DataFrame, meta: RasterMeta, key: str = "label", block: float = BLOCK) -> DataFrame:
    """(key, rings): each set of cells (key, row, col) as a polygon in map units; cells that touch in a corner only are parts of their own."""
    lattice = linked_rings(cell_sides(cells, key), key, block)
    placed = lattice.withColumn("pts", F.transform("pts", lambda p: F.struct((meta.xmin + p["x"] * meta.xres).alias("x"), (meta.ymax + p["y"] * meta.yres).alias("y"))))
    return polygons_of(placed, key)


def ring_count(rings: Column, hole: bool) -> Column:
    return F.size(F.filter(rings, lambda r: r["hole"] == F.lit(hole))).cast("long")


__all__ = ["cell_sides", "cells_to_polygons", "linked_rings", "polygon_area", "polygons_of", "ring_count"]
