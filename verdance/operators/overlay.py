"""Planar overlay of polygons: union, intersection and difference, by tiles.

Polygons are cut to the tiles that they touch, so that a tile holds closed rings and nothing reaches beyond it. Inside a
tile the sides of all rings are split where they cross or touch; each piece then counts how many rings of either side of the
operation wind around the points just left and right of it, and stays in the result if only one of both lies inside. Along tile
borders the results of both tiles run in opposite directions and cancel. What is left is linked to rings as the outlines of cells are,
over tiles and of any length.

Of a tile's polygons on one side of the operation the union is formed first, by a few at a time, so that the other side meets its
outline only, however many overlap.

Coordinates are rounded to a fixed grid (``digits`` decimals), so that points computed twice are the same point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators.rings import linked_rings, polygons_of
from verdance.operators.vector import clip_ring, with_bounds

DIGITS = 7
#: Polygons that are put together at once, and results for different polygons that a task remembers.
BATCH, KNOWN = 16, 10_000
#: Pairs of sides that are looked at together.
PAIRS = 200_000
OPERATIONS = {"union": lambda a, b: (a > 0) | (b > 0), "intersection": lambda a, b: (a > 0) & (b > 0), "difference": lambda a, b: (a > 0) & ~(b > 0)}
SIDES = "x0 double, y0 double, x1 double, y1 double"


def wound(pts: np.ndarray, hole: bool) -> np.ndarray:
    """A closed ring turned so that parts turn left and holes turn right."""
    area = (pts[:-1, 0] * pts[1:, 1] - pts[1:, 0] * pts[:-1, 1]).sum()
    return pts[::-1] if (area < 0) != hole else pts


def split(p: np.ndarray, digits: int) -> np.ndarray:
    """Sides (x0, y0, x1, y1, ...) cut where they cross or touch each other; columns beyond the fourth are carried."""
    a, b = p[:, :2], p[:, 2:4]
    d = b - a
    low, high = np.minimum(a, b), np.maximum(a, b)
    near = 10.0**-digits
    order = np.argsort(low[:, 0], kind="stable")
    ends = np.searchsorted(low[order, 0], high[order, 0] + near, side="right")
    many = np.maximum(ends - np.arange(len(p)) - 1, 0)
    which, where = [np.arange(0)], [np.empty((0, 2))]

    def on(k: np.ndarray, q: np.ndarray) -> None:
        """Points q that lie on sides k cut them."""
        length = np.einsum("ij,ij->i", d[k], d[k])
        t = np.clip(np.einsum("ij,ij->i", q - a[k], d[k]) / length, 0, 1)
        off = np.abs(q - a[k] - t[:, None] * d[k]).max(axis=1)
        some = (off <= near) & (t > 0) & (t < 1)
        which.append(k[some])
        where.append(q[some])

    # pairs of sides whose bounds meet, some at a time
    begin, total = 0, np.concatenate([[0], np.cumsum(many)])
    while begin < len(p):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        n = many[begin:end]
        k = np.repeat(order[begin:end], n)
        m = order[np.arange(len(k)) - np.repeat(total[begin:end] - total[begin], n) + np.repeat(np.arange(begin, end) + 1, n)]
        begin = end
        meet = (low[m, 1] <= high[k, 1] + near) & (high[m, 1] >= low[k, 1] - near)
        k, m = k[meet], m[meet]
        for q in (a, b):
            on(k, q[m])
            on(m, q[k])
        cross = d[k, 0] * d[m, 1] - d[k, 1] * d[m, 0]
        slanted = cross != 0
        k, m, cross = k[slanted], m[slanted], cross[slanted]
        w = a[m] - a[k]
        t = (w[:, 0] * d[m, 1] - w[:, 1] * d[m, 0]) / cross
        u = (w[:, 0] * d[k, 1] - w[:, 1] * d[k, 0]) / cross
        meet = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        k, m = k[meet], m[meet]
        q = np.round(a[k] + t[meet, None] * d[k], digits)
        which += [k, m]
        where += [q, q]
    # each side's ends and cuts in order, copies left out
    every = np.arange(len(p))
    k, q = np.concatenate([every, *which, every]), np.concatenate([a, *where, b])
    along = np.einsum("ij,ij->i", q - a[k], d[k])
    along[: len(p)], along[len(k) - len(p) :] = -np.inf, np.inf
    order = np.lexsort((along, k))
    k, q = k[order], q[order]
    kept = np.concatenate([[True], (k[1:] != k[:-1]) | (q[1:] != q[:-1]).any(axis=1)])[: len(k)]
    k, q = k[kept], q[kept]
    one = k[1:] == k[:-1]
    return np.hstack([q[:-1][one], q[1:][one], p[k[:-1][one], 4:]])


def windings(pieces: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the pieces' rings wind around the points just left and just right of each piece, for each column of weights.

    Pieces are different and meet at their ends only; a weight says how many rings more run along the piece than against it.
    """
    x0, y0, x1, y1 = pieces.T
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    left = np.zeros((len(pieces), weights.shape[1]))
    steep = np.abs(y1 - y0) >= np.abs(x1 - x0)
    for which, (px, py, ax, ay, bx, by) in ((steep, (mx, my, x0, y0, x1, y1)), (~steep, (my, -mx, y0, -x0, y1, -x1))):
        # for flat pieces the plane is turned by a right angle, so that a ray to the right crosses the piece
        up, down = (ay < by), (ay > by)
        turn = weights * (up.astype(int) - down.astype(int))[:, None]
        some = np.flatnonzero(which)
        step = max(1, PAIRS // max(len(pieces), 1))
        for k in (some[n : n + step] for n in range(0, len(some), step)):
            own = py[k][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = ax + (own - ay) * (bx - ax) / (by - ay)
            hit = ((ay > own) != (by > own)) & (x > px[k][:, None])
            hit[np.arange(len(k)), k] = False
            # going up, a piece has its left on the left: the ray from there crosses the piece as well
            left[k] = hit.astype(float) @ turn + np.where(up[k][:, None], weights[k], 0)
    return left, left - weights


def outline(sides: np.ndarray, operation: str, digits: int = DIGITS) -> np.ndarray:
    """Directed sides of the result, the inside on the left; ``sides``: (x0, y0, x1, y1, in the first set, in the second)."""
    if not len(sides):
        return np.empty((0, 4))
    pieces = split(sides, digits)
    back = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[back] = np.hstack([pieces[back][:, 2:4], pieces[back][:, :2], -pieces[back][:, 4:]])
    which, at = np.unique(pieces[:, :4], axis=0, return_inverse=True)
    weights = np.zeros((len(which), 2))
    np.add.at(weights, at.ravel(), pieces[:, 4:6])
    real = (weights != 0).any(axis=1)
    which, weights = which[real], weights[real]
    left, right = windings(which, weights)
    inside = OPERATIONS[operation]
    a, b = inside(left[:, 0], left[:, 1]), inside(right[:, 0], right[:, 1])
    return np.concatenate([which[a & ~b], which[b & ~a][:, [2, 3, 0, 1]]])


def _net(a: np.ndarray, b: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(who, from, to): what is left of each one's directed intervals of a line where those that run both ways cancel."""
    way = np.sign(b - a)
    who, at, step = np.tile(who, 2), np.concatenate([np.minimum(a, b), np.maximum(a, b)]), np.concatenate([way, -way])
    order = np.lexsort((at, who))
    who, at, step = who[order], at[order], step[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1])])[: len(who)])
    # each one's steps sum up to 0
    who, at, way = who[first], at[first], np.cumsum(np.add.reduceat(step, first)) if len(first) else step
    some = np.flatnonzero(way)
    return who[some], np.where(way[some] > 0, at[some], at[some + 1]), np.where(way[some] > 0, at[some + 1], at[some])


def within_box(sides: np.ndarray, box: tuple[float, float, float, float], digits: int) -> np.ndarray:
    """Closed sides drawn into a box (xmin, xmax, ymin, ymax): what lies outside goes to its border, where it cancels.

    Inside the box they wind around each point as before.
    """
    xmin, xmax, ymin, ymax = box
    a, d = sides[:, :2], sides[:, 2:4] - sides[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.column_stack([(xmin - a[:, 0]) / d[:, 0], (xmax - a[:, 0]) / d[:, 0], (ymin - a[:, 1]) / d[:, 1], (ymax - a[:, 1]) / d[:, 1]])
    t = np.sort(np.clip(np.nan_to_num(t, nan=0.0), 0, 1), axis=1)[:, :, None]
    pts = np.round(np.concatenate([a[:, None], a[:, None] + t * d[:, None], sides[:, None, 2:4]], axis=1), digits)
    pts = np.clip(pts, (xmin, ymin), (xmax, ymax))
    p = np.concatenate([pts[:, :-1], pts[:, 1:]], axis=2).reshape(-1, 4)
    p = p[(p[:, :2] != p[:, 2:4]).any(axis=1)]
    out, left = [], np.ones(len(p), bool)
    for axis, limit in ((0, xmin), (0, xmax), (1, ymin), (1, ymax)):
        on = left & (p[:, axis] == limit) & (p[:, axis + 2] == limit)
        left &= ~on
        _, s, e = _net(p[on, 1 - axis], p[on, 3 - axis], np.zeros(on.sum(), int))
        line = np.full(len(s), limit)
        out.append(np.column_stack([line, s, line, e] if axis == 0 else [s, line, e, line]))
    return np.concatenate([p[left], *out])


def dissolved(polygons: list[np.ndarray], digits: int) -> np.ndarray:
    """Directed sides of the union of polygons, each given by its sides.

    A few that lie near each other are put together first, then the results two by two: where many overlap, what is left of
    them is short, and sides that lie inside others meet few of them. Copies count once.
    """
    found = list({p.tobytes(): p for p in polygons if len(p)}.values())
    found.sort(key=lambda p: (float(p[:, 0].min()), float(p[:, 1].min())))
    size = BATCH
    while True:
        found = [outline(np.hstack([q, np.tile((1.0, 0.0), (len(q), 1))]), "union", digits) for q in (np.concatenate(found[k : k + size]) for k in range(0, len(found), size))]
        size = 2
        if len(found) <= 1:
            return found[0] if found else np.empty((0, 4))


def tiled(polygons: DataFrame, key: str, tile: float, digits: int) -> DataFrame:
    """(key, i, j, x, y, size): the rings of each polygon cut to the tiles that they touch, one after the other, and their sizes."""
    cell = lambda c: F.floor(F.col(c) / tile)
    boxed = with_bounds(polygons.select(key, "rings")).filter("xmin is not null")
    spread = boxed.withColumn("i", F.explode(F.sequence(cell("xmin"), cell("xmax")))).withColumn("j", F.explode(F.sequence(cell("ymin"), cell("ymax"))))
    kind = polygons.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (i, j, rings) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True)):
                box = (i * tile, (i + 1) * tile, j * tile, (j + 1) * tile)
                xs, ys, size = [], [], []
                for r in rings:
                    pts = np.round(clip_ring([(round(q["x"], digits), round(q["y"], digits)) for q in r["pts"]], box), digits)
                    if len(pts) > 3:
                        pts = wound(pts, r["hole"])
                        xs += pts[:, 0].tolist()
                        ys += pts[:, 1].tolist()
                        size.append(len(pts))
                if xs:
                    rows.append((k, i, j, xs, ys, size))
            k, i, j, x, y, size = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.record_batch([batch.column(0).take(pa.array(k, pa.int64())), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.list_(pa.float64())), pa.array(size, pa.list_(pa.int32()))], [key, "i", "j", "x", "y", "size"])

    return spread.select(key, "i", "j", "rings").mapInArrow(cut, f"`{key}` {kind}, i long, j long, x array<double>, y array<double>, size array<int>")


def _spread(tiles: DataFrame, *by: str) -> DataFrame:
    """Tiles over as many tasks as a shuffle has: a tile is few bytes and much work, so that adaptive execution would put all in one."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _sides(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sides of one polygon's rings."""
    p = np.column_stack([x[:-1], y[:-1], x[1:], y[1:]]).astype(float)
    inner = np.ones(len(p), bool)
    inner[np.cumsum(size)[:-1] - 1] = False  # from the end of a ring to the next one
    return p[inner & (p[:, :2] != p[:, 2:4]).any(axis=1)]


def _polygons(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [_sides(*rings) for rings in zip(pdf["x"], pdf["y"], pdf["size"], strict=True)]


def _merged(sides: DataFrame, key: str, tile: float, digits: int) -> DataFrame:
    """Rings of the tiles' sides: those along tile borders are split at each other's ends and cancel first."""
    x, y = F.col("x0"), F.col("y0")
    upright, level = (x == F.col("x1")) & (F.floor(x / tile) * tile == x), (y == F.col("y1")) & (F.floor(y / tile) * tile == y)
    kind = sides.schema[key].dataType.simpleString()
    border = sides.withColumn("_up", upright).filter(upright | level)
    along = lambda c: F.floor(c / tile)
    placed = border.withColumn("_line", F.when(F.col("_up"), x).otherwise(y)).withColumn("_tile", F.when(F.col("_up"), along((y + F.col("y1")) / 2)).otherwise(along((x + F.col("x1")) / 2)))

    def cancel(pdf: pd.DataFrame) -> pd.DataFrame:
        """All keys' sides along one border of a tile: of each key intervals that run one way only stay."""
        up, line = bool(pdf["_up"].iloc[0]), float(pdf["_line"].iloc[0])
        a, b = (pdf[c].to_numpy() for c in (("y0", "y1") if up else ("x0", "x1")))
        codes, names = pd.factorize(pdf[key])
        who, s, e = _net(a, b, codes)
        line = np.full(len(s), line)
        ends = {"x0": line, "y0": s, "x1": line, "y1": e} if up else {"x0": s, "y0": line, "x1": e, "y1": line}
        return pd.DataFrame({key: names.take(who), **ends})

    kept = placed.groupBy("_up", "_line", "_tile").applyInPandas(cancel, f"`{key}` {kind}, {SIDES}")
    return polygons_of(linked_rings(sides.filter(~(upright | level)).unionByName(kept), key, tile), key)


def union(polygons: DataFrame, by: str, tile: float, digits: int = DIGITS) -> DataFrame:
    """(by, rings): the polygons (by, rings) of each value of ``by`` as one, where none overlaps itself any more.

    A tile's polygons of one value meet in one task, so ``tile`` should be as wide as holds some thousands of sides.
    """
    kind = polygons.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = dissolved(_polygons(pdf), digits)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(found), **dict(zip(("x0", "y0", "x1", "y1"), found.T, strict=True))})

    sides = tiled(polygons.filter(F.col(by).isNotNull()), by, tile, digits).dropDuplicates()
    sides = _spread(sides, by, "i", "j").groupBy(by, "i", "j").applyInPandas(one, f"`{by}` {kind}, {SIDES}")
    return _merged(sides, by, tile, digits)


def combine(polygons: DataFrame, others: DataFrame, operation: str, key: str, tile: float, digits: int = DIGITS) -> DataFrame:
    """(key, rings): what each polygon has in common with the ``others`` (rings) taken together, or has beside them.

    ``operation``: ``intersection`` or ``difference``. Polygons and others meet by tile; polygons of which nothing is left have no row.
    """
    kind = polygons.schema[key].dataType.simpleString()
    cut = tiled(polygons.filter(F.col(key).isNotNull()), key, tile, digits)
    against = tiled(others.select(F.lit(0).alias("_other"), "rings"), "_other", tile, digits).drop("_other").dropDuplicates()

    def one(place: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        cover, known = dissolved(_polygons(theirs), digits), {}
        names, found = [], []
        for name, some in mine.groupby(key).indices.items():
            own = np.concatenate(_polygons(mine.iloc[some]))
            same = own.tobytes()
            if same not in known:  # copies of a polygon have the same rest
                if len(known) >= KNOWN:
                    known.clear()
                ends = np.concatenate([own[:, :2], own[:, 2:4]])
                (x0, y0), (x1, y1) = ends.min(axis=0), ends.max(axis=0)
                # of the others only what lies within the polygon's own bounds
                near = within_box(cover, (x0, x1, y0, y1), digits)
                known[same] = outline(np.concatenate([np.hstack([q, np.tile(w, (len(q), 1))]) for q, w in ((own, (1.0, 0.0)), (near, (0.0, 1.0)))]), operation, digits)
            found.append(known[same])
            names += [name] * len(known[same])
        p = np.concatenate([np.empty((0, 4)), *found])
        return pd.DataFrame({key: names, **dict(zip(("x0", "y0", "x1", "y1"), p.T, strict=True))})

    sides = _spread(cut, "i", "j").groupBy("i", "j").cogroup(_spread(against, "i", "j").groupBy("i", "j")).applyInPandas(one, f"`{key}` {kind}, {SIDES}")
    return _merged(sides, key, tile, digits)
