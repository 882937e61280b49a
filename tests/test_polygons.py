"""Rings from cells, points in polygons: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import cover, overlay, rings, vector
from verdance.operators.graph import stored
from verdance.operators.grid import RasterMeta

META = RasterMeta(40, 40, 100.0, 180.0, 0.0, 80.0)


def polygon(*parts):
    return [{"part": p, "hole": h, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]} for p, h, pts in parts]


def inside(rs, x, y):
    odd = False
    for r in rs:
        pts = [(p["x"], p["y"]) for p in r["pts"]]
        for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def star(rng, cx, cy, n, low, high):
    a = (np.arange(n) + rng.uniform(0, 1, n)) * 2 * np.pi / n
    r = rng.uniform(low, high, n)
    pts = list(zip(cx + r * np.cos(a), cy + r * np.sin(a), strict=True))
    return [*pts, pts[0]]


def label_image(rng, n=40):
    image = rng.integers(0, 4, (n, n))
    image[5:30, 5:30] = 1  # a large part with holes, islands in holes and corners that touch
    image[10:20, 10:20] = 2
    image[12:18, 12:18] = 1
    image[14, 14] = 3
    image[22, 22], image[23, 23] = 2, 2
    return image


@pytest.mark.parametrize("block", [128.0, 7.0, 1.0])
def test_rings_hold_just_their_cells(spark, block):
    image = label_image(np.random.default_rng(1))
    cells = [(int(image[i, j]), i, j) for i in range(40) for j in range(40)]
    df = spark.createDataFrame([*cells, cells[7], (None, 1, 1), (1, None, 2)], "label int, row int, col int").repartition(3)
    made = rings.cells_to_polygons(df, META, block=block).withColumn("area", vector.polygon_area(F.col("rings"))).collect()
    assert sorted(r.label for r in made) == [0, 1, 2, 3]
    for p in made:
        rs = [r.asDict(recursive=True) for r in p.rings]
        assert abs(p.area - 4.0 * (image == p.label).sum()) < 1e-9
        got = np.array([[inside(rs, 100 + 2 * j + 1, 80 - 2 * i - 1) for j in range(40)] for i in range(40)])
        assert (got == (image == p.label)).all()
        for r in rs:
            pts = [(q["x"], q["y"]) for q in r["pts"]]
            assert pts[0] == pts[-1] and len(set(pts)) == len(pts) - 1  # simple: no point twice
            turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(pts, pts[1:], pts[2:] + pts[1:2], strict=False)]
            assert all(turns)
            assert (sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(pts, pts[1:], strict=False)) < 0) == r["hole"]
        # every hole lies in a part of its number
        for r in rs:
            if r["hole"]:
                a, b = r["pts"][:2]
                shell = [q for q in rs if not q["hole"] and q["part"] == r["part"]]
                assert len(shell) == 1 and inside(shell, (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def test_a_ring_over_many_blocks(spark):
    n = 200  # a spiral of one cell's width: one ring of more than 30,000 sides
    image = np.zeros((n, n), bool)
    i = j = 0
    di, dj, left, right, top, bottom = 0, 1, 0, n - 1, 0, n - 1
    while left <= right and top <= bottom:
        image[top, left : right + 1] = True
        image[top : bottom + 1, right] = True
        image[bottom, left + 2 : right + 1] = True
        image[top + 2 : bottom + 1, left + 2] = bottom - top > 3
        left, right, top, bottom = left + 2, right - 2, top + 2, bottom - 2
    rows = [(9, int(a), int(b)) for a, b in zip(*np.nonzero(image), strict=True)]
    made = rings.cells_to_polygons(spark.createDataFrame(rows, "label int, row int, col int"), RasterMeta(n, n, 0.0, float(n), 0.0, float(n)), block=16.0)
    assert made.select(vector.polygon_area(F.col("rings")).alias("a")).first().a == len(rows)
    assert (i, j, di, dj) == (0, 0, 0, 1)


def test_no_cells_no_polygons(spark):
    assert rings.cells_to_polygons(spark.createDataFrame([], "label int, row int, col int"), META).count() == 0


def test_points_meet_their_polygons(spark):
    rng = np.random.default_rng(2)
    shapes = [(k, polygon((1, False, star(rng, *rng.uniform(-50, 50, 2), int(rng.integers(3, 200)), 1, 40)))) for k in range(12)]
    shapes.append((50, polygon((1, False, [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)]), (1, True, [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]), (2, False, [(16, 0), (17, 0), (17, 1), (16, 0)]))))
    shapes += [(51, []), (52, None), (53, polygon((1, False, [(3, 3), (3, 3), (3, 3)])))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-90, 90, (3000, 2)))]
    points += [(10_000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.ndindex(20, 10))]  # on corners and sides
    points += [(20_000 + i, 1.5, 1.5) for i in range(500)] + [(30_000, None, 1.0)]
    polygons = spark.createDataFrame(shapes, f"fid int, rings {vector.RINGS}")
    cells = stored(cover.polygon_cover(polygons), "test-cover")
    got = {(r.id, r.zone) for r in cover.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), cells).collect()}
    assert got == {(i, k) for i, x, y in points for k, rs in shapes if x is not None and inside(rs or [], x, y)}
    plan = cover.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), cells)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlay_of_slanted_polygons(spark):
    rng = np.random.default_rng(4)
    mine = [(k, k % 2, polygon((1, False, star(rng, *rng.uniform(-20, 20, 2), int(rng.integers(4, 20)), 4, 25)))) for k in range(6)]
    mine.append((6, 0, polygon((1, False, [(-30, -30), (30, -30), (30, 30), (-30, 30), (-30, -30)]), (1, True, [(-16, -16), (-16, 16), (16, 16), (16, -16), (-16, -16)]))))
    theirs = [(0, polygon((1, False, star(rng, 3, 3, 12, 5, 20)))), (1, polygon((1, False, star(rng, 9, -4, 7, 5, 20))))]
    a = spark.createDataFrame([*mine, (None, None, None), (9, 1, [])], f"fid int, grp int, rings {vector.RINGS}")
    b = spark.createDataFrame(theirs, f"fid int, rings {vector.RINGS}")
    points = rng.uniform(-35, 35, (1500, 2))
    held = np.array([[inside(rs, x, y) for x, y in points] for _, _, rs in mine])
    other = np.array([[inside(rs, x, y) for x, y in points] for _, rs in theirs]).any(axis=0)

    def found(df, key):
        return {r[key]: np.array([inside([q.asDict(recursive=True) for q in r.rings], x, y) for x, y in points]) for r in df.collect()}

    joined = found(overlay.union(a, "grp", 16.0), "grp")
    assert set(joined) == {0, 1} and all((joined[g] == held[[k for k, x, _ in mine if x == g]].any(axis=0)).all() for g in joined)
    less, common = found(overlay.combine(a, b, "difference", "fid", 16.0), "fid"), found(overlay.combine(a, b, "intersection", "fid", 16.0), "fid")
    for k in range(7):
        assert (less.get(k, np.zeros(1500, bool)) == (held[k] & ~other)).all() and (common.get(k, np.zeros(1500, bool)) == (held[k] & other)).all()
    assert overlay.union(a.limit(0), "grp", 16.0).count() == 0 and overlay.combine(a, b.limit(0), "intersection", "fid", 16.0).count() == 0


def test_many_polygons_in_one_place_leave_a_short_outline():
    rng = np.random.default_rng(8)

    def square(x, y, half):
        p = np.array([(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)], float)
        return np.hstack([p[:-1], p[1:]])

    at = [(*rng.integers(0, 100, 2), int(rng.integers(5, 30))) for _ in range(300)]
    sides = overlay.dissolved([square(*q) for q in at * 3], 7)
    area = (sides[:, 0] * sides[:, 3] - sides[:, 2] * sides[:, 1]).sum() / 2
    cells = {(i, j) for x, y, h in at for i in range(x - h, x + h) for j in range(y - h, y + h)}
    assert area == len(cells) and len(sides) < 300
    # drawn into a box, the same sides hold what lies inside it
    part = overlay.within_box(sides, (10.5, 130.0, -20.0, 40.0), 7)
    inside_box = sum((min(i + 1, 130) - max(i, 10.5)) * (min(j + 1, 40) - max(j, -20)) for i, j in cells if 10 <= i < 130 and -20 <= j < 40)
    assert abs((part[:, 0] * part[:, 3] - part[:, 2] * part[:, 1]).sum() / 2 - inside_box) < 1e-6
