"""Whole-image watershed against a version that walks cell by cell, whatever the blocks."""

import numpy as np
import pytest

from verdance.operators import basins


def by_hand(image, tolerance, reach):
    """{(row, col): smallest cell of its segment}: climbs from each cell, then takes saddles from high to low."""
    h, w = image.shape
    there = {(i, j) for i in range(h) for j in range(w) if np.isfinite(image[i, j])}
    order = lambda p: (-image[p], p[0] * w + p[1])
    near = lambda p: [(i, j) for i in range(p[0] - reach, p[0] + reach + 1) for j in range(p[1] - reach, p[1] + reach + 1) if (i, j) in there]

    def top(p):
        while (q := min(near(p), key=order)) != p:
            p = q
        return p

    tops = {p: top(p) for p in there}
    saddles = {}
    for p in there:
        for q in near(p):
            if tops[p] != tops[q]:
                key = tuple(sorted((tops[p], tops[q])))
                saddles[key] = max(saddles.get(key, -np.inf), min(image[p], image[q]))
    group = {t: t for t in tops.values()}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    for (a, b), s in sorted(saddles.items(), key=lambda e: (-e[1], e[0])):
        a, b = sorted((find(a), find(b)), key=order)
        if a != b and image[b] - s < tolerance:
            group[b] = a
    least = {}
    for p in there:
        t = find(tops[p])
        least[t] = min(least.get(t, h * w), p[0] * w + p[1])
    return {p: least[find(tops[p])] for p in there}


def image_of(name):
    rng = np.random.default_rng(7)
    if name == "noise":
        return rng.random((14, 20))
    if name == "steps":  # plateaus and ties of heights, peaks and saddles
        return rng.integers(0, 4, (15, 19)).astype(float)
    if name == "gaps":
        a = rng.random((19, 13))
        a[rng.random(a.shape) < 0.3] = np.nan
        return a
    if name == "flat":
        return np.ones((12, 19))
    i, j = np.mgrid[0:12, 0:12]  # one long slope with bumps that rise while their saddles fall
    return np.where(j % 2, 10 - 0.01 * j, 11 + 0.01 * j) + 0 * i


@pytest.mark.parametrize("name, tolerance, reach", [("noise", 0.15, 1), ("steps", 0.5, 2), ("gaps", 0.3, 1), ("flat", 0.1, 1), ("slope", 1.7, 1)])
def test_segments_equal_those_by_hand_for_any_blocks(spark, name, tolerance, reach):
    image = image_of(name)
    h, w = image.shape
    want = by_hand(image, tolerance, reach)
    rows = [(i, j, i * w + j, float(image[i, j])) for i in range(h) for j in range(w)]
    cells = spark.createDataFrame(rows, "row long, col long, cell long, v double")
    for side in (9, 64) if name in ("noise", "gaps") else (7,):
        got = {(r.row, r.col): r.label for r in basins.segments(cells, "v", tolerance, reach, side).collect()}
        assert got == want


def test_rows_that_are_no_cells(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 0, 3.0), (0, 1, 1, 2.0), (0, 1, 1, 2.0), (0, 2, 2, float("inf")), (0, 3, 3, None), (None, 4, 4, 1.0), (0, 5, None, 1.0), (0, -9, -9, 1.0)]
    cells = spark.createDataFrame(rows, "row long, col long, cell long, v double").selectExpr("*", "1 as kind", "2 as label")
    assert sorted(map(tuple, basins.segments(cells, "v", 0.5).collect())) == [(0, -9, -9, -9), (0, 0, 0, 0), (0, 1, 1, 0)]
    assert basins.segments(cells.limit(0), "v", 0.5).count() == 0
    with pytest.raises(ValueError, match="twice"):
        basins.segments(cells, "v", 0.5, reach=2, side=3)
