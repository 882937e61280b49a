"""Table functions against counts worked out pair by pair."""

import math

import numpy as np
import pytest

from verdance.functions import tables


def test_counts_near_points_for_any_tile(spark):
    rng = np.random.default_rng(4)
    present = [(float(x), float(y)) for x, y in rng.integers(-20, 20, (150, 2)) / 2] + [(None, 1.0), (float("nan"), 1.0), (0.0, 0.0), (0.0, 0.0)]
    points = [(1 + k % 2, k, "ab"[k % 2], float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-22, 22, (60, 2)) / 2)] + [(1, None, None, 0.0, 0.0), (2, 99, "a", None, 1.0)]
    a = spark.createDataFrame(points, "kind int, fid long, class string, x double, y double").selectExpr("*", "1 as tx", "2 as pred")
    b = spark.createDataFrame(present, "x double, y double").selectExpr("*", "7 as kind", "'z' as class")
    there = [p for p in present if p[0] is not None and not math.isnan(p[0])]
    for radius, side in ((1.5, 4.0), (3.0, 2.0)):
        want = sorted(str((k, f, c, sum(math.sqrt((p[0] - x) ** 2 + (p[1] - y) ** 2) <= radius for p in there))) for k, f, c, x, y in points if x is not None)
        assert sorted(str(tuple(r)) for r in tables.presences_near(a, b, radius, side).collect()) == want
    assert tables.presences_near(a.limit(0), b, 1.0, 4.0).count() == 0
    assert {r.pred for r in tables.presences_near(a, b.limit(0), 1.0, 4.0).collect()} == {0}
    with pytest.raises(ValueError, match="above 0"):
        tables.presences_near(a, b, 0.0, 4.0)


def test_tiles_near_in_sql(spark):
    tables.register(spark)
    rows = spark.sql("SELECT t.* FROM VALUES (5D, -1D), (NULL, 1D) p(x, y), LATERAL tiles_near(p.x, p.y, 1.5D, 4D) t").collect()
    assert sorted(map(tuple, rows)) == [(0, -1), (0, 0), (1, -1), (1, 0)]
