"""Transverse Mercator: known points, round trips, and distances that hold in either zone."""

import pytest
from pyspark.sql import functions as F

from verdance.operators import projection


def test_round_trips_and_symmetry(spark):
    rows = [(-9.0 + dx, lat) for dx in (-3.5, -1.0, 0.0, 0.4, 3.0) for lat in (-80.0, -33.3, 0.0, 38.7, 60.0, 84.0)]
    zone = projection.utm(29)
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", zone.project(F.col("lon"), F.col("lat")))
    out = df.withColumn("g", zone.unproject(F.col("p.x"), F.col("p.y"))).collect()
    for r in out:
        assert abs(r.g.lon - r.lon) < 1e-9 and abs(r.g.lat - r.lat) < 1e-9  # a tenth of a millimetre
    at = {(r.lon, r.lat): (r.p.x, r.p.y) for r in out}
    assert at[-9.0, 0.0] == (500_000.0, 0.0) and abs(at[-9.0, 38.7][0] - 500_000) < 1e-9


def test_meridian_arc_and_known_point(spark):
    # a quarter of the meridian of WGS 84 is 10,001,965.729 m long
    arc = projection.TransverseMercator(0.0, scale=1.0, east=0.0)
    df = spark.range(1).select(arc.project(F.lit(0.0), F.lit(90.0 - 1e-9)).alias("p"), projection.utm(31).project(F.lit(2.2945), F.lit(48.8582)).alias("q"))
    r = df.first()
    assert abs(r.p.y - 10_001_965.729) < 2e-3
    assert abs(r.q.x - 448_251.8) < 0.1 and abs(r.q.y - 5_411_932.7) < 20


def test_between_zones_and_nulls(spark):
    a, b = projection.utm(29), projection.utm(30)
    df = spark.createDataFrame([(1, 700_000.0, 4_300_000.0), (2, None, 1.0)], "fid int, x double, y double")
    there = projection.move_points(df, a, b)
    back = {r.fid: (r.x, r.y) for r in projection.move_points(there, b, a).collect()}
    assert abs(back[1][0] - 700_000) < 1e-3 and abs(back[1][1] - 4_300_000) < 1e-3 and back[2] == (None, None)
    assert spark.range(1).select(a.project(F.lit(0.0), F.lit(91.0)).alias("p")).first().p is None
    with pytest.raises(ValueError):
        projection.utm(61)
