"""Operators against brute force, properties and documented quirks."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import attributes, crowns, focal, graph, grid, models, segment, series, spatial, stats, vector, warp, zonal
from verdance.operators.grid import RasterMeta
from verdance.sources import rasters


def points(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "fid long, x double, y double")


def cells_of(spark, image, name="v"):
    rows = [(int(i), int(j), int(i * image.shape[1] + j + 1), None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, f"row long, col long, cell long, {name} double")


# zones and attributes


def test_zonal_means_skip_gaps_and_weigh(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", None, 9.0), ("a", float("nan"), 9.0), ("b", None, 1.0)], "z string, v double, w double")
    assert {r.z: r.v for r in zonal.zonal_mean(df, "z", ["v"]).collect()} == {"a": 2.0, "b": None}
    assert {r.z: r.v for r in zonal.zonal_mean(df, "z", ["v"], weight="w").collect()} == {"a": 2.5, "b": None}


def test_packed_deviation_is_modulo_one(spark):
    df = spark.createDataFrame([("a", 0.5 - 2.25 / math.sqrt(2)), ("a", 0.5 + 2.25 / math.sqrt(2)), ("one", 1.0)], "z string, v double")
    got = {r.z: (r.Mean1, r.Std1) for r in zonal.zonal_mean_sd(df, "z", ["v"], packed=True).collect()}
    assert got["a"] == (0.500002, 0.25) and got["one"] == (None, None)
    assert {r.z: r.Std1 for r in zonal.zonal_mean_sd(df, "z", ["v"]).collect()}["a"] == 2.25


def test_extreme_inside_and_in_the_box(spark):
    rows = [("a", 1, 0.0, 0.0, 1.0), ("a", 9, 2.0, 2.0, 2.0), ("b", 5, 1.0, 1.0, 7.0), ("c", 8, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "z string, cell long, x double, y double, v double")
    assert {r.z: r.cell for r in zonal.zone_extreme(df, "z", "v").collect()} == {"a": 9, "b": 5}
    assert {r.z: r.cell for r in zonal.zone_extreme(df, "z", "v", bounding_box=True).collect()} == {"a": 5, "b": 5}


def test_attributes_match_nulls_and_coalesce(spark):
    a = spark.createDataFrame([(1.0, None, None), (2.0, 5.0, 1.0)], "primalX double, primalY double, n double")
    b = spark.createDataFrame([(1.0, None, 7.0), (2.0, 5.0, 8.0)], "primalX double, primalY double, n double")
    assert {r.primalX: r.n for r in attributes.attach(a, b, ["primalX", "primalY"]).collect()} == {1.0: 7.0, 2.0: 1.0}
    merged = attributes.merge_by_attributes([a, b], drop="nothing matches this")
    assert merged.columns == ["primalX", "primalY", "i1n", "i2n"] and merged.count() == 2
    assert attributes.merge_by_attributes([a, b], drop="i2").columns == ["primalX", "primalY", "i1n"]
    assert attributes.select_flights(a, "f1").count() == 2  # no such columns: nothing to select by
    assert [tuple(r) for r in attributes.image_keys(["x.tif", "y.tif"], spark).collect()] == [("i1", "x.tif"), ("i2", "y.tif")]


# ranks, strata, samples


def test_quantiles_of_cells(spark):
    df = spark.createDataFrame([("z", k, v) for k, v in enumerate((10.0, 20.0, 20.0, 40.0, None))], "z string, cell long, v double")
    assert [r.quantile for r in stats.crown_quantiles(df, "z", "v").orderBy("cell").collect()] == [25.0, 62.0, 62.0, 100.0, None]
    trimmed = stats.trim_to_quantiles(df, "z", "v", [62])
    frame = spark.createDataFrame([(k,) for k in range(6)], "cell long")
    assert [r.quantile for r in stats.mosaic_max(trimmed, frame, "quantile").orderBy("cell").collect()] == [0.0, 62.0, 62.0, 0.0, 0.0, 0.0]
    assert [r.quantile for r in stats.mosaic_max(trimmed, frame, "quantile", None).orderBy("cell").collect()][0] is None


def test_strata_and_samples(spark):
    df = spark.createDataFrame([(k, float(k), 1.0, "ab"[k % 2]) for k in range(100)] + [(100, None, 1.0, "a")], "id long, v double, c double, f string")
    out = stats.strata(df, ["v", "c"], ["f"], quants=(0, 0.3, 0.7, 1))
    got = {r.id: r.stratum for r in out.collect()}
    assert got[0] == "10a" and got[99] == "30b" and got[30] == "20a" and got[100] is None
    sample = stats.stratified_sample(out.dropna(), "stratum", 12, "id", seed=1)
    assert sample.count() == 12 and sample.groupBy("stratum").count().count() == 6
    again = stats.stratified_sample(out.dropna().repartition(3), "stratum", 12, "id", seed=1)
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in again.collect())
    assert stats.sample_rows(df, 500, "id").count() == 101 and stats.sample_rows(df, 7, "id").count() == 7
    assert stats.sample_by_group(df, "f", 3, "id").count() == 6
    assert [r.f for r in stats.factor_codes(df.limit(2), "f").orderBy("id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        stats.factor_codes(df.withColumn("f", F.col("id").cast("string")), "f")
    assert stats.select_columns(df, ignore="^c", include="[cv]") == ["v"]


def test_control_keeps_rows_and_is_zero_for_equals(spark):
    rows = [(z, "d", b, 4.0, (z + 1) % 3, (z + 2) % 3) for z in range(3) for b in range(2)] + [(3, "d", 0, 9.0, 77, None)]
    df = spark.createDataFrame(rows, "ID long, dfname string, band long, DN_s double, IDneighb_1 long, IDneighb_2 long")
    out = stats.subtract_control(df)
    assert out.count() == len(rows) and out.columns == ["ID", "dfname", "band", "DN_s", "DN_c"]
    assert {r.DN_c for r in out.collect()} == {0.0, None}


def test_growing_efficiency(spark):
    df = spark.createDataFrame([(99,), (99,), (95,)], "probcut long")
    got = [tuple(r) for r in stats.growing_efficiency(df, stats.prob_cut_of("out_99.shp")).orderBy("probcut").collect()]
    assert got == [(95, 1, 3, 1 / 3, 3 / 5), (99, 2, 2, 1.0, 1.0)]
    with pytest.raises(ValueError):
        stats.prob_cut_of("crowns.shp")


# distances


def test_distance_joins_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-50, 50, (80, 2)).round(1), rng.uniform(-50, 50, (60, 2)).round(1)
    da, db = points(spark, a), points(spark, b)
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert {(r.fid, r.b_fid) for r in spatial.within(da, db, 7.0).collect()} == {tuple(map(int, p)) for p in np.argwhere(d <= 7.0)}
    assert {r.fid: r.n for r in spatial.count_within(da, db, 7.0).collect()} == {k: int(n) for k, n in enumerate((d <= 7.0).sum(axis=1))}
    assert {r.fid for r in spatial.far_from(da, db, 7.0).collect()} == {int(k) for k in np.flatnonzero((d > 7.0).all(axis=1))}
    for k in (1, 4):
        want = {(i, r + 1, int(j)) for i in range(80) for r, j in enumerate(np.lexsort((np.arange(60), d[i]))[:k])}
        assert {(r.fid, r["rank"], r.b_fid) for r in spatial.nearest(da, db, k).collect()} == want


def test_nearest_with_few_or_far_points(spark):
    a, b = points(spark, [(0, 0), (1e6, 1e6)]), points(spark, [(0, 1), (2, 0)])
    assert {(r.fid, r["rank"], r.b_fid) for r in spatial.nearest(a, b, 3).collect()} == {(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0)}
    assert spatial.nearest(a, b.filter("false")).count() == 0
    assert spatial.nearest(a, a, 1, exclude_self=True).count() == 2


def test_nearest_searches_places_not_rows(spark, monkeypatch):
    """Copies in one place share their search: the pairs that a round makes don't grow with them."""
    made, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: made.append(within(*a)) or made[-1])
    at = [(float(k % 5), float(k % 5) * 2) for k in range(100)]
    a = b = points(spark, at)
    d = {(i, j): math.dist(at[i], at[j]) for i in range(100) for j in range(100)}
    for k, own in ((3, True),):
        want = {(i, r, j) for i in range(100) for r, j in enumerate(sorted((j for j in range(100) if not (own and i == j)), key=lambda j: (d[i, j], j))[:k], 1)}
        assert {(r.fid, r["rank"], r.b_fid) for r in spatial.nearest(a, b, k, exclude_self=own).collect()} == want
    assert max(pairs.count() for pairs in made) <= 5 * 5 * 4


def test_false_positive_caps(spark):
    cells = spark.createDataFrame([(k, float(k * 10), 0.0, True) for k in range(50)], "cell long, x double, y double, presence boolean")
    avoid = points(spark, [(0, 0)])
    assert spatial.false_positives(cells, avoid, 15.0, 0.2, 5, seed=None).count() == 3  # cells 0 and 1 are too near
    assert spatial.false_positives(cells, avoid, 15.0, 0.2, 20, seed=None, cap="max").count() == 18
    assert spatial.false_positives(cells, avoid, 15.0, 0.2, 5, seed=4).count() <= 5


# grids and neighbourhoods


def test_tiles_windows_and_cells(spark):
    meta = RasterMeta(100, 100, 0.0, 10.0, 0.0, 20.0, layers=6)
    assert grid.tiles_per_side(meta, 50_000) == 2 and grid.tile_extents(spark, meta, 50_000).count() == 4
    assert grid.tiles_per_side(meta, 60_001) == 1
    assert grid.window_size(4, 0.15) == (55, 55)
    df = spark.createDataFrame([(0.0, 20.0), (10.0, 0.0), (5.0, 10.0), (11.0, 3.0)], "x double, y double")
    assert [r[0] for r in df.select(meta.cell_of(F.col("x"), F.col("y"))).collect()] == [1, 10_000, 5051, None]
    with pytest.raises(ValueError):
        grid.proximity(spark, 4, 3)
    with pytest.raises(ValueError):
        grid.check_crs(meta, RasterMeta(1, 1, 0, 1, 0, 1, crs="other"))


@pytest.mark.parametrize("most", [64, 0])
def test_focal_sums_by_offsets_and_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(focal, "MOST_OFFSETS", most)
    rng = np.random.default_rng(1)
    image = (rng.random((23, 31)) < 0.3).astype(float)
    df = cells_of(spark, image).withColumn("p", F.col("v") > 0)
    offsets = focal.circle_offsets(2.0, 1.0)
    count = np.zeros_like(image)
    for i, j in offsets:
        for r in range(23):
            for c in range(31):
                if 0 <= r + i < 23 and 0 <= c + j < 31:
                    count[r, c] += image[r + i, c + j]
    got = {(r.row, r.col): r.clump for r in focal.clump_filter(df, "p", 2.0, 1.0, 4).collect()}
    assert got == {(r, c): int(count[r, c] > 4) for r in range(23) for c in range(31)}


def test_remoteness_by_hand(spark):
    image = np.zeros((11, 11))
    image[5, 1] = image[5, 2] = 1
    df = cells_of(spark, image)
    got = {(r.row, r.col): r.remoteness for r in focal.remoteness(df, "v", 9.0, 3.0, 1.0).collect()}
    assert got[5, 5] == 3.5 and got[5, 1] is None and got[0, 10] is None


def test_focal_mean_needs_all_nine(spark):
    image = np.arange(25.0).reshape(5, 5)
    image[0, 0] = np.nan
    got = {(r.row, r.col): r.mean for r in focal.focal_mean(cells_of(spark, image), "v").collect()}
    assert got[2, 2] == 12.0 and got[1, 1] is None and got[0, 2] is None


# polygons


def square(x, y, half, part=1, hole=False):
    pts = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]
    return (part, hole, [(float(a), float(b)) for a, b in pts])


def polygons(spark, *rings):
    return spark.createDataFrame([(k, list(r)) for k, r in enumerate(rings)], f"fid long, rings {vector.RINGS}")


def test_polygon_measures(spark):
    df = polygons(spark, [square(0, 0, 2), square(0, 0, 1, hole=True)], [square(0, 0, 1), square(10, 0, 1, part=2)])
    area = {r.fid: r.a for r in df.select("fid", vector.polygon_area(F.col("rings")).alias("a")).collect()}
    assert area == {0: 12.0, 1: 8.0}
    assert vector.remove_small(df, 12.0).count() == 1
    c = {r.fid: tuple(r.c) for r in df.select("fid", vector.centroid(F.col("rings")).alias("c")).collect()}
    assert c == {0: (0.0, 0.0), 1: (5.0, 0.0)}
    filled = df.select("fid", vector.polygon_area(vector.remove_holes(F.col("rings"))).alias("a"))
    assert {r.fid: r.a for r in filled.collect()}[0] == 16.0
    inside = df.select("fid", vector.in_polygon(F.col("rings"), F.lit(0.5), F.lit(0.5)).alias("i")).collect()
    assert {r.fid: r.i for r in inside} == {0: False, 1: True}
    part = df.select("fid", vector.keep_part_with(F.col("rings"), F.lit(10.0), F.lit(0.5)).alias("k")).collect()
    assert {r.fid: len(r.k) for r in part} == {0: 2, 1: 1}
    assert df.filter("fid = 1").select(vector.keep_part_with(F.col("rings"), F.lit(99.0), F.lit(0.0))).first()[0] is None


def test_seeds_of_polygons(spark):
    meta = RasterMeta(10, 10, 0.0, 10.0, 0.0, 10.0)
    df = polygons(spark, [square(5, 5, 3)], [square(50, 50, 1)])
    pixels = spark.createDataFrame([(12 + 10 * k, 1.5 + k, 8.5 - k, float(-abs(k - 4))) for k in range(9)], "cell long, x double, y double, v double")
    assert {r.fid: (r.x, r.y) for r in vector.polygons_to_seeds(df).collect()} == {0: (5.0, 5.0), 1: (50.0, 50.0)}
    top = vector.polygons_to_seeds(df, pixels.withColumn("cell", F.floor(10 - F.col("y")) * 10 + F.floor(F.col("x")) + 1), "v", meta).collect()
    assert [(r.fid, r.x, r.y) for r in top] == [(0, 5.5, 4.5)]


def test_clipping_and_cell_shares(spark):
    df = polygons(spark, [square(5, 5, 3), square(5, 5, 1, hole=True)])
    meta = RasterMeta(10, 10, 0.0, 10.0, 0.0, 10.0)
    shares = {r.cell: r.share for r in vector.cell_shares(df, meta).collect()}
    assert math.isclose(sum(shares.values()), 32.0) and all(s == pytest.approx(1.0) for s in shares.values())
    assert {r.cell for r in vector.polygon_cells(df, meta).collect()} == set(shares)
    boxes = spark.createDataFrame([(0, 0.0, 5.0, 0.0, 5.0)], "box int, xmin double, xmax double, ymin double, ymax double")
    cut = vector.clip_to_extents(df, boxes).select(vector.polygon_area(F.col("rings")).alias("a")).first().a
    assert math.isclose(cut, 9 - 1)
    assert len(vector.tile_borders([(0, 1, 0, 1), (1, 2, 0, 1)])) == 1


# crowns, segments, warping, curves


def test_opening_holes_and_parts():
    rng = np.random.default_rng(3)
    mask = rng.random((30, 30)) < 0.7
    kernel = crowns.disc(1)
    once = crowns.opened(mask, kernel)
    assert (once <= mask).all() and (crowns.opened(once, kernel) == once).all()
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert crowns.filled(ring).sum() == 25
    assert crowns.part_with(ring, 3, 3) is None and crowns.part_with(ring, 1, 1).sum() == 24
    assert crowns.opened(np.eye(5, dtype=bool), kernel).sum() == 5  # nothing would be left


def test_growing_covers_a_bright_disc(spark):
    rng = np.random.default_rng(4)
    rows, cols = np.mgrid[0:41, 0:41]
    inside = np.hypot(rows - 20, cols - 20) < 6
    image = [np.where(inside, 10.0, 0.0) + rng.normal(scale=0.3, size=(41, 41)) for _ in range(2)]
    data = [(int(i), int(j), float(image[0][i, j]), float(image[1][i, j])) for i in range(41) for j in range(41)]
    pixels = spark.createDataFrame(data, "row long, col long, b1 double, b2 double")
    seeds = spark.createDataFrame([(1, 20, 20), (2, 400, 400)], "fid long, row long, col long")
    out = crowns.grow_crowns(seeds, pixels, ["b1", "b2"], 1.0, max_radius=10.0, min_radius=2.0, kernel=1).collect()
    got = {(r.row, r.col) for r in out if r.status == "ok"}
    true = {(int(i), int(j)) for i, j in np.argwhere(inside)}
    assert len(got & true) / len(true) > 0.8 and len(got - true) <= 6
    assert (20, 20) in got and all(r.npx_final == 0 for r in out)
    # a seed outside the image has one row that says so, and isn't tried again
    assert [(r.row, r.status) for r in out if r.fid == 2] == [(None, "no data at the seed")]
    more = seeds.unionByName(spark.createDataFrame([(3, 5, 5)], seeds.schema))
    assert [r.fid for r in crowns.new_seeds(more, spark.createDataFrame(out, "fid long, row long, col long, npx_t_b long, npx_final long, nstrtcl long, probcut long, status string")).collect()] == [3]
    assert crowns.spaced_bands([f"b{k}" for k in range(11)]) == ["b0", "b2", "b4", "b6", "b8", "b10"]


def test_seeds_in_one_cell_share_their_growth(spark):
    rng = np.random.default_rng(7)
    data = [(i, j, float(v), float(w)) for i in range(20) for j in range(20) for v, w in [rng.normal(size=2)]]
    pixels = spark.createDataFrame(data, "row long, col long, b1 double, b2 double")
    flat = pixels.withColumn("b1", F.lit(1.0)).withColumn("b2", F.lit(1.0))  # no covariance: what is drawn depends on the key
    seeds = spark.createDataFrame([(k, 8 + k % 2, 9) for k in range(6)] + [(6, None, None), (7, None, None)], "fid long, row long, col long")
    for image in (pixels, flat):
        out = {}
        for r in crowns.grow_crowns(seeds, image, ["b1", "b2"], 1.0, max_radius=5.0, min_radius=1.0, kernel=1).collect():
            out.setdefault(r.fid, []).append(tuple(r)[1:])
        assert set(out) == set(range(8)) and all(len(set(x)) == len(x) for x in out.values())
        if image is pixels:
            assert all(sorted(out[k]) == sorted(out[k % 2]) for k in range(6))
        assert [x[-1] for k in (6, 7) for x in out[k]] == ["no data at the seed"] * 2


def test_segments_do_not_depend_on_tiles(spark):
    i, j = np.mgrid[0:24, 0:24]
    image = np.maximum(np.exp(-((i - 6) ** 2 + (j - 12) ** 2) / 12), np.exp(-((i - 18) ** 2 + (j - 12) ** 2) / 12))
    image[image < 0.2] = np.nan
    df = cells_of(spark, image)
    whole = segment.watershed_crowns(df.withColumn("tile", F.lit(0)), "v", tolerance=0.01, smooth=False)
    tiled = segment.watershed_crowns(df.withColumn("tile", F.floor(F.col("col") / 12)), "v", tolerance=0.01, smooth=False)
    groups = lambda out: {frozenset(s) for s in _members(out).values()}
    assert groups(whole) == groups(tiled) and len(groups(whole)) == 2
    flat = segment.watershed(np.array([[1.0, 0.5, 1.0]]), tolerance=0.6)
    assert len(set(flat.ravel())) == 1 and len(set(segment.watershed(np.array([[1.0, 0.5, 1.0]]), 0.1).ravel())) == 2
    assert segment.mask_below(df.withColumn("w", F.lit(0.5)), "v", [("w", 0.6)]).filter("v is not null").count() == 0


def _members(out):
    found = {}
    for r in out.collect():
        found.setdefault(r.label, set()).add(r.cell)
    return found


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_spline_meets_control_points_and_is_affine_exact(spark):
    rng = np.random.default_rng(5)
    s = rng.uniform(0, 100, (25, 2))
    t = s + rng.normal(scale=3, size=(25, 2))
    assert np.allclose(warp.Spline(s, t)(s), t, atol=1e-6)
    q = rng.uniform(-50, 150, (9, 2))
    assert np.allclose(warp.Spline(s, 2 * s + 1)(q), 2 * q + 1, atol=1e-6)
    with pytest.raises(ValueError):
        warp.Spline(s[:2], t[:2])
    pairs = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(s, t, strict=True)], "sx double, sy double, tx double, ty double")
    moved = warp.warp_points(points(spark, s), warp.fit_spline(pairs)).orderBy("fid").collect()
    assert np.allclose([(r.x, r.y) for r in moved], t, atol=1e-6) and moved[0].primalX == s[0, 0]


def test_spline_of_many_copies_of_few_points(spark, monkeypatch):
    monkeypatch.setattr(warp, "MOST_PAIRS", 30)
    rng = np.random.default_rng(6)
    s = np.repeat(rng.uniform(0, 100, (25, 2)).round(2), 4, axis=0)
    s[1::4] += 1e-12  # computed in another way
    pairs = spark.createDataFrame([tuple(map(float, (*a, *a[::-1] * 2))) for a in s], "sx double, sy double, tx double, ty double")
    spline = warp.fit_spline(pairs)
    assert len(spline.source) == 25 and np.allclose(spline(s), s[:, ::-1] * 2, atol=1e-6)
    monkeypatch.setattr(warp, "AT_ONCE", 60)
    assert np.allclose(spline(s), s[:, ::-1] * 2, atol=1e-6)
    monkeypatch.setattr(warp, "MOST_PAIRS", 20)
    with pytest.raises(ValueError):
        warp.fit_spline(pairs)


def test_curve_fit_recovers_parameters(spark):
    u = np.linspace(0, 1, 12)
    t, v = np.tile(u * 300, (3, 1)), np.stack([2 * np.e * u + 1, 3 * (np.e * u) ** 1.5 - 1, np.full(12, 4.0)])
    v[1, 3] = np.nan  # a cell without a value takes no part
    params, sse, status = series.fit_curves(t, v)
    assert list(status) == ["ok"] * 3 and np.allclose(params[:2], [(2, 1, 1), (3, 1.5, -1)], atol=1e-4) and (sse < 1e-9).all()
    df = spark.createDataFrame([(1, float(k), 3 * (math.e * k / 9) ** 1.5 + 2) for k in range(10)] + [(2, 1.0, 1.0), (2, 2.0, 1.0), (3, None, 1.0), (4, 1.0, 2.0), (4, 2.0, None)], "id long, t double, v double")
    got = {r.id: r for r in series.fit_series(df, "id", "t", "v").collect()}
    assert abs(got[1].rate - 1.5) < 1e-3 and [got[k].status for k in (2, 3, 4)] == ["too few times"] * 3
    assert [(got[k].n, got[k].rate) for k in (2, 3, 4)] == [(2, None), (1, None), (2, None)] and series.fit_series(df.limit(0), "id", "t", "v").count() == 0


# models


def test_training_frame_guards(spark):
    cells = spark.createDataFrame([(k, float(k), 0.0, float(k)) for k in range(100)], "cell long, x double, y double, v double")
    presence = cells.filter("cell < 10")
    out = models.training_frame(presence, cells, points(spark, [(50, 0)]), ["v"], "c", 60, distance=5.0, seed=None)
    assert out.filter("pres = 1").count() == 10 and out.filter("pres = 0").count() == 60 - 11
    with pytest.raises(ValueError):
        models.training_frame(presence, cells, points(spark, [(50, 0)]), ["v"], "c", 60, distance=500.0)
    zones = models.classes_of(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", ["a", ["b", "x"]])
    assert sorted(r["class"] for r in zones.collect()) == ["a", "b"]


def test_models_tell_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(k % 2), float(rng.normal(loc=3 * (k % 2))), float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, pres int, a double, b double")
    model = models.PresenceModel.fit(df, ["a", "b"])
    out = model.predict(df.unionByName(spark.createDataFrame([(-1, 0, None, 1.0)], df.schema)), byte=True).collect()
    assert np.mean([r.p for r in out if r.pres == 1]) > np.mean([r.p for r in out if r.pres == 0 and r.id >= 0]) + 40
    assert [r.p for r in out if r.id == -1] == [None] and all(0 <= r.p <= 255 for r in out if r.id >= 0)
    pixels = df.withColumn("zone", F.floor(F.col("id") / 20) * 2 + F.col("pres"))
    zones = pixels.groupBy("zone").agg(F.max(F.col("pres").cast("string")).alias("veg"))
    forest = models.train_forest(pixels, zones, ["a", "b"], "veg", "zone", trees=10)
    told = models.classify_zones(pixels, zones, ["a", "b"], forest, "zone")
    assert told.filter("veg = predicted").count() >= 0.9 * zones.count()
    assert models.classify_zones(pixels, zones, ["a", "b"], forest, "zone", target="1").select("predicted").distinct().count() == 1


# files


def write_envi(folder, name, image):
    (folder / f"{name}.bsq").write_bytes(image.astype("<f4").tobytes())
    bands, lines, samples = image.shape
    (folder / f"{name}.hdr").write_text(
        f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\ndata type = 4\nbyte order = 0\ninterleave = bsq\nmap info = {{UTM, 1, 1, 100, 200, 2, 2, 29, North}}\nwavelength = {{\n670.0,\n800.0 }}\n"
    )


def test_envi_images_and_catalogue(spark, tmp_path):
    image = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    write_envi(tmp_path, "scene", image)
    (tmp_path / "bad.hdr").write_text("ENVI\nsamples = x\n")
    tags = [(256, 3, 1, 7), (257, 3, 1, 5), (277, 3, 1, 2)]
    tiff = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
    (tmp_path / "photo.tif").write_bytes(tiff)
    pixels = rasters.read_envi(spark, str(tmp_path / "scene.bsq")).orderBy("cell").collect()
    assert [r["X670.000000.Nanometers"] for r in pixels] == image[0].ravel().tolist() and [r["X800.000000.Nanometers"] for r in pixels] == image[1].ravel().tolist()
    assert (pixels[0].x, pixels[0].y, pixels[-1].row, pixels[-1].col) == (101.0, 199.0, 2, 3)
    found = {r.fname: r for r in rasters.raster_catalog(spark, str(tmp_path)).collect()}
    assert (found["scene.bsq"].xmin, found["scene.bsq"].xmax, found["scene.bsq"].ymin, found["scene.bsq"].ymax) == (100.0, 108.0, 194.0, 200.0)
    assert found["scene.bsq"].layers == 2 and found["bad.bsq"].status != "ok" and (found["photo.tif"].ncol, found["photo.tif"].nrow, found["photo.tif"].layers) == (7, 5, 2)


def test_scene_names_tiles_and_copies(spark, tmp_path):
    df = spark.createDataFrame([("/a/s02_20150525T110213Z_MS-0000020736-0000000000.tif",), ("s01_notadate.tif",)], "p string")
    sensor, day = rasters.scene_parts(F.col("p"))
    got = df.select(sensor.alias("s"), day.cast("string").alias("d"), rasters.tile_code(F.col("p"), 1, 6).alias("t")).collect()
    assert [tuple(r) for r in got] == [("s02", "2015-05-25", "s02_20"), ("s01", None, "s01_no")]
    (tmp_path / "names.txt").write_text('"pt599000-4413000.aspect.tif"\npt599000-4413000.slope.tif\n\n')
    assert rasters.predictor_names(spark, str(tmp_path / "names.txt")) == ["l.aspect", "l.slope"]
    df.write.parquet(str(tmp_path / "a"))
    assert rasters.copy_dataset(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    assert not rasters.copy_dataset(spark, str(tmp_path / "none"), str(tmp_path / "c"))
    assert not rasters.copy_dataset(spark, str(tmp_path / "a"), str(tmp_path / "b"), overwrite=False)


def test_groups_without_a_value_are_dropped(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, None), (1, None, None), (2, nan, "x"), (3, 1.0, None), (3, nan, None)], "g long, v double, w string")
    assert sorted(r.g for r in attributes.drop_all_null(df, "g", ["v", "w"]).collect()) == [2, 3, 3]
