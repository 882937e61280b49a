"""Queries with iterative algorithms or fitted models: most without SQL; the tests hold them against properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators import basins, crowns, maxent, models, segment, series, warp
from verdance.operators.grid import tile_of
from verdance.plans.space_queries import META
from verdance.plans.sql import GRID, VNIR
from verdance.sources import fixtures


def fit_series(spark, sf_dir: str) -> DataFrame:
    return series.fit_series(fixtures.series(spark, sf_dir), "user_id", "im_date", "DN_c")


def tps_warp(spark, sf_dir: str) -> DataFrame:
    """Points warped by all pairs that a link table names; their displacement varies with the place."""
    b = fixtures.points_b(spark, sf_dir)
    moved = b.select("fid", (F.col("x") * 1.01 + 5 + 8 * F.sin(F.col("y") / 150)).alias("x"), (F.col("y") * 0.99 - 3 + 6 * F.cos(F.col("x") / 200)).alias("y"))
    links = b.select((F.col("fid") - 1).alias("source_fid"), (F.col("fid") - 1).alias("target_fid"))
    return warp.warp_points(fixtures.points_a(spark, sf_dir), warp.fit_spline(warp.linked_pairs(links, b, moved)))


def shift_polygons(spark, sf_dir: str) -> DataFrame:
    """Squares drawn to the nearest points of another set."""
    return warp.shift_polygons_to_points(fixtures.squares(spark, sf_dir), fixtures.points_a(spark, sf_dir), box=(0.0, 1000.0, 0.0, 1000.0), keep=["side"])


def _image(spark, sf_dir: str) -> DataFrame:
    """The grid with bands that vary smoothly and by cell."""
    v = F.col("v").cast("double")
    wave = F.sin(F.col("row") / 4.0) * F.cos(F.col("col") / 4.0)
    return fixtures.grid(spark, sf_dir).withColumn("b1", wave * 10 + v / 100).withColumn("b2", wave * 5 - v / 150 + F.pmod("cell", F.lit(7)) / 50)


def grow_crowns(spark, sf_dir: str) -> DataFrame:
    seeds = fixtures.points_b(spark, sf_dir).select("fid", META.row_of(F.col("y")).alias("row"), META.col_of(F.col("x")).alias("col"))
    return crowns.grow_crowns(seeds, _image(spark, sf_dir), ["b1", "b2"], 1.0, max_radius=8.0, min_radius=1.0, kernel=1)


def watershed(spark, sf_dir: str) -> DataFrame:
    """Rough crowns of the whole image; no tile has a say in them."""
    return basins.crowns_of_image(_image(spark, sf_dir), "b1", tolerance=0.5, conditions=[("b2", -3.0)])


def tile_merge(spark, sf_dir: str) -> DataFrame:
    """Segments that tile borders cut, put together: their sizes."""
    cells = _image(spark, sf_dir).withColumn("tile", tile_of(META, 700))
    return segment.merge_across_tiles(segment.segment_tiles(cells, "b1", 0.5)).groupBy("label").agg(F.count("*").alias("cells"), F.count_distinct("tile").alias("tiles"))


def watershed_basins(spark, sf_dir: str) -> DataFrame:
    """Which peak's basin each cell of the grid belongs to, by its smallest cell; blocks of 16 cells."""
    return basins.segments(fixtures.grid(spark, sf_dir), "v", tolerance=0.0, side=16).select("cell", "label")


def twin_hills(spark, sf_dir: str) -> DataFrame:
    """Ridges with two summits as high as the grid's values; the dip between them, also a value, decides whether they are one segment."""
    g = fixtures.grid(spark, sf_dir)
    at = lambda c: F.max(F.when(F.col("col") % 10 == c, F.col("v").cast("double")))
    ridges = g.groupBy("row", F.floor(F.col("col") / 10).alias("hill")).agg(at(2).alias("l"), at(6).alias("r"), at(4).alias("d"))
    ridges = ridges.withColumn("dip", F.least("l", "r") - F.col("d") % 7 - 0.5)
    c = F.col("col") % 10
    height = F.when(c == 3, (F.col("l") + F.col("dip")) / 2).when(c == 4, F.col("dip")).when(c == 5, (F.col("r") + F.col("dip")) / 2)
    height = height.when(c < 3, F.col("l") - F.abs(c - 2)).when(c < 9, F.col("r") - F.abs(c - 6))
    cells = g.withColumn("hill", F.floor(F.col("col") / 10)).join(ridges, ["row", "hill"]).filter("row % 2 = 0").withColumn("h", height)
    found = basins.segments(cells, "h", tolerance=3.0, side=16).join(cells.select("cell", "h"), "cell")
    return found.groupBy("label").agg(F.count("*").alias("cells"), F.max("h").alias("height"))


def known_segments(spark, sf_dir: str) -> DataFrame:
    """Hills of nine by nine cells that stand as high as the grid's values in their middle, those of an even height left out.

    Gaps lie between hills, and borders of blocks cut them.
    """
    g = fixtures.grid(spark, sf_dir)
    hill = lambda c: F.floor(F.col(c) / 10)
    tops = g.filter("row % 10 = 4 and col % 10 = 4").select(hill("row").alias("hr"), hill("col").alias("hc"), F.col("v").alias("top"))
    cells = g.withColumn("hr", hill("row")).withColumn("hc", hill("col")).join(tops, ["hr", "hc"])
    cells = cells.withColumn("h", F.col("top") - (F.pow(F.col("row") % 10 - 4, 2) + F.pow(F.col("col") % 10 - 4, 2)))
    cells = cells.withColumn("gap", F.when((F.col("row") % 10 == 9) | (F.col("col") % 10 == 9) | (F.col("top") % 2 == 0), 0).otherwise(1))
    found = basins.crowns_of_image(cells.drop("hr", "hc"), "h", tolerance=0.5, conditions=[("gap", 1.0)], smooth=False, side=16)
    height = found.join(cells.select("cell", "h"), "cell").groupBy("label").agg(F.count("*").alias("cells"), F.min("row").alias("top"), F.min("col").alias("left"), F.max("h").cast("long").alias("height"))
    return height


def rf_classify(spark, sf_dir: str) -> DataFrame:
    pixels = fixtures.training(spark, sf_dir).withColumn("zone", F.concat_ws("-", "fid", (F.col("pixel_id") % 8).cast("string")))
    zones = pixels.select("zone", "class").distinct()
    bands = [fixtures.band_name(nm) for nm in VNIR]
    model = models.train_forest(pixels, zones, bands, "class", "zone")
    return models.classify_zones(pixels, zones, bands, model, "zone").select("zone", "class", "predicted")


def presence_model_fit_score(spark, sf_dir: str) -> DataFrame:
    """Fitted for each class on all bands; every pixel scored as bytes by each class's model."""
    covariates = [fixtures.band_name(nm) for nm in VNIR]
    frame = fixtures.training(spark, sf_dir)
    fitted = models.fit_by_class(frame.select("pres", "class", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(covariates)]), [f"c{k}" for k in range(len(covariates))])
    cells = frame.select("pixel_id", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(covariates)])
    scored = [model.predict(cells, "p", byte=True).select("pixel_id", F.lit(name).alias("class"), "p") for name, model in fitted.items()]
    return reduce(DataFrame.unionByName, scored)


def _densities(spark, sf_dir: str) -> dict[str, tuple[DataFrame, maxent.MaxEnt]]:
    """Each class's pixels and the density of its presences, from all bands, their squares, thresholds and products of neighbours."""
    bands = [fixtures.band_name(nm) for nm in VNIR]
    frame = fixtures.training(spark, sf_dir)
    parts = {c: frame.filter(F.col("class") == c) for c in ("0", "1")}
    return {c: (part, maxent.fit(part, bands, pairs=maxent.neighbouring_pairs(len(bands)))) for c, part in parts.items()}


def maxent_bounds(spark, sf_dir: str) -> DataFrame:
    """For each class and feature the presences' mean, its bound, and whether the raw output's own mean, summed anew, lies within it."""
    out = []
    for name, (part, model) in _densities(spark, sf_dir).items():
        told = spark.createDataFrame(list(zip(model.features.names, model.presence_mean.tolist(), model.bound.tolist(), strict=True)), "feature string, mean double, bound double")
        found = maxent.feature_means(model.predict(part), model).join(told, "feature")
        within = F.abs(F.col("expected") - F.col("mean")) <= F.col("bound") + 1e-6
        out.append(found.select(F.lit(name).alias("class"), "feature", F.round("mean", 6).alias("presence_mean"), F.round("bound", 6).alias("bound"), within.alias("within")))
    return reduce(DataFrame.unionByName, out)


def maxent_total(spark, sf_dir: str) -> DataFrame:
    """Raw outputs by class: how many pixels have one, and their sum."""
    parts = [model.predict(part).select(F.lit(name).alias("class"), "p") for name, (part, model) in _densities(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts).groupBy("class").agg(F.count("p").alias("n"), F.round(F.sum("p"), 6).alias("total"))


QUERIES = {f.__name__: f for f in (fit_series, tps_warp, shift_polygons, grow_crowns, watershed, tile_merge, watershed_basins, twin_hills, known_segments, rf_classify, presence_model_fit_score, maxent_bounds, maxent_total)}
ORACLES = {
    "maxent_bounds": """WITH px AS (
  SELECT vec_id, CAST(label % 2 AS VARCHAR) AS class, label < 3 AS pres, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
b AS (SELECT *, CAST(v AS DOUBLE) + 0.6::DOUBLE AS x FROM px),
s AS MATERIALIZED (SELECT b.vec_id, b.class, b.pres, b.k, (x - lo) / (hi - lo) AS x FROM b JOIN (SELECT class, k, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL) USING (class, k)),
f AS (
  SELECT class, 'l' || k AS feature, x AS y FROM s WHERE pres UNION ALL SELECT class, 'q' || k, x * x FROM s WHERE pres
  UNION ALL SELECT class, 't' || k || '_' || h, CAST(x > h / 4.0::DOUBLE AS DOUBLE) FROM s, range(1, 4) r(h) WHERE pres
  UNION ALL SELECT a.class, 'p' || a.k || '_' || c.k, a.x * c.x FROM s a JOIN s c ON c.vec_id = a.vec_id AND c.k = a.k + 1 WHERE a.pres)
SELECT class, feature, round(avg(y), 6) AS presence_mean, round(greatest(stddev_pop(y), 0.01) / sqrt(count(*)), 6) AS bound, true AS within FROM f GROUP BY ALL""",
    "maxent_total": "SELECT CAST(label % 2 AS VARCHAR) AS class, count(*) AS n, 1.0::DOUBLE AS total FROM embeddings GROUP BY 1",
    "watershed_basins": f"""WITH RECURSIVE {GRID},
up AS (SELECT g.cell, arg_min(n.cell, (-n.v, n.cell)) AS aim FROM grid g JOIN grid n ON n.row BETWEEN g.row - 1 AND g.row + 1 AND n.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY g.cell),
climb AS (SELECT cell, aim FROM up UNION SELECT climb.cell, up.aim FROM climb JOIN up ON up.cell = climb.aim)
SELECT climb.cell, min(climb.cell) OVER (PARTITION BY climb.aim) AS label FROM climb JOIN up ON up.cell = climb.aim AND up.aim = up.cell""",
    "twin_hills": f"""WITH {GRID},
ridge AS (SELECT min(cell) AS base, max(v) FILTER (col % 10 = 2) AS l, max(v) FILTER (col % 10 = 6) AS r, max(v) FILTER (col % 10 = 4) % 7 + 0.5 < 3 AS one FROM grid WHERE row % 2 = 0 GROUP BY row, col // 10)
SELECT base AS label, CASE WHEN one THEN 9 WHEN l >= r THEN 5 ELSE 4 END AS cells, CAST(CASE WHEN one THEN greatest(l, r) ELSE l END AS DOUBLE) AS height FROM ridge
UNION ALL SELECT CASE WHEN l >= r THEN base + 5 ELSE base + 4 END, CASE WHEN l >= r THEN 4 ELSE 5 END, CAST(r AS DOUBLE) FROM ridge WHERE NOT one""",
    "known_segments": f"""WITH {GRID}, t AS (SELECT row // 10 AS hr, col // 10 AS hc, v AS top FROM grid WHERE row % 10 = 4 AND col % 10 = 4 AND v % 2 = 1)
SELECT min(cell) AS label, count(*) AS cells, min(row) AS top, min(col) AS "left", t.top AS height FROM grid JOIN t ON hr = row // 10 AND hc = col // 10 WHERE row % 10 < 9 AND col % 10 < 9 GROUP BY hr, hc, t.top""",
}
