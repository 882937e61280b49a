"""Queries on zones, attributes, ranks and samples, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.bands import BandCatalog
from verdance.functions.indices import INDICES, index_column
from verdance.operators import attributes, inspect, stats, zonal
from verdance.plans.index_queries import CLOSE, FAR
from verdance.plans.index_formulas import index_sql
from verdance.plans.sql import DN, VNIR, SqlBands, vnir
from verdance.session import shared_dir
from verdance.sources import fixtures, rasters

B800, B670 = fixtures.band_name(800), fixtures.band_name(670)
BANDS = [fixtures.band_name(nm) for nm in VNIR]


def crown_ndvi(spark, sf_dir: str) -> DataFrame:
    """Band means of each crown and the NDVI of the means."""
    pixels = fixtures.spectra(spark, sf_dir).select("fid", f"`{B800}`", f"`{B670}`")
    means = zonal.crown_indices(pixels, "fid", ["NDVI"])
    return means.select("fid", *[F.round(F.col(f"`{c}`"), 6).alias(n) for c, n in ((B800, "b800"), (B670, "b670"), ("NDVI", "ndvi"))])


def crown_indices_all(spark, sf_dir: str) -> DataFrame:
    names = [n for n in INDICES if n not in FAR + CLOSE]
    out = zonal.crown_indices(fixtures.spectra(spark, sf_dir), "fid", names, all_bands=False)
    return out.select("fid", *[F.round(n, 6).alias(n) for n in names])


def crown_band_mean_sd(spark, sf_dir: str) -> DataFrame:
    return zonal.zonal_mean_sd(fixtures.spectra(spark, sf_dir), "fid", BANDS)


def crown_mean_sd_packed(spark, sf_dir: str) -> DataFrame:
    """Both statistics as one number would bring them back."""
    pixels = fixtures.spectra(spark, sf_dir).select("fid", (F.col(f"`{B800}`") * 9).alias("v"))
    return zonal.zonal_mean_sd(pixels, "fid", ["v"], packed=True)


def max_point(spark, sf_dir: str) -> DataFrame:
    pixels = fixtures.spectra(spark, sf_dir).select("fid", F.col("pixel_id").alias("cell"), "x", "y", F.col(f"`{B800}`").alias("v"))
    return zonal.zone_extreme(pixels, "fid", "v")


def max_point_box(spark, sf_dir: str) -> DataFrame:
    """The zone's maximum searched for in its bounding box."""
    pixels = fixtures.spectra(spark, sf_dir).select("fid", F.col("pixel_id").alias("cell"), "x", "y", F.col(f"`{B800}`").alias("v"))
    return zonal.zone_extreme(pixels, "fid", "v", bounding_box=True).select("fid", "cell", "v")


def _image(spark, sf_dir: str, part: int) -> DataFrame:
    pixels = fixtures.spectra(spark, sf_dir).filter(F.col("pixel_id") % 2 == part).select("fid", f"`{B800}`", f"`{B670}`")
    means = zonal.crown_indices(pixels, "fid", ["NDVI"], all_bands=False)
    return means.select(F.col("fid").cast("double").alias("primalX"), (F.col("fid") * 10).cast("double").alias("primalY"), F.round("NDVI", 6).alias("NDVI"))


def merge_by_attributes(spark, sf_dir: str) -> DataFrame:
    return attributes.merge_by_attributes([_image(spark, sf_dir, 0), _image(spark, sf_dir, 1)])


def crown_db_merge(spark, sf_dir: str) -> DataFrame:
    """Crowns of one flight with new index values; values that a crown has already come first."""
    x = F.col("primalX")
    crowns = _image(spark, sf_dir, 0).select(
        "primalX", "primalY", F.when(x % 3 == 0, F.lit("f1")).otherwise(F.lit("f2")).alias("flight_name"), F.lit("s1").alias("sensor"), F.when(x % 2 == 0, F.lit(0.5)).alias("NDVI")
    )
    values = _image(spark, sf_dir, 1).withColumn("SR", F.round((1 + F.col("NDVI")) / (1 - F.col("NDVI")), 6))
    return attributes.attach(attributes.select_flights(crowns, "f2", "s1"), values, ["primalX", "primalY"])


def indiv_bands_union(spark, sf_dir: str) -> DataFrame:
    dn = fixtures.dn_long(spark, sf_dir)
    near, far = dn.filter("band = 0").select("event_id", "ID", "DN_s"), dn.filter("band = 1").select("event_id", "band", "DN_s")
    return attributes.union_named({"near": near, "missing": None, "far": far})


def drop_all_na(spark, sf_dir: str) -> DataFrame:
    dn = fixtures.dn_long(spark, sf_dir).withColumn("DN_s", F.when(F.col("ID") % 5 != 0, F.col("DN_s")))
    return attributes.drop_all_null(dn, "ID", ["DN_s"]).select("event_id", "ID", "DN_s")


def control_median(spark, sf_dir: str) -> DataFrame:
    return stats.subtract_control(fixtures.dn_long(spark, sf_dir), digits=6)


def _ranked(spark, sf_dir: str) -> DataFrame:
    return fixtures.spectra(spark, sf_dir).select("fid", "pixel_id", (F.col("pixel_id") % 200).alias("cell"), F.round(F.col(f"`{B800}`"), 2).alias("v"))


def crown_quantile(spark, sf_dir: str) -> DataFrame:
    return stats.crown_quantiles(_ranked(spark, sf_dir), "fid", "v").select("pixel_id", "fid", "quantile")


def crown_quantile_trim(spark, sf_dir: str) -> DataFrame:
    return stats.trim_to_quantiles(_ranked(spark, sf_dir), "fid", "v", range(75, 101)).select("pixel_id", "fid", "quantile")


def crown_quantile_mosaic(spark, sf_dir: str) -> DataFrame:
    """Trimmed crowns that overlap, as one layer over all cells."""
    pixels = _ranked(spark, sf_dir)
    return stats.mosaic_max(stats.trim_to_quantiles(pixels, "fid", "v", range(90, 101)), pixels.select("cell").distinct(), "quantile")


def _strata(spark, sf_dir: str) -> DataFrame:
    return stats.strata(fixtures.attributes(spark, sf_dir), ["p_size", "p_retailprice"], ["p_brand"])


def strata_nd(spark, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).select("id", "stratum")


def stratified_sample(spark, sf_dir: str) -> DataFrame:
    return stats.stratified_sample(_strata(spark, sf_dir), "stratum", 300, "id", seed=None).select("id", "stratum")


def stratified_sample_random(spark, sf_dir: str) -> DataFrame:
    """The same with a seeded random order."""
    return stats.stratified_sample(_strata(spark, sf_dir), "stratum", 300, "id", seed=7).select("id", "stratum")


def sample_rows(spark, sf_dir: str) -> DataFrame:
    return stats.sample_rows(fixtures.attributes(spark, sf_dir), 100, "id", seed=None)


def sampled_features(spark, sf_dir: str) -> DataFrame:
    """Objects spread over the strata of their numeric attributes."""
    return stats.sample_features(fixtures.attributes(spark, sf_dir), 60, "id", ignore="brand", seed=None)


def pairs_corr(spark, sf_dir: str) -> DataFrame:
    df = fixtures.attributes(spark, sf_dir)
    return stats.pair_correlations(df, stats.select_columns(df, ignore="brand"))


def growing_ecdf(spark, sf_dir: str) -> DataFrame:
    """Cut-offs at which crowns were closed, as counts and cumulative shares."""
    return stats.growing_efficiency(fixtures.crown_params(spark, sf_dir), 99)


def scene_dates(spark, sf_dir: str) -> DataFrame:
    scenes = fixtures.scene_names(spark, sf_dir)
    sensor, day = rasters.scene_parts(F.col("path"))
    return scenes.select("scene_id", sensor.alias("sensor"), day.alias("date"))


def raster_overview(spark, sf_dir: str) -> DataFrame:
    """Catalogue of a folder of images, one a nation: their headers are written as files and read back."""
    folder = f"{shared_dir(spark)}/overview-{uuid4().hex}"
    key = F.col("n_nationkey").cast("string")
    size = {"samples": "20 + n_regionkey", "lines": "10 + n_nationkey", "bands": "1 + n_nationkey % 4"}
    lines = [F.lit("ENVI"), *[F.concat(F.lit(f"{k} = "), F.expr(f"CAST({v} AS STRING)")) for k, v in size.items()], F.concat(F.lit("map info = {UTM, 1, 1, "), key, F.lit("00, 5000, 2, 2, 29, North}"))]
    written = fixtures.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), key).alias("name"), F.concat_ws("\n", *lines).alias("text"))
    rasters.write_texts(written, folder, ".hdr")
    return rasters.raster_catalog(spark, folder).drop("fullname")


def dataset_copy(spark, sf_dir: str) -> DataFrame:
    """A dataset copied with all its files and read from its copy."""
    target = f"{shared_dir(spark)}/copy-{uuid4().hex}"
    rasters.copy_dataset(spark, f"{sf_dir}/supplier.parquet", target)
    return spark.read.parquet(target).select("s_suppkey", "s_nationkey", "s_acctbal")


def batch_index(spark, sf_dir: str) -> DataFrame:
    """Indices of a broad-band sensor: band names come from its preset, not from the file."""
    pixels = fixtures.spectra(spark, sf_dir).select("pixel_id", *[F.col(f"`{fixtures.band_name(nm)}`").alias(f"band{k}") for k, nm in enumerate((480, 550, 650, 820))])
    names = [f"X{nm:.6f}.Nanometers" for nm in rasters.SENSOR_BANDS["terrabella"]]
    catalog = BandCatalog([f"band{k}" for k in range(4)], names=names)
    return pixels.select("pixel_id", *[index_column(catalog, n).alias(n) for n in ("NDVI", "SR", "Greenness")])


def crown_chips(spark, sf_dir: str) -> DataFrame:
    """Pixels around each of some points: around its crown where there is one. Counts and sums of the chips."""
    pixels = fixtures.spectra(spark, sf_dir)
    bounds = pixels.groupBy(F.col("fid").cast("double").alias("primalX")).agg(*[f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    crowns = bounds.withColumn("primalY", F.col("primalX") * 10).filter("primalX % 2 = 0")
    points = pixels.groupBy("fid").agg(F.count("*").alias("n")).select("fid", F.col("fid").cast("double").alias("primalX"), (F.col("fid") * 10).cast("double").alias("primalY"))
    out = inspect.chips(points, crowns, pixels, [B670, B800], 10.0)
    total = F.aggregate("pixels", F.lit(0.0), lambda s, p: s + p["v"][1])
    return out.select("fid", "found", F.coalesce(F.size("pixels"), F.lit(0)).cast("long").alias("n"), F.round(total, 6).alias("total"))


_M = SqlBands(VNIR, "m{j}")
_MEANS = "SELECT label AS fid, " + ", ".join(f"avg(CAST(embedding[{j}] AS DOUBLE) + 0.6::DOUBLE) AS m{j}" for j in range(1, 65)) + " FROM embeddings GROUP BY label"
_IMAGE = """SELECT CAST(label AS DOUBLE) AS primalX, CAST(label * 10 AS DOUBLE) AS primalY,
  round((avg({n}) - avg({r})) / (avg({n}) + avg({r})), 6) AS NDVI FROM embeddings WHERE vec_id % 2 = {p} GROUP BY label"""


def _image_sql(p: int) -> str:
    return _IMAGE.format(n=vnir(800), r=vnir(670), p=p)


_RANKED = f"""r AS (SELECT vec_id AS pixel_id, label AS fid, vec_id % 200 AS cell, round({vnir(800)}, 2) AS v FROM embeddings),
k AS (SELECT *, rank() OVER (PARTITION BY fid ORDER BY v) + (count(*) OVER (PARTITION BY fid, v) - 1) / 2.0::DOUBLE AS rk FROM r),
q AS (SELECT pixel_id, fid, cell, round_even(100 * rk / max(rk) OVER (PARTITION BY fid), 0) AS quantile FROM k)"""
_STRATA = """p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS b, p_brand FROM part),
c AS (SELECT quantile_cont(a, [0, 0.05, 0.2, 0.8, 0.95, 1]) AS qa, quantile_cont(b, [0, 0.05, 0.2, 0.8, 0.95, 1]) AS qb FROM p),
s AS (SELECT id, CASE WHEN a <= qa[2] THEN '1' WHEN a <= qa[3] THEN '2' WHEN a <= qa[4] THEN '3' WHEN a <= qa[5] THEN '4' ELSE '5' END
          || CASE WHEN b <= qb[2] THEN '1' WHEN b <= qb[3] THEN '2' WHEN b <= qb[4] THEN '3' WHEN b <= qb[5] THEN '4' ELSE '5' END || p_brand AS stratum FROM p, c)"""

QUERIES = {
    f.__name__: f
    for f in (
        crown_ndvi, crown_indices_all, crown_band_mean_sd, crown_mean_sd_packed, max_point, max_point_box, merge_by_attributes, crown_db_merge, indiv_bands_union, drop_all_na, control_median,
        crown_quantile, crown_quantile_trim, crown_quantile_mosaic, strata_nd, stratified_sample, stratified_sample_random, sampled_features, sample_rows, pairs_corr, growing_ecdf, scene_dates, raster_overview, dataset_copy, batch_index, crown_chips,
    )
}

_X = f"x AS (SELECT label AS fid, vec_id AS cell, vec_id % 25 + 0.5::DOUBLE AS x, -(vec_id // 25 + 0.5::DOUBLE) AS y, {vnir(800)} AS v FROM embeddings)"
ORACLES = {
    "crown_ndvi": f"SELECT label AS fid, round(avg({vnir(800)}), 6) AS b800, round(avg({vnir(670)}), 6) AS b670, round((avg({vnir(800)}) - avg({vnir(670)})) / (avg({vnir(800)}) + avg({vnir(670)})), 6) AS ndvi FROM embeddings GROUP BY label",
    "crown_indices_all": f"WITH m AS ({_MEANS}) SELECT fid, " + ", ".join(f'round({index_sql(n, _M)}, 6) AS "{n}"' for n in INDICES if n not in FAR + CLOSE) + " FROM m",
    "crown_band_mean_sd": "SELECT label AS fid, " + ", ".join(
        f"CASE WHEN count(*) > 1 THEN round(avg(CAST(embedding[{j}] AS DOUBLE) + 0.6::DOUBLE), 6) END AS Mean{j}, round(stddev_samp(CAST(embedding[{j}] AS DOUBLE) + 0.6::DOUBLE), 6) AS Std{j}" for j in range(1, 65)) + " FROM embeddings GROUP BY label",
    "crown_mean_sd_packed": f"""WITH m AS (SELECT label AS fid, round(round(avg({vnir(800)} * 9), 6) * 1e6) + round(stddev_samp({vnir(800)} * 9), 6) AS one FROM embeddings GROUP BY label)
SELECT fid, floor(one) / 1e6 AS Mean1, round(one - floor(one), 6) AS Std1 FROM m""",
    "raster_overview": """SELECT concat('n', n_nationkey, '.bsq') AS fname, CAST(10 + n_nationkey AS BIGINT) AS nrow, CAST(20 + n_regionkey AS BIGINT) AS ncol, CAST(1 + n_nationkey % 4 AS BIGINT) AS layers,
  CAST(concat(n_nationkey, '00') AS DOUBLE) AS xmin, CAST(concat(n_nationkey, '00') AS DOUBLE) + 2 * (20 + n_regionkey) AS xmax, 5000::DOUBLE - 2 * (10 + n_nationkey) AS ymin, 5000::DOUBLE AS ymax, '29,North' AS crs, 'ok' AS status FROM nation""",
    "dataset_copy": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
    "max_point": f"WITH {_X} SELECT fid, cell, x, y, v FROM x QUALIFY row_number() OVER (PARTITION BY fid ORDER BY v DESC, cell) = 1",
    "max_point_box": f"""WITH {_X}, b AS (SELECT fid, max(v) AS top, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM x GROUP BY fid)
SELECT b.fid, min(x.cell) AS cell, arg_min(x.v, x.cell) AS v FROM b JOIN x ON x.x BETWEEN x0 AND x1 AND x.y BETWEEN y0 AND y1 AND x.v >= top GROUP BY b.fid""",
    "merge_by_attributes": f"WITH a AS ({_image_sql(0)}), b AS ({_image_sql(1)}) SELECT primalX, primalY, a.NDVI AS i1NDVI, b.NDVI AS i2NDVI FROM a JOIN b USING (primalX, primalY)",
    "crown_db_merge": f"""WITH a AS ({_image_sql(0)}), b AS ({_image_sql(1)})
SELECT a.primalX, a.primalY, CASE WHEN a.primalX % 3 = 0 THEN 'f1' ELSE 'f2' END AS flight_name, 's1' AS sensor,
       coalesce(CASE WHEN a.primalX % 2 = 0 THEN 0.5::DOUBLE END, b.NDVI) AS NDVI, round((1 + b.NDVI) / (1 - b.NDVI), 6) AS SR
FROM a LEFT JOIN b USING (primalX, primalY) WHERE a.primalX % 3 <> 0""",
    "indiv_bands_union": f"""WITH {DN} SELECT event_id, ID, DN_s, 'near' AS dfname, NULL::BIGINT AS band FROM dn WHERE band = 0
UNION ALL SELECT event_id, NULL, DN_s, 'far', band FROM dn WHERE band = 1""",
    "drop_all_na": f"WITH {DN} SELECT event_id, ID, DN_s FROM dn WHERE ID % 5 <> 0 AND ID IN (SELECT ID FROM dn WHERE DN_s IS NOT NULL)",
    "control_median": f"""WITH {DN}, m AS (SELECT ID, dfname, band, median(DN_s) AS med FROM dn GROUP BY ALL)
SELECT event_id, dn.ID, dn.dfname, dn.band, DN_s,
       round(DN_s - (coalesce(a.med, 0) + coalesce(b.med, 0)) / nullif(CAST(a.med IS NOT NULL AS DOUBLE) + CAST(b.med IS NOT NULL AS DOUBLE), 0), 6) AS DN_c
FROM dn LEFT JOIN m a ON a.ID = IDneighb_1 AND a.dfname = dn.dfname AND a.band = dn.band LEFT JOIN m b ON b.ID = IDneighb_2 AND b.dfname = dn.dfname AND b.band = dn.band""",
    "crown_quantile": f"WITH {_RANKED} SELECT pixel_id, fid, quantile FROM q",
    "crown_quantile_trim": f"WITH {_RANKED} SELECT pixel_id, fid, quantile FROM q WHERE quantile >= 75",
    "crown_quantile_mosaic": f"WITH {_RANKED} SELECT cell, coalesce(max(quantile) FILTER (WHERE quantile >= 90), 0::DOUBLE) AS quantile FROM q GROUP BY cell",
    "strata_nd": f"WITH {_STRATA} SELECT id, stratum FROM s",
    "stratified_sample": f"""WITH {_STRATA}, n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id) AS rn, (SELECT ceil(300 / count(DISTINCT stratum)) FROM s) AS most FROM s)
SELECT id, stratum FROM n WHERE rn <= most ORDER BY id LIMIT 300""",
    "stratified_sample_random": f"""WITH {_STRATA}, n AS (SELECT *, md5('7:' || id) AS o, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || id), id) AS rn, (SELECT ceil(300 / count(DISTINCT stratum)) FROM s) AS most FROM s)
SELECT id, stratum FROM n WHERE rn <= most ORDER BY o, id LIMIT 300""",
    "sample_rows": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, p_brand FROM part ORDER BY id LIMIT 100",
    "sampled_features": """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, p_brand FROM part),
c AS (SELECT quantile_cont(p_size, [0.3, 0.45, 0.55, 0.7]) AS a, quantile_cont(p_retailprice, [0.3, 0.45, 0.55, 0.7]) AS b FROM p),
s AS (SELECT p.*, CASE WHEN p_size <= a[1] THEN 1 WHEN p_size <= a[2] THEN 2 WHEN p_size <= a[3] THEN 3 WHEN p_size <= a[4] THEN 4 ELSE 5 END * 10
           + CASE WHEN p_retailprice <= b[1] THEN 1 WHEN p_retailprice <= b[2] THEN 2 WHEN p_retailprice <= b[3] THEN 3 WHEN p_retailprice <= b[4] THEN 4 ELSE 5 END AS stratum FROM p, c),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id) AS rn, (SELECT ceil(60 / count(DISTINCT stratum)) FROM s) AS most FROM s)
SELECT id, p_size, p_retailprice, p_brand FROM n WHERE rn <= most ORDER BY id LIMIT 60""",
    "pairs_corr": """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part)
SELECT 'id' AS a, 'p_size' AS b, round(corr(id, p_size), 6) AS r FROM p UNION ALL SELECT 'id', 'p_retailprice', round(corr(id, p_retailprice), 6) FROM p
UNION ALL SELECT 'p_size', 'p_retailprice', round(corr(p_size, p_retailprice), 6) FROM p""",
    "growing_ecdf": """WITH c AS (SELECT CAST(99 - 2 * (o_orderkey % 10) AS BIGINT) AS probcut FROM orders),
g AS (SELECT probcut, count(*) AS n, CAST(sum((99 - probcut) // 2 + 1) AS BIGINT) AS sequences FROM c GROUP BY probcut)
SELECT probcut, n, sequences, CAST(sum(n) OVER (ORDER BY probcut) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS ecdf,
       CAST(sum(sequences) OVER (ORDER BY probcut) AS DOUBLE) / CAST(sum(sequences) OVER () AS DOUBLE) AS ecdf_weighted FROM g""",
    "scene_dates": "SELECT CAST(o_orderkey AS BIGINT) AS scene_id, 's0' || (1 + o_orderkey % 3) AS sensor, CAST(o_orderdate AS DATE) AS date FROM orders",
    "batch_index": f"SELECT vec_id AS pixel_id, ({vnir(820)} - {vnir(650)}) / ({vnir(820)} + {vnir(650)}) AS NDVI, {vnir(820)} / {vnir(650)} AS SR, {vnir(550)} / {vnir(650)} AS Greenness FROM embeddings",
    "crown_chips": f"""WITH {_X}, c AS (SELECT fid, min(x) - 10 AS x0, max(x) + 10 AS x1, min(y) - 10 AS y0, max(y) + 10 AS y1 FROM x WHERE fid % 2 = 0 GROUP BY fid),
w AS (SELECT f.fid, c.fid IS NOT NULL AS found, coalesce(x0, f.fid - 10) AS x0, coalesce(x1, f.fid + 10) AS x1, coalesce(y0, f.fid * 10 - 10) AS y0, coalesce(y1, f.fid * 10 + 10) AS y1
      FROM (SELECT DISTINCT fid FROM x) f LEFT JOIN c ON c.fid = f.fid)
SELECT w.fid, found, count(x.cell) AS n, round(sum(x.v), 6) AS total FROM w LEFT JOIN x ON x.x BETWEEN x0 AND x1 AND x.y BETWEEN y0 AND y1 GROUP BY w.fid, found""",
}
