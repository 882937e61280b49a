"""Queries by user aggregates and table functions, and files written and read again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import tables
from verdance.operators import spatial, vector
from verdance.operators.aggregates import BinnedQuantile, Entropy, Mode, aggregate_by, focal_aggregate
from verdance.plans.space_queries import ORACLES as SPACE
from verdance.plans.sql import GRID, POINTS_B
from verdance.session import shared_dir
from verdance.sources import fixtures, sinks, tiff, vectors


def zone_aggregates(spark, sf_dir: str) -> DataFrame:
    """Mode, entropy and binned quantile of values by zone, one of the zones with a third of all rows."""
    line = fixtures.table(spark, sf_dir, "lineitem")
    zone = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey") % 40).cast("long")
    cells = line.select(zone.alias("zone"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    out = aggregate_by(cells, ["zone"], "q", Mode(), "mode")
    out = out.join(aggregate_by(cells, ["zone"], "q", Entropy(), "entropy").withColumn("entropy", F.round("entropy", 8)), "zone")
    return out.join(aggregate_by(cells, ["zone"], "price", BinnedQuantile(0.9, 512.0), "high"), "zone")


def focal_mode3(spark, sf_dir: str) -> DataFrame:
    """The most frequent value in the square around each cell."""
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return focal_aggregate(fixtures.grid(spark, sf_dir), "v", square, Mode(), "mode").select("cell", "mode")


def tile_error_rows(spark, sf_dir: str) -> DataFrame:
    """What error_observations gives, by table functions: tiles with their presences first, then points, one tile at a time."""
    cells = fixtures.grid_binary(spark, sf_dir)
    points = fixtures.points_b(spark, sf_dir).withColumn("class", (F.col("fid") % 2).cast("string"))
    far = spatial.far_from(cells.select("cell", "x", "y"), points, 16.0, "cell").orderBy("cell").limit(100)
    unseen = far.join(points.select("class").distinct(), how="cross")  # 100 rows by two classes
    asked = points.withColumn("kind", F.lit(2)).select("kind", "fid", "class", "x", "y").unionByName(unseen.select(F.lit(1).alias("kind"), F.col("cell").alias("fid"), "class", "x", "y"))
    found = tables.presences_near(asked, cells.filter("presence"), 8.0, 100.0)
    return found.select((F.col("kind") - 1).cast("long").alias("vis"), "pred", "class")


def tiff_round_trip(spark, sf_dir: str) -> DataFrame:
    """The grid's values as TIFF tiles of 16 cells, read back as pixels."""
    path = f"{shared_dir(spark)}/tiff-{uuid4().hex}"
    sinks.write_tiff(fixtures.grid(spark, sf_dir).drop("x", "y"), path, ["cell", "v"], 0.0, 1000.0, 20.0, 20.0, side=16)
    return tiff.read_tiff(spark, path, ["number", "v"]).select(F.col("number").cast("long").alias("number"), "x", "y", "v")


def shapes_round_trip(spark, sf_dir: str) -> DataFrame:
    """Squares, some with holes or second parts, as shapefiles and read back: their numbers, rings, and areas."""
    path = f"{shared_dir(spark)}/shapes-{uuid4().hex}"
    sinks.write_shapes(fixtures.squares(spark, sf_dir), path, ["fid", "side"])
    back = vectors.read_vectors(spark, path, {"fid": "long", "side": "double"})
    holes = F.size(F.filter("rings", lambda r: r["hole"])).cast("long")
    return back.select("fid", "side", F.size("rings").cast("long").alias("n_rings"), holes.alias("holes"), F.round(vector.polygon_area(F.col("rings")), 6).alias("area"))


QUERIES = {f.__name__: f for f in (zone_aggregates, focal_mode3, tile_error_rows, tiff_round_trip, shapes_round_trip)}
ORACLES = {
    "zone_aggregates": """WITH c AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE CAST(l_suppkey % 40 AS BIGINT) END AS zone, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem),
n AS (SELECT zone, q, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT zone, arg_min(q, (-n, q)) AS mode, sum(n) AS total FROM n GROUP BY zone),
e AS (SELECT zone, round(-sum(n / total * ln(n / total)), 8) AS entropy FROM n JOIN m USING (zone) GROUP BY zone),
r AS (SELECT zone, floor(price / 512) * 512 AS high, row_number() OVER (PARTITION BY zone ORDER BY price) AS k, count(*) OVER (PARTITION BY zone) AS total FROM c)
SELECT zone, mode, entropy, high FROM m JOIN e USING (zone) JOIN (SELECT zone, high FROM r WHERE k = (9 * total + 9) // 10) USING (zone)""",
    "focal_mode3": f"""WITH {GRID}, n AS (SELECT g.cell, h.v, count(*) AS n FROM grid g JOIN grid h ON h.row BETWEEN g.row - 1 AND g.row + 1 AND h.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY ALL)
SELECT cell, CAST(arg_min(v, (-n, v)) AS DOUBLE) AS mode FROM n GROUP BY cell""",
    "tiff_round_trip": f"WITH {GRID} SELECT CAST(cell AS BIGINT) AS number, x, y, CAST(v AS DOUBLE) AS v FROM grid",
    "shapes_round_trip": f"""WITH {POINTS_B}, s AS (SELECT fid, CAST(10 * (1 + fid % 9) AS DOUBLE) AS side, CAST(fid % 3 = 0 AS BIGINT) AS holes, CAST(fid % 4 = 0 AS BIGINT) AS more FROM b)
SELECT fid, side, 1 + holes + more AS n_rings, holes, round(side * side * (1 + (more - holes) * 0.25::DOUBLE), 6) AS area FROM s""",
    "tile_error_rows": SPACE["error_observations"],
}
