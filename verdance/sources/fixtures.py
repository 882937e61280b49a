"""The driver's tables in the shapes that the operators expect (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band_name(nm: int) -> str:
    return f"X{nm}.000000.Nanometers"


def spectra(spark: SparkSession, sf_dir: str, start: int = 400, step: int = 10, bands: int = 64) -> DataFrame:
    """Pixels of embeddings: positive reflectances, one column a band, on a grid of 25 columns; ``fid`` is the crown."""
    vid = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vid.alias("pixel_id"),
        F.col("label").alias("fid"),
        (vid % 25).alias("col"),
        F.expr("vec_id div 25").alias("row"),
        (vid % 25 + 0.5).alias("x"),
        (-(F.expr("vec_id div 25") + 0.5)).alias("y"),
        *[(F.element_at("embedding", j + 1).cast("double") + 0.6).alias(band_name(start + step * j)) for j in range(bands)],
    )


def exact_bands(spark: SparkSession, sf_dir: str, wavelengths: tuple[int, ...] = (720, 735, 736, 900, 990)) -> DataFrame:
    """Pixels with exactly these bands."""
    cells = [(F.element_at("embedding", k + 1).cast("double") + 0.6).alias(band_name(nm)) for k, nm in enumerate(wavelengths)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.col("label").alias("fid"), *cells)


def grid(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """A full grid over 0..1000 x 0..1000: in each cell the number of lineitem rows that fall to it."""
    side = spark.range(size)
    cells = side.select(F.col("id").alias("row")).join(side.select(F.col("id").alias("col")), how="cross")  # size * size rows
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % size).alias("row"), (F.col("l_partkey") % size).alias("col")).agg(F.count("*").alias("v"))
    return cells.join(counts, ["row", "col"], "left").select(
        "row", "col", (F.col("row") * size + F.col("col") + 1).alias("cell"),
        ((F.col("col") + 0.5) * 20).alias("x"), (1000 - (F.col("row") + 0.5) * 20).alias("y"), F.coalesce("v", F.lit(0)).alias("v"),
    )


def grid_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with ``presence``: cells above its 0.7-quantile."""
    cells = grid(spark, sf_dir)
    cut = cells.agg(F.percentile("v", F.lit(0.7)).alias("cut"))  # one row
    return cells.join(F.broadcast(cut), how="cross").withColumn("presence", F.col("v") > F.col("cut")).drop("cut")


def points_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("fid"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 1000).cast("double").alias("y"), F.col("c_mktsegment").alias("class"))


def points_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(k.alias("fid"), ((k * 53 + 7) % 1000).cast("double").alias("x"), ((k * 29 + 3) % 1000).cast("double").alias("y"))


def dn_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of objects by data set and band, with two neighbours for each object."""
    own = (F.col("user_id") % 20).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", own.alias("ID"), F.col("event_type").alias("dfname"), (F.hour("ts") % 4).cast("long").alias("band"), F.col("value").cast("double").alias("DN_s"),
        ((own + 1) % 20).alias("IDneighb_1"), ((own + 2) % 20).alias("IDneighb_2"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each object and day."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("im_date")).agg(F.round(F.avg("value"), 6).alias("DN_c"))


def scene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(F.lit("s0"), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit("_"), day, F.lit("T110213Z_MS-0000020736-0000000000.tif"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("scene_id"), name.alias("path"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), "p_brand"
    )


def crown_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((99 - 2 * (F.col("o_orderkey") % 10)).cast("long").alias("probcut"))


def ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around points_b with a square hole in each third one, and a second part in each fourth."""
    p = points_b(spark, sf_dir).withColumn("side", (10 * (1 + F.col("fid") % 9)).cast("double"))
    x, y, s = F.col("x"), F.col("y"), F.col("side")

    def square(cx, cy, half):
        return ring([(cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half), (cx - half, cy - half)])

    part = lambda n, hole, pts: F.struct(F.lit(n).alias("part"), F.lit(hole).alias("hole"), pts.alias("pts"))
    outer, hole, second = part(1, False, square(x, y, s / 2)), part(1, True, square(x, y, s / 4)), part(2, False, square(x + 2 * s, y, s / 4))
    rings = F.concat(F.array(outer), F.when(F.col("fid") % 3 == 0, F.array(hole)).otherwise(F.slice(F.array(outer), 1, 0)), F.when(F.col("fid") % 4 == 0, F.array(second)).otherwise(F.slice(F.array(outer), 1, 0)))
    return p.select("fid", "x", "y", "side", rings.alias("rings"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with presences (crowns 0 to 2) and two classes."""
    return spectra(spark, sf_dir).withColumn("pres", (F.col("fid") < 3).cast("int")).withColumn("class", (F.col("fid") % 2).cast("string"))
