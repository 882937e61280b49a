"""Table functions for SQL: spread places over tiles, and count presences around points tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class TilesNear:
    """``tiles_near(x, y, reach, side)``: (tx, ty) of the tiles of ``side`` that a square of half width ``reach`` touches; none without a place."""

    def eval(self, x: float, y: float, reach: float, side: float) -> Iterator[tuple]:
        if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
            return
        for tx in range(math.floor((x - reach) / side), math.floor((x + reach) / side) + 1):
            for ty in range(math.floor((y - reach) / side), math.floor((y + reach) / side) + 1):
                yield tx, ty


class CountNear:
    """``count_near(TABLE(t) PARTITION BY tile ORDER BY kind, radius)``: (kind, fid, class, pred) of a tile's points.

    ``t`` has kind, fid, class, x, y. Rows of kind 0 are presences and held in buckets as wide as the radius; they come first, and
    there are as many as a tile and its margin have cells. Every later row is a point: it is told at once, with the number of
    presences at most ``radius`` away, and forgotten.
    """

    def __init__(self):
        self.held: dict[tuple[int, int], list[tuple[float, float]]] = {}

    def eval(self, row: Row, radius: float) -> Iterator[tuple]:
        x, y = row["x"], row["y"]
        i, j = math.floor(x / radius), math.floor(y / radius)
        if row["kind"] == 0:
            self.held.setdefault((i, j), []).append((x, y))
            return
        near = (p for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for p in self.held.get((a, b), ()))
        yield row["kind"], row["fid"], row["class"], sum(math.sqrt((p[0] - x) * (p[0] - x) + (p[1] - y) * (p[1] - y)) <= radius for p in near)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("tiles_near", udtf(TilesNear, returnType="tx long, ty long"))
    spark.udtf.register("count_near", udtf(CountNear, returnType="kind int, fid long, class string, pred long"))


def presences_near(points: DataFrame, present: DataFrame, radius: float, side: float) -> DataFrame:
    """(kind, fid, class, pred): presences (x, y) at most ``radius`` from each point (kind, fid, class, x, y), kinds being above 0.

    Presences go to all tiles that their circles touch, points to their own. Points without a place have no row; ``radius`` is
    above 0, and a tile as wide as a few radii keeps the copies few.
    """
    if radius <= 0 or side <= 0:
        raise ValueError("radius and side must be above 0")
    spark = points.sparkSession
    register(spark)
    one = lambda df: df.select("kind", F.col("fid").cast("long").alias("fid"), F.col("class").cast("string").alias("class"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    nothing = {"kind": F.lit(0), "fid": F.lit(None), "class": F.lit(None)}
    return spark.sql(
        """WITH spread AS (
             SELECT p.*, t.tx, t.ty FROM {points} p, LATERAL tiles_near(p.x, p.y, 0D, CAST(:side AS DOUBLE)) t
             UNION ALL SELECT p.*, t.tx, t.ty FROM {present} p, LATERAL tiles_near(p.x, p.y, CAST(:radius AS DOUBLE), CAST(:side AS DOUBLE)) t)
           SELECT * FROM count_near(TABLE(SELECT * FROM spread) PARTITION BY (tx, ty) ORDER BY (kind), CAST(:radius AS DOUBLE))""",
        {"side": float(side), "radius": float(radius)}, points=one(points), present=one(present.select("x", "y").withColumns(nothing)),
    )
