"""Joins by distance between points, as equi-joins on grid buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.graph import stored


def _bucket(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size)))


def within(a: DataFrame, b: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (each with x, y) at most ``radius`` apart, with the distance.

    ``b``'s columns get the prefix ``b_``. Both sides fall to square buckets of that size; a point of ``b``, which should be
    the smaller side, is copied to the nine buckets around it, so that every pair meets in exactly one bucket.
    """
    size = max(radius, 1e-9)
    near = F.array(*[F.struct((_bucket("x", size) + i).alias("i"), (_bucket("y", size) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.withColumn("_at", F.explode(near)).select(F.col("_at.i").alias("_i"), F.col("_at.j").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = a.withColumn("_i", _bucket("x", size)).withColumn("_j", _bucket("y", size))
    d = F.sqrt((F.col("x") - F.col("b_x")) * (F.col("x") - F.col("b_x")) + (F.col("y") - F.col("b_y")) * (F.col("y") - F.col("b_y")))
    pairs = left.join(right, ["_i", "_j"]).withColumn("distance", d).drop("_i", "_j")
    return pairs.filter(F.col("distance") < radius if strict else F.col("distance") <= radius)


def count_within(a: DataFrame, b: DataFrame, radius: float, key: str = "fid", out: str = "n") -> DataFrame:
    """``a`` with the number of points of ``b`` at most ``radius`` away, 0 included."""
    counts = within(a.select(key, "x", "y"), b.select("x", "y"), radius).groupBy(key).agg(F.count("*").alias(out))
    return a.join(counts, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))


def far_from(a: DataFrame, b: DataFrame, radius: float, key: str = "fid") -> DataFrame:
    """The rows of ``a`` all of whose distances to ``b`` are above ``radius``."""
    close = within(a.select(key, "x", "y"), b.select("x", "y"), radius).select(key).distinct()
    return a.join(close, key, "left_anti")


def extent(points: DataFrame) -> tuple[float, float, float, float]:
    """(xmin, xmax, ymin, ymax) of finite points."""
    return tuple(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())


def nearest(a: DataFrame, b: DataFrame, k: int = 1, key: str = "fid", b_key: str = "fid", exclude_self: bool = False) -> DataFrame:
    """(key, rank, b_<key>, distance): the ``k`` nearest points of ``b`` for each of ``a``, ties by ``b``'s key; fewer if ``b`` has fewer.

    Places are searched, not rows: of rows in one place of ``b`` those with the smallest keys can be among the nearest, and all rows
    in one place of ``a`` have the same ones. Bucket joins with a radius that doubles: places that have ``k`` neighbours within
    the radius are done, the others go on, until none is left or the radius spans all points. The first radius holds about
    ``2 k`` points on average. Every round is written to the shared folder, so that the next one does not compute it again.
    """
    want = k + exclude_self  # a row may find itself
    place = ["x", "y"]
    copies = Window.partitionBy(*place).orderBy(b_key)
    few = b.select(F.col(b_key).alias(b_key), *place).withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= want).drop("_copy")
    pa, pb = stored(a.select(*place).distinct(), "nearest-from"), stored(few, "nearest-to")
    found = _nearest_places(pa, pb, want, b_key)
    met = a.select(key, *place).join(found, place)
    if exclude_self:
        order = Window.partitionBy(key).orderBy("distance", f"b_{b_key}")
        met = met.filter(F.col(key) != F.col(f"b_{b_key}")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return met.select(key, "rank", f"b_{b_key}", "distance")


def _nearest_places(pa: DataFrame, pb: DataFrame, k: int, b_key: str) -> DataFrame:
    """(x, y, rank, b_<key>, distance) of the ``k`` nearest of ``pb`` for each of the places ``pa``, all of them different; see nearest()."""
    boxes = [e for e in (extent(pa), extent(pb)) if e[0] is not None]
    n = pb.count()
    if len(boxes) < 2 or not n:
        empty = within(pa, pb, 1.0).filter("false")
        return empty.select("x", "y", F.lit(1).cast("long").alias("rank"), f"b_{b_key}", "distance")
    width, height = max(e[1] for e in boxes) - min(e[0] for e in boxes), max(e[3] for e in boxes) - min(e[2] for e in boxes)
    whole = math.hypot(width, height) + 1.0
    radius, found, left = min(whole, math.sqrt(max(width * height, 1e-9) * 2 * k / n / math.pi) + 1e-6), None, pa
    place = ["x", "y"]
    order = Window.partitionBy(*place).orderBy("distance", f"b_{b_key}")
    while True:
        pairs = within(left, pb, radius)
        ranked = pairs.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
        last = radius >= whole
        done = ranked if last else ranked.join(ranked.filter(F.col("rank") == k).select(*place), place, "left_semi")
        done = stored(done.select(*place, "rank", f"b_{b_key}", "distance"), "nearest-round")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = stored(left.join(done.select(*place).distinct(), place, "left_anti"), "nearest-left")
        if left.isEmpty():
            return found
        radius = min(2 * radius, whole)


def neighbours_wide(points: DataFrame, n: int, key: str = "fid", prefix: str = "IDneighb_") -> DataFrame:
    """``points`` with columns for their n nearest others."""
    near = nearest(points, points, n, key, key, exclude_self=True)
    wide = near.groupBy(key).agg(*[F.max(F.when(F.col("rank") == i, F.col(f"b_{key}"))).alias(f"{prefix}{i}") for i in range(1, n + 1)])
    return points.join(wide, key, "left")


def false_positives(cells: DataFrame, avoid: DataFrame, distance: float, share: float, most: int, seed: int | None = 0, cap: str = "min") -> DataFrame:
    """A random share of the presence cells, those farther than ``distance`` from the points to avoid.

    ``cap``: "min" takes at most ``most`` cells; "max" at least as many, as the number is the larger of both there.
    """
    present = cells.filter("presence")
    n = round(share * present.count())
    n = min(n, most) if cap == "min" else max(n, most)
    order = [F.col("cell")] if seed is None else [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell").cast("string")).cast("binary")), F.col("cell")]
    return far_from(present.orderBy(*order).limit(n), avoid, distance, "cell")


def quantile_within(seeds: DataFrame, cells: DataFrame, value: str, diameter: float, shift: tuple[float, float] = (0.0, 0.0), q: float = 0.3, key: str = "fid") -> DataFrame:
    """(key, shade): quantile of the cells around each seed after a shift."""
    moved = seeds.select(key, (F.col("x") + shift[0]).alias("x"), (F.col("y") + shift[1]).alias("y"))
    return within(cells.select("x", "y", value), moved, diameter / 2).groupBy(f"b_{key}").agg(F.percentile(value, F.lit(q)).alias("shade")).withColumnRenamed(f"b_{key}", key)


def shadow_filter(seeds: DataFrame, cells: DataFrame, value: str, cut: float, diameter: float = 6.0, shift: tuple[float, float] = (0.0, 0.0), key: str = "fid") -> DataFrame:
    """Seeds beside which, in the direction of the shift, there is shadow: the quantile lies below ``cut``."""
    dark = quantile_within(seeds, cells, value, diameter, shift, key=key).filter(F.col("shade") < cut)
    return seeds.join(dark.select(key), key, "left_semi")
