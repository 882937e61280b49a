"""Statistics of pixels by zone, and the indices of zones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.bands import BandCatalog, band
from verdance.functions.indices import with_indices
from verdance.functions.numeric import nan_to_null


def zonal_mean(pixels: DataFrame, zone: str, bands: Iterable[str], weight: str | None = None, digits: int | None = None) -> DataFrame:
    """Mean of each band by zone, missing values left out; weighted by ``weight`` (the cell's share in the zone) if given.

    A partial aggregation on each task precedes the only shuffle, so a zone of any size is one small row per task there.
    """

    def mean(c: str) -> Column:
        value = nan_to_null(band(c))
        if weight is None:
            m = F.avg(value)
        else:
            w = F.when(value.isNotNull(), F.col(weight))
            m = F.try_divide(F.sum(w * value), F.sum(w))
        return (F.round(m, digits) if digits is not None else m).alias(c)

    return pixels.groupBy(zone).agg(*[mean(c) for c in bands])


def crown_indices(pixels: DataFrame, zone: str, names: Iterable[str] = (), all_bands: bool = True, weight: str | None = None, digits: int | None = None) -> DataFrame:
    """Band means by zone and the indices of those means (never the means of the pixels' indices)."""
    catalog, names = BandCatalog.of(pixels), list(names)
    columns = [c for _, c in catalog.bands]
    means = with_indices(zonal_mean(pixels, zone, columns, weight, digits), names)
    return means if all_bands else means.select(zone, *names)


def zonal_mean_sd(pixels: DataFrame, zone: str, bands: Iterable[str], packed: bool = False) -> DataFrame:
    """Mean1..n and Std1..n by zone, rounded to 6 digits; zones of one cell have neither.

    ``packed`` gives what comes back when both are stored in one number, millionths of the mean before the point and the
    standard deviation behind it: the deviation modulo 1, and what it had before the point added to the mean.
    """
    bands = list(bands)
    parts = []
    for k, c in enumerate(bands, 1):
        value = nan_to_null(band(c))
        sd = F.round(F.stddev_samp(value), 6)
        mean = F.when(sd.isNotNull(), F.round(F.avg(value), 6))
        if packed:
            one = F.round(mean * 1e6) + sd
            mean, sd = F.floor(one) / 1e6, F.round(one - F.floor(one), 6)
        parts += [(f"Mean{k}", mean), (f"Std{k}", sd)]
    return pixels.groupBy(zone).agg(*[e.alias(n) for n, e in parts])


def point_values(pixels: DataFrame, points: DataFrame, key: str = "cell") -> DataFrame:
    """Values of the cells that points fall to: an equi-join on the cell, left so that points outside stay."""
    return points.join(pixels, key, "left")


def zone_extreme(pixels: DataFrame, zone: str, value: str, bounding_box: bool = False, side: float | None = None) -> DataFrame:
    """(zone, cell, x, y, value): the cell with the highest finite value of each zone, the first one in row order on ties.

    Zones without a finite value are left out. With ``bounding_box`` any cell of the zone's bounding box that reaches the
    zone's highest value counts, as if the box were searched for it: the cell can then lie outside the zone. Boxes and cells then meet by equality in square
    buckets of that ``side`` (the mean side of the boxes, if none is given); a box stands in every bucket it touches.
    """
    finite = pixels.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    best = F.min_by(F.struct("cell", "x", "y"), F.struct((-F.col(value)).alias("v"), F.col("cell")))
    inside = finite.filter(F.col(zone).isNotNull())
    if not bounding_box:
        return inside.groupBy(zone).agg(best.alias("b"), F.max(value).alias(value)).select(zone, "b.cell", "b.x", "b.y", value)
    box = inside.groupBy(zone).agg(F.max(value).alias("top"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    cells = finite.select("cell", "x", "y", F.col(value).alias("v"))
    if side is None:
        side = box.agg(F.avg(F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))).first()[0]
    size = side or 1.0
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(size)))
    for i, c in (("_i", "x"), ("_j", "y")):
        box = box.withColumn(i, F.explode(F.sequence(bucket(f"lo_{c}"), bucket(f"hi_{c}"))))
        cells = cells.withColumn(i, bucket(c))
    inside_box = F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y"))
    near = box.join(cells, ["_i", "_j"]).filter(inside_box & (F.col("v") >= F.col("top")))
    return near.groupBy(zone).agg(F.min_by(F.struct("cell", "x", "y", "v"), F.col("cell")).alias("b")).select(zone, "b.cell", "b.x", "b.y", F.col("b.v").alias(value))


def mask_outside(pixels: DataFrame, zone_cells: DataFrame, value: str, crop: bool = False) -> DataFrame:
    """``value`` set to null outside the zone's cells; ``crop`` leaves only the cells of the zone's bounding box."""
    inside = zone_cells.select("cell").distinct().withColumn("_in", F.lit(True))
    out = pixels.join(inside, "cell", "left").withColumn(value, F.when(F.col("_in"), F.col(value)))
    if crop:
        box = out.filter("_in").agg(*[f(c).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])  # one row
        out = out.join(F.broadcast(box), F.col("row").between(F.col("_lo_row"), F.col("_hi_row")) & F.col("col").between(F.col("_lo_col"), F.col("_hi_col")))
    return out.select(*pixels.columns)
