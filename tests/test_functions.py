"""Numbers, bands and indices against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from verdance.functions import indices
from verdance.functions.bands import BandCatalog
from verdance.functions.numeric import average_rank, ieee_div, ieee_ln, nan_to_null, qchisq

INF = float("inf")


def name(nm):
    return f"X{nm}.000000.Nanometers"


def spectrum(spark, **bands):
    return spark.createDataFrame([tuple(bands.values())], ", ".join(f"`{name(k[1:])}` double" for k in bands))


def test_division_and_logarithm_follow_ieee(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.5, INF, -INF] and math.isnan(got[3]) and got[4:6] == [None, None] and math.isnan(got[6])
    logs = [r[0] for r in spark.createDataFrame([(math.e,), (0.0,), (-1.0,), (None,)], "x double").select(ieee_ln(F.col("x"))).collect()]
    assert logs[:2] == [1.0, -INF] and math.isnan(logs[2]) and logs[3] is None


def test_ranks_and_half_even(spark):
    df = spark.createDataFrame([(1, v) for v in (10.0, 20.0, 20.0, 40.0)] + [(1, None), (2, 5.0)], "g int, v double")
    got = sorted((r.g, -1 if r.v is None else r.v, r.k) for r in df.withColumn("k", average_rank(F.col("v"), "g")).collect())
    assert got == [(1, -1, None), (1, 10.0, 1.0), (1, 20.0, 2.5), (1, 20.0, 2.5), (1, 40.0, 4.0), (2, 5.0, 1.0)]
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(nan_to_null(F.col("x"))).collect()] == [None, 1.0]


@pytest.mark.parametrize(("p", "df", "want"), [(0.99, 1, 6.634897), (0.99, 6, 16.811894), (0.5, 2, 1.386294), (0.95, 4, 9.487729)])
def test_chi_square_quantiles(p, df, want):
    assert abs(qchisq(p, df) - want) < 1e-5


def test_bands_by_wavelength():
    c = BandCatalog([name(660), name(680), "primalX", "other", "X482.5.Nanometers"])
    assert c.nearest(670) == name(660)  # the first one on ties
    assert c.nearest(480) == "X482.5.Nanometers" and c.nearest(5000) == name(680)
    assert BandCatalog([name(n) for n in (600, 650, 676)]).between(600, 676) == [name(650)]  # open at both ends
    assert c.find([670, 480]) == [name(660), "X482.5.Nanometers"] and c.find(wavelength_range=(650, 690)) == [name(660), name(680)]
    for wrong in ({}, {"wavelengths": 670, "wavelength_range": (1, 2)}):
        with pytest.raises(ValueError):
            c.find(**wrong)
    with pytest.raises(ValueError):
        c.between(690, 700)
    with pytest.raises(ValueError):
        BandCatalog(["a", "b"], names=["X1.Nano"])
    assert BandCatalog(["a", "b"], names=[name(400), name(500)]).nearest(490) == "b"


def test_range_means_with_and_without_gaps(spark):
    df = spectrum(spark, b610=1.0, b620=None, b630=3.0)
    c = BandCatalog.of(df)
    assert df.select(c.range_mean(600, 640), c.range_mean(600, 640, skip_null=False)).first()[:] == (2.0, None)


@pytest.mark.parametrize(("index", "want"), [("NDVI", 0.666667), ("SR", 5.0), ("RDVI", 0.516398), ("OSAVI", 0.610526), ("mod_SR", 4 / (math.sqrt(5) + 1)), ("MSAVI", (2 - math.sqrt(4 - 3.2)) / 2)])
def test_indices_by_hand(spark, index, want):
    df = spectrum(spark, b670=0.1, b800=0.5)
    assert abs(df.select(indices.index_column(df, index)).first()[0] - want) < 1e-6


def test_all_formulas_resolve(spark):
    df = spectrum(spark, **{f"b{nm}": nm / 1000 for nm in range(400, 1800, 10)})
    out = indices.with_indices(df, indices.INDICES).first()
    assert len(indices.INDICES) == 75 and all(out[n] is not None for n in indices.INDICES)
    b = lambda nm: min(range(400, 1800, 10), key=lambda w: abs(w - nm)) / 1000
    assert math.isclose(out["TCARI"], 3 * ((b(700) - b(670)) - 0.2 * (b(700) - b(550)) * (b(700) / b(670))))
    assert math.isclose(out["TCARI_1510"], 3 * ((b(700) - b(1510)) - 0.2 * (b(700) - b(550))) * (b(700) / b(1510)))
    assert math.isclose(out["NDNI"], (math.log(1 / b(1510)) - math.log(1 / b(1680))) / (math.log(1 / b(1510)) + math.log(1 / b(1680))))
    assert math.isclose(out["RNIR_CRI550"], 1 / b(515) - 1 / b(550) * b(770))


def test_zero_bands_give_infinities(spark):
    df = spectrum(spark, b670=0.0, b800=0.5)
    assert df.select(indices.index_column(df, "SR")).first()[0] == INF
    zero = spectrum(spark, b670=0.0, b800=0.0)
    assert math.isnan(zero.select(indices.index_column(zero, "NDVI")).first()[0])


def test_own_indices_and_wavelengths(spark):
    df = spectrum(spark, b670=0.1, b800=0.5)
    indices.register_index("mine", lambda b: b[800] - 2 * b[670])
    try:
        assert abs(df.select(indices.index_column(df, "mine")).first()[0] - 0.3) < 1e-12
    finally:
        del indices.INDICES["mine"]
    assert df.select(indices.index_column(df, 790)).first()[0] == 0.5
    with pytest.raises(ValueError):
        indices.index_column(df, "mine")


def test_only_bands_in_use_are_read(spark, tmp_path):
    spectrum(spark, b400=0.1, b670=0.1, b800=0.5).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    plan = df.select(indices.index_column(df, "NDVI"))._jdf.queryExecution().executedPlan().toString()
    assert name(400) not in plan.split("ReadSchema")[1]
