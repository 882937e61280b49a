"""Maximum-entropy densities and Euclidean distances, against their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import distance, maxent


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    pres = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) > 1.2).astype(int)
    rows = [(i, *map(float, v), int(p)) for i, (v, p) in enumerate(zip(x, pres, strict=True))]
    odd = [(1000, None, 1.0, 1.0, 1), (1001, float("nan"), 0.0, 0.0, 0), (1002, 0.0, float("inf"), 0.0, 1)]
    return spark.createDataFrame(rows + odd, "id int, a double, b double, `c.d` double, pres int").repartition(3), x, pres


def test_density_meets_every_condition(spark):
    df, x, pres = frame(spark)
    model = maxent.fit(df, ["a", "b", "c.d"], pairs=maxent.all_pairs(3))
    got = {r.id: r for r in model.predict(model.predict(df), "s", "logistic").collect()}
    raw = np.array([got[i].p for i in range(len(x))])
    assert abs(raw.sum() - 1) < 1e-9 and all(got[i].p is None for i in (1000, 1001, 1002))
    f = model.features(x)
    assert np.allclose(f[pres == 1].mean(axis=0), model.presence_mean)
    gap = model.presence_mean - raw @ f
    zero = model.weights == 0
    assert (np.abs(gap[zero]) <= model.bound[zero] + 1e-6).all() and np.abs(gap[~zero] - model.bound[~zero] * np.sign(model.weights[~zero])).max() < 1e-6
    assert zero.any() and (~zero).any() and len(model.features.names) == f.shape[1] == 3 + 3 + 9 + 3
    assert abs(model.entropy + (raw * np.log(raw)).sum()) < 1e-9
    s = np.array([got[i].s for i in range(len(x))])
    assert np.allclose(s, raw * math.exp(model.entropy) / (1 + raw * math.exp(model.entropy)))
    means = {r.feature: r.expected for r in maxent.feature_means(model.predict(df), model).collect()}
    assert np.allclose([means[n] for n in model.features.names], raw @ f)
    assert {r.p for r in model.predict(df.filter("id = 1000"), byte=True, kind="logistic").collect()} == {None}


def test_density_without_rows_or_presences_is_refused(spark):
    df, _, _ = frame(spark, 50)
    with pytest.raises(ValueError, match="no row"):
        maxent.fit(df.limit(0), ["a"])
    with pytest.raises(ValueError, match="no presence"):
        maxent.fit(df.filter("pres = 0"), ["a"])


@pytest.mark.parametrize("reach", [3.0, 17.5, 200.0])
def test_distances_over_bands_and_blocks(spark, monkeypatch, reach):
    monkeypatch.setattr(distance, "BAND", 8)
    monkeypatch.setattr(distance, "SPAN", 5)
    rng = np.random.default_rng(1)
    p = rng.uniform(size=(30, 40)) < 0.02
    cells = [(i - 7, j, bool(p[i, j]) if (i + j) % 11 else None) for i in range(30) for j in range(40)]
    df = spark.createDataFrame(cells, "row int, col int, p boolean").repartition(4)
    there = [(i, j) for i, j, q in cells if q]
    got = {(r.row, r.col): r.d for r in distance.distance_to(df, "p", reach, 2.0, 3.0, out="d").collect()}
    assert len(got) == len(cells)
    for i, j, _ in cells:
        want = min((math.hypot((i - a) * 3.0, (j - b) * 2.0) for a, b in there), default=math.inf)
        assert (got[i, j] is None) if want > reach else abs(got[i, j] - want) < 1e-9


def test_buffers_without_presence(spark):
    df = spark.range(9).select((F.col("id") % 3).alias("row"), F.expr("id div 3").alias("col"), F.lit(False).alias("p"))
    assert {r.near for r in distance.buffer(df, "p", 5.0, 1.0).collect()} == {False}
    one = df.withColumn("p", (F.col("row") == 1) & (F.col("col") == 1))
    assert distance.buffer(one, "p", 0.5, 1.0).filter("near").count() == 1 and distance.buffer(one, "p", 1.0, 1.0).filter("near").count() == 5
