"""User aggregates against groups worked out by hand."""

import math
from collections import Counter

import numpy as np

from verdance.operators.aggregates import Aggregate, BinnedQuantile, Entropy, Mode, aggregate_by, focal_aggregate


class Range(Aggregate):
    """Largest less smallest value, and a text as result."""

    returns = "string"

    def init(self):
        return None

    def update(self, state, values):
        return self.merge(state, (values.min(), values.max()))

    def merge(self, state, other):
        return other if state is None else state if other is None else (min(state[0], other[0]), max(state[1], other[1]))

    def finish(self, state):
        return "none" if state is None else str(state[1] - state[0])


def test_zones_hot_and_small_null_and_empty(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.6 else f"z{rng.integers(40)}", int(rng.integers(3)), float(rng.integers(0, 9))) for _ in range(3000)]
    rows += [(None, 1, 2.0), (None, 1, 2.0), (None, None, 5.0), ("blank", 0, None), ("blank", 0, float("nan")), ("blank", 1, float("inf"))]
    df = spark.createDataFrame(rows, "zone string, part int, v double").selectExpr("*", "1 as state", "2 as value").repartition(7)
    groups = {}
    for z, p, v in rows:
        groups.setdefault((z, p), []).extend([] if v is None or math.isnan(v) else [v])

    def found(aggregate, table=df, keys=("zone", "part")):
        out = aggregate_by(table, keys, "v", aggregate, "x").collect()
        assert len(out) == len({tuple(r)[:-1] for r in out})
        return {tuple(r)[:-1]: r.x for r in out}

    mode = lambda vs: min(vs, key=lambda v: (-Counter(vs)[v], v)) if vs else None
    assert found(Mode()) == {k: mode(vs) for k, vs in groups.items()}
    assert found(Range()) == {k: str(max(vs) - min(vs)) if vs else "none" for k, vs in groups.items()}
    got = found(Entropy())
    for k, vs in groups.items():
        want = -sum(n / len(vs) * math.log(n / len(vs)) for n in Counter(vs).values()) if vs else None
        assert got[k] == want or abs(got[k] - want) < 1e-12
    finite = {k: vs for k, vs in groups.items() if k != ("blank", 1)}
    got = found(BinnedQuantile(0.3, 2.0))
    assert all(got[k] == (math.floor(sorted(vs)[(3 * len(vs) + 9) // 10 - 1] / 2) * 2.0 if vs else None) for k, vs in finite.items())
    assert found(Mode(), df.limit(0)) == {}


def test_states_handed_on_early_and_keys_that_are_nan(spark):
    rows = [(float("nan") if k % 3 == 0 else -0.0 if k % 3 == 1 else 0.0, float(k % 5)) for k in range(90)]
    df = spark.createDataFrame(rows, "zone double, v double").repartition(5)
    out = aggregate_by(df, ["zone"], "v", Mode(), "x", at_once=1).collect()
    assert len(out) == 2 and {r.x for r in out} == {0.0}


def test_focal_mode(spark):
    image = np.random.default_rng(2).integers(0, 4, (6, 7)).astype(float)
    cells = spark.createDataFrame([(i, j, float(image[i, j])) for i in range(6) for j in range(7)], "row long, col long, v double")
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for r in focal_aggregate(cells, "v", square, Mode(), "m").collect():
        near = image[max(0, r.row - 1) : r.row + 2, max(0, r.col - 1) : r.col + 2].ravel().tolist()
        assert r.m == min(near, key=lambda v: (-near.count(v), v))
