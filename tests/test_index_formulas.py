"""All spectral indices against their published formulas, written out as text and evaluated apart from the library."""

import math
import re

import pytest

from verdance.functions.indices import INDICES, index_column
from verdance.plans.index_formulas import FORMULAS
from verdance.plans.index_queries import CLOSE, FAR
from verdance.sources import fixtures

DIR = "/root/testdata/sf0.001"



def value_of(formula, bands):
    """The formula on bands {wavelength: reflectance}; nan where it has none."""
    near = lambda nm: bands[min(bands, key=lambda w: (abs(w - nm), w))]

    def mean(a, b):
        inside = [v for w, v in bands.items() if a < w < b]
        return sum(inside) / len(inside)

    sqrt = lambda x: math.sqrt(x) if x >= 0 else math.nan
    return eval(re.sub(r"R(\d+)", r"near(\1)", formula).replace("^", "**"), {"near": near, "M": mean, "sqrt": sqrt, "log": math.log, "abs": abs})


def test_every_index_has_a_formula():
    assert set(FORMULAS) == set(INDICES) and len(FORMULAS) == 75


@pytest.mark.parametrize("part", ["near", "far", "close"])
def test_indices_equal_their_formulas(spark, part):
    names = {"near": [n for n in FORMULAS if n not in FAR + CLOSE], "far": list(FAR), "close": list(CLOSE)}[part]
    pixels = fixtures.exact_bands(spark, DIR) if part == "close" else fixtures.spectra(spark, DIR, step=25 if part == "far" else 10)
    bands = [c for c in pixels.columns if c.endswith("Nanometers")]
    rows = pixels.select(*[f"`{c}`" for c in bands], *[index_column(pixels, n).alias(n) for n in names]).collect()
    assert rows
    for r in rows:
        reflectance = {int(c[1:].split(".")[0]): r[c] for c in bands}
        for n in names:
            want = value_of(FORMULAS[n], reflectance)
            assert math.isclose(r[n], want, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(want) and math.isnan(r[n])), n
