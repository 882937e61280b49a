"""One query per spectral index, one for all of them, and band selection."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.bands import BandCatalog
from verdance.functions.indices import INDICES, index_column
from verdance.plans.index_formulas import index_sql
from verdance.plans.sql import EXACT, SWIR, VNIR, SqlBands
from verdance.sources import fixtures

#: The index's bands are reached by the coarser fixture up to 1975 nm, or need bands that lie a nanometre apart.
FAR = ("NDRE", "DCNI", "MCARI_1510", "TCARI_1510", "TOCARI_1510", "RSI_990", "NDNI", "GnyLi", "N1645", "N870", "S1080", "S1260")
CLOSE = ("CI1", "CI2")
#: Logarithms differ in the last bit between engines.
ROUNDED = ("NDNI",)


def _pixels(spark, sf_dir: str, name: str) -> tuple[DataFrame, list[int]]:
    if name in CLOSE:
        return fixtures.exact_bands(spark, sf_dir), EXACT
    if name in FAR:
        return fixtures.spectra(spark, sf_dir, step=25), SWIR
    return fixtures.spectra(spark, sf_dir), VNIR


def _index(spark, sf_dir: str, name: str) -> DataFrame:
    pixels, _ = _pixels(spark, sf_dir, name)
    value = index_column(pixels, name)
    return pixels.select("pixel_id", (F.round(value, 9) if name in ROUNDED else value).alias("value"))


def _wavelengths(name: str) -> list[int]:
    return EXACT if name in CLOSE else SWIR if name in FAR else VNIR


def band_nearest(spark, sf_dir: str) -> DataFrame:
    """Bands by wavelength, the first one on ties."""
    pixels = fixtures.spectra(spark, sf_dir)
    return pixels.select("pixel_id", *[index_column(pixels, nm).alias(f"b{nm}") for nm in (415, 670, 955, 2000)])


def band_range_mean(spark, sf_dir: str) -> DataFrame:
    pixels = fixtures.spectra(spark, sf_dir)
    return pixels.select("pixel_id", BandCatalog.of(pixels).range_mean(600, 676).alias("red"), BandCatalog.of(pixels).range_mean(695, 831).alias("nir"))


def all_indices(spark, sf_dir: str) -> DataFrame:
    """Every index that the near bands allow, in one scan."""
    pixels = fixtures.spectra(spark, sf_dir)
    names = [n for n in INDICES if n not in FAR + CLOSE]
    return pixels.select("pixel_id", *[index_column(pixels, n).alias(n) for n in names])


QUERIES = {f"idx_{name}": partial(_index, name=name) for name in INDICES}
ORACLES = {}
for _name in INDICES:
    _sql = index_sql(_name, SqlBands(_wavelengths(_name)))
    ORACLES[f"idx_{_name}"] = f"SELECT vec_id AS pixel_id, {f'round({_sql}, 9)' if _name in ROUNDED else _sql} AS value FROM embeddings"

QUERIES |= {"band_nearest": band_nearest, "band_range_mean": band_range_mean, "all_indices": all_indices}
_b = SqlBands(VNIR)
ORACLES |= {
    "band_nearest": "SELECT vec_id AS pixel_id, " + ", ".join(f"{_b[nm]} AS b{nm}" for nm in (415, 670, 955, 2000)) + " FROM embeddings",
    "band_range_mean": f"SELECT vec_id AS pixel_id, {_b.mean(600, 676)} AS red, {_b.mean(695, 831)} AS nir FROM embeddings",
    "all_indices": "SELECT vec_id AS pixel_id, " + ", ".join(f'{index_sql(n, _b)} AS "{n}"' for n in INDICES if n not in FAR + CLOSE) + " FROM embeddings",
}
