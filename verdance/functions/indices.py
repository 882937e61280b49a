"""Spectral indices as columns, found by name.

An index is a function of a table's bands: ``b[800]`` is the band nearest to 800 nm, ``b.mean(low, high)`` the mean of the
bands in an open range. It builds an expression and computes nothing; Catalyst reads the bands that it uses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.bands import BandCatalog
from verdance.functions.numeric import ieee_div, ieee_ln


class Term:
    """A column with IEEE arithmetic."""

    def __init__(self, column: Column):
        self.column = column

    @staticmethod
    def _of(x) -> Column:
        return x.column if isinstance(x, Term) else F.lit(float(x))

    def __add__(self, x):
        return Term(self.column + self._of(x))

    def __radd__(self, x):
        return Term(self._of(x) + self.column)

    def __sub__(self, x):
        return Term(self.column - self._of(x))

    def __rsub__(self, x):
        return Term(self._of(x) - self.column)

    def __mul__(self, x):
        return Term(self.column * self._of(x))

    def __rmul__(self, x):
        return Term(self._of(x) * self.column)

    def __truediv__(self, x):
        return Term(ieee_div(self.column, self._of(x)))

    def __rtruediv__(self, x):
        return Term(ieee_div(self._of(x), self.column))

    def __abs__(self):
        return Term(F.abs(self.column))

    def sqrt(self):
        return Term(F.sqrt(self.column))

    def ln(self):
        return Term(ieee_ln(self.column))


class Bands:
    """The bands of a table as terms."""

    def __init__(self, catalog: BandCatalog, skip_null: bool = True):
        self.catalog, self.skip_null = catalog, skip_null

    def __getitem__(self, nm: float) -> Term:
        return Term(self.catalog.column(nm))

    def mean(self, low: float, high: float) -> Term:
        return Term(self.catalog.range_mean(low, high, self.skip_null))


def _difference(b, p, q):
    """Normalised difference."""
    return (b[p] - b[q]) / (b[p] + b[q])


def _ratio(b, p, q):
    return b[p] / b[q]


def _range_difference(b, near, red):
    n, r = b.mean(*near), b.mean(*red)
    return (n - r) / (n + r)


def _mtvi2_base(b):
    """What MTVI2 and MCARI2 divide by."""
    s = 2 * b[800] + 1
    return (s * s - (6 * b[800] - 5 * b[670].sqrt()) - 0.5).sqrt()


def _osavi(b, red=670):
    return (1.16 * (b[800] - b[red])) / (b[800] + b[red] + 0.16)


def _mod_sr(b):
    r = b[800] / b[670]
    return (r - 1) / (r.sqrt() + 1)


def _msavi(b):
    s = 2 * b[800] + 1
    return (s - (s * s - 8 * (b[800] - b[670])).sqrt()) / 2


def _rdvi(b):
    return (b[800] - b[670]) / (b[800] + b[670]).sqrt()


def _tcari(b):
    return 3 * ((b[700] - b[670]) - 0.2 * (b[700] - b[550]) * (b[700] / b[670]))


def _mcari_1510(b):
    return (b[700] - b[1510]) - 0.2 * (b[700] - b[550])


def _ndni(b):
    p, q = (1 / b[1510]).ln(), (1 / b[1680]).ln()
    return (p - q) / (p + q)


def _gnyli(b):
    p, q = b[900] * b[1050], b[955] * b[1220]
    return (p * q) / (p + q)


# Names and formulas of the published indices.
INDICES: dict[str, Callable] = {
    "DMC_NDVI": lambda b: _range_difference(b, (695, 831), (600, 676)),
    "ADS100_NDVI": lambda b: _range_difference(b, (808, 882), (619, 651)),
    "DMC_G2R": lambda b: b.mean(514, 600) / b.mean(600, 676),
    "ADS100_G2R": lambda b: b.mean(525, 585) / b.mean(619, 651),
    "NDVI": lambda b: _difference(b, 800, 670),
    "RDVI": _rdvi,
    "SR": lambda b: _ratio(b, 800, 670),
    "mod_SR": _mod_sr,
    "OSAVI": _osavi,
    "MSAVI": _msavi,
    "TVI": lambda b: 0.5 * (120 * (b[750] - b[550]) - 200 * (b[670] - b[550])),
    "MTVI1": lambda b: 1.2 * (1.2 * (b[800] - b[550]) - 2.5 * (b[670] - b[550])),
    "MTVI2": lambda b: (1.2 * (1.2 * (b[800] - b[550]) - 2.5 * (b[670] - b[550]))) / _mtvi2_base(b),
    "MCARI1": lambda b: 1.2 * (2.5 * (b[800] - b[670]) - 1.3 * (b[800] - b[550])),
    "MCARI2": lambda b: (1.2 * (2.5 * (b[800] - b[670]) - 1.3 * (b[800] - b[550]))) / _mtvi2_base(b),
    "EVI": lambda b: (2.5 * (b[800] - b[670])) / (b[800] + 6 * b[670] - 7.5 * b[400] + 1),
    "LIC1": lambda b: _difference(b, 800, 680),
    "VOG1": lambda b: _ratio(b, 740, 720),
    "VOG2": lambda b: (b[734] - b[747]) / (b[715] + b[726]),
    "VOG3": lambda b: (b[734] - b[747]) / (b[715] + b[720]),
    "GM1": lambda b: _ratio(b, 750, 550),
    "GM2": lambda b: _ratio(b, 750, 700),
    "TCARI": _tcari,
    "TCARI_over_OSAVI": lambda b: _tcari(b) / _osavi(b),
    "CI": lambda b: _ratio(b, 750, 710),
    "SRPI": lambda b: _ratio(b, 430, 680),
    "NPQI": lambda b: _difference(b, 415, 735),
    "NPCI": lambda b: _difference(b, 680, 430),
    "CTRI1": lambda b: _ratio(b, 695, 420),
    "CTRI2": lambda b: _ratio(b, 695, 760),
    "datt_CabCx_c": lambda b: b[672] / (b[550] * 3 * b[708]),
    "datt_NIRCabCx_c": lambda b: b[860] / (b[550] * b[708]),
    "SIPI": lambda b: (b[800] - b[445]) / (b[800] + b[680]),
    "CRI550": lambda b: 1 / b[515] - 1 / b[550],
    "CRI700": lambda b: 1 / b[515] - 1 / b[700],
    "RNIR_CRI550": lambda b: 1 / b[515] - (1 / b[550]) * b[770],
    "RNIR_CRI700": lambda b: 1 / b[515] - (1 / b[700]) * b[770],
    "PSRI": lambda b: (b[680] - b[500]) / b[750],
    "LIC3": lambda b: _ratio(b, 440, 740),
    "RARS": lambda b: _ratio(b, 513, 746),
    "PSSRa": lambda b: _ratio(b, 800, 675),
    "PSSRb": lambda b: _ratio(b, 800, 650),
    "PSSRc": lambda b: _ratio(b, 800, 500),
    "PSNDc": lambda b: _difference(b, 800, 470),
    "PRI570": lambda b: _difference(b, 570, 531),
    "PRI515": lambda b: _difference(b, 515, 531),
    "PRI512": lambda b: _difference(b, 512, 531),
    "PRI600": lambda b: _difference(b, 600, 531),
    "PRI670": lambda b: _difference(b, 670, 531),
    "PRI670_570": lambda b: (b[570] - b[531] - b[670]) / (b[570] + b[531] + b[670]),
    "PRIn": lambda b: _difference(b, 570, 531) / abs(_rdvi(b) * b[700] / b[670]),
    "PRI_CI": lambda b: (b[680] - b[500]) / b[750],
    "CUR": lambda b: (b[675] - b[690]) / (b[683] * b[683]),
    "Redness": lambda b: _ratio(b, 700, 670),
    "Greenness": lambda b: _ratio(b, 570, 670),
    "Blue_index": lambda b: _ratio(b, 450, 490),
    "BGI1": lambda b: _ratio(b, 400, 550),
    "BGI2": lambda b: _ratio(b, 450, 550),
    "BRI1": lambda b: _ratio(b, 400, 690),
    "BRI2": lambda b: _ratio(b, 450, 690),
    "LIC2": lambda b: _ratio(b, 440, 690),
    "NDRE": lambda b: _difference(b, 790, 720),
    "DCNI": lambda b: ((b[720] - b[700]) * (b[700] - b[670])) / ((b[720] - b[670]) + 0.3),
    "MCARI_1510": lambda b: _mcari_1510(b) * (b[700] / b[1510]),
    "TCARI_1510": lambda b: 3 * _mcari_1510(b) * (b[700] / b[1510]),
    "TOCARI_1510": lambda b: (3 * _mcari_1510(b) * (b[700] / b[1510])) / _osavi(b, 1510),
    "RSI_990": lambda b: _ratio(b, 990, 720),
    "CI1": lambda b: (b[736] - b[735]) * (b[990] / b[720]),
    "CI2": lambda b: (b[736] - b[735]) * (b[900] / b[720]),
    "NDNI": _ndni,
    "GnyLi": _gnyli,
    "N1645": lambda b: _difference(b, 1645, 1715),
    "N870": lambda b: _difference(b, 870, 1450),
    "S1080": lambda b: _difference(b, 1080, 660),
    "S1260": lambda b: _difference(b, 1260, 660),
}


def register_index(name: str, formula: Callable) -> None:
    """Adds an index of one's own: a function of the bands."""
    INDICES[name] = formula


def index_column(df: DataFrame | BandCatalog, what: str | float, skip_null: bool = True) -> Column:
    """An index by its name, or the band nearest to a wavelength."""
    catalog = df if isinstance(df, BandCatalog) else BandCatalog.of(df)
    if not isinstance(what, str):
        return catalog.column(what)
    if what not in INDICES:
        raise ValueError(f"no index {what}; there are {', '.join(INDICES)}")
    return INDICES[what](Bands(catalog, skip_null)).column


def with_indices(df: DataFrame, names: Iterable[str], skip_null: bool = True) -> DataFrame:
    """``df`` with a column for each index; columns of these names that are there already are replaced."""
    catalog = BandCatalog.of(df)
    return df.withColumns({name: index_column(catalog, name, skip_null) for name in names})
