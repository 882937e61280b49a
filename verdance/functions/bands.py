"""Finding bands by wavelength in column names such as ``X700.000000.Nanometers``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.numeric import nan_to_null


class BandCatalog:
    """The bands of a table. Built from names alone, once, on the driver: Catalyst then reads only the bands in use.

    ``text`` must be in a band's name; the wavelength is the ``position``-th part of the name split at ``splitter``. Names
    whose part is no number, such as ``primalX``, are never bands. ``names`` overrides the names of the columns, in order.
    """

    def __init__(self, columns: Iterable[str], text: str = "X", splitter: str = "[X.]", position: int = 2, names: Iterable[str] | None = None):
        columns = list(columns)
        labels = list(names) if names is not None else columns
        if len(labels) != len(columns):
            raise ValueError(f"{len(labels)} band names for {len(columns)} columns")
        self.bands: list[tuple[int, str]] = []
        for column, label in zip(columns, labels, strict=True):
            parts = re.split(splitter, label)
            if text in label and len(parts) >= position and parts[position - 1].isdigit():
                self.bands.append((int(parts[position - 1]), column))

    @classmethod
    def of(cls, df: DataFrame, **options) -> BandCatalog:
        return cls(df.columns, **options)

    def nearest(self, nm: float) -> str:
        """The column of the band nearest to ``nm``, the first one of equally near ones."""
        if not self.bands:
            raise ValueError("no column name holds a wavelength")
        return min(self.bands, key=lambda band: abs(band[0] - nm))[1]

    def between(self, low: float, high: float) -> list[str]:
        """Columns of the bands strictly between the limits."""
        found = [column for w, column in self.bands if low < w < high]
        if not found:
            raise ValueError(f"no band between {low} and {high} nm")
        return found

    def find(self, wavelengths: Iterable[float] | float | None = None, wavelength_range: tuple[float, float] | None = None) -> list[str]:
        """Columns by wavelength(s) or by an open range; exactly one of the two must be given."""
        if (wavelengths is None) == (wavelength_range is None):
            raise ValueError("give either wavelengths or a range")
        if wavelength_range is not None:
            return self.between(*wavelength_range)
        return [self.nearest(nm) for nm in (wavelengths if isinstance(wavelengths, Iterable) else [wavelengths])]

    def column(self, nm: float) -> Column:
        return band(self.nearest(nm))

    def range_mean(self, low: float, high: float, skip_null: bool = True) -> Column:
        """Mean of the bands in an open range. Missing values are left out, or with ``skip_null`` false make the mean null."""
        cells = [band(c) for c in self.between(low, high)]
        if len(cells) == 1:
            return cells[0]
        if not skip_null:
            return sum(cells[1:], cells[0]) / F.lit(float(len(cells)))
        known = [nan_to_null(c) for c in cells]
        total = [F.coalesce(c, F.lit(0.0)) for c in known]
        n = [c.isNotNull().cast("double") for c in known]
        count = sum(n[1:], n[0])
        return sum(total[1:], total[0]) / F.when(count > 0, count)


def band(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")
