"""The fixtures as SQL, for the queries' counterparts."""

from __future__ import annotations


class SqlBands:
    """Bands of the spectra fixtures as SQL: element j of the embedding stands for a wavelength."""

    def __init__(self, wavelengths: list[int], cell: str = "(CAST(embedding[{j}] AS DOUBLE) + 0.6::DOUBLE)"):
        self.wavelengths, self.cell = wavelengths, cell

    def _at(self, j: int) -> str:
        return self.cell.format(j=j + 1, nm=self.wavelengths[j])

    def __getitem__(self, nm: float) -> str:
        return self._at(min(range(len(self.wavelengths)), key=lambda j: abs(self.wavelengths[j] - nm)))

    def mean(self, low: float, high: float) -> str:
        cells = [self._at(j) for j, w in enumerate(self.wavelengths) if low < w < high]
        return f"({' + '.join(cells)}) / {float(len(cells))!r}::DOUBLE"


VNIR = [400 + 10 * j for j in range(64)]
SWIR = [400 + 25 * j for j in range(64)]
EXACT = [720, 735, 736, 900, 990]


#: CTE bodies of the fixtures.
GRID = """grid AS (
  SELECT r.i AS row, c.i AS col, r.i * 50 + c.i + 1 AS cell, (c.i + 0.5::DOUBLE) * 20 AS x, 1000 - (r.i + 0.5::DOUBLE) * 20 AS y, coalesce(n.v, 0) AS v
  FROM range(50) r(i) CROSS JOIN range(50) c(i)
  LEFT JOIN (SELECT l_suppkey % 50 AS row, l_partkey % 50 AS col, count(*) AS v FROM lineitem GROUP BY 1, 2) n ON n.row = r.i AND n.col = c.i)"""
BINARY = GRID + """,
cells AS (SELECT *, v > (SELECT quantile_cont(v, 0.7) FROM grid) AS presence FROM grid)"""
POINTS_A = """a AS (SELECT CAST(c_custkey AS BIGINT) AS fid, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y, c_mktsegment AS class FROM customer)"""
POINTS_B = """b AS (SELECT CAST(s_suppkey AS BIGINT) AS fid, CAST((s_suppkey * 53 + 7) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 29 + 3) % 1000 AS DOUBLE) AS y FROM supplier)"""
DN = """dn AS (
  SELECT event_id, CAST(user_id % 20 AS BIGINT) AS ID, event_type AS dfname, CAST(hour(ts) % 4 AS BIGINT) AS band, CAST(value AS DOUBLE) AS DN_s,
         CAST((user_id % 20 + 1) % 20 AS BIGINT) AS IDneighb_1, CAST((user_id % 20 + 2) % 20 AS BIGINT) AS IDneighb_2 FROM events)"""
PIXELS = """px AS (
  SELECT vec_id AS pixel_id, label AS fid, vec_id % 25 AS col, vec_id // 25 AS row, embedding FROM embeddings)"""


def vnir(nm: float) -> str:
    return SqlBands(VNIR)[nm]
