"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math

import pytest

from verdance import catalogue
from verdance.plans.index_queries import CLOSE, FAR

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
# all_indices covers the others in one scan
CHECKED = [n for n in SQL if not n.startswith("idx_") or n[4:] in FAR + CLOSE + ("NDVI",)]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in row)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(key(r[c] for c in sorted(names)) for r in df.collect()) == sorted(key(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 130


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["fid", "b800", "b670", "ndvi"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_neighbours8_keeps_every_pair(spark):
    from verdance.plans import space_queries

    pairs = space_queries.neighbours8(spark, "/root/testdata/sf0.001")
    assert pairs.columns == ["cell", "neighbour", "v"] and pairs.count() == 48 * 48 * 8 + 4 * 48 * 5 + 4 * 3
