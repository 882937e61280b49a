"""Merging attribute tables of objects."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from verdance.functions.numeric import nan_to_null


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Equi-join in which nulls match nulls; columns of both sides other than the keys must differ."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys]), how).drop(*[f"_key_{k}" for k in keys])


def merge_by_attributes(tables: list[DataFrame], keys: Iterable[str] = ("primalX", "primalY"), drop: str | None = None) -> DataFrame:
    """Inner join of tables on the keys; other columns of the k-th one get the prefix ``i<k>``.

    ``drop``: columns that match this regular expression are left out; one that nothing matches drops nothing.
    """
    keys = list(keys)
    prefixed = [t.withColumnsRenamed({c: f"i{k}{c}" for c in t.columns if c not in keys}) for k, t in enumerate(tables, 1)]
    merged = reduce(lambda a, b: null_safe_join(a, b, keys, "inner"), prefixed)
    return merged.drop(*[c for c in merged.columns if drop and c not in keys and re.search(drop, c)])


def image_keys(names: Iterable[str], spark) -> DataFrame:
    """Which prefix of merge_by_attributes stands for which image."""
    return spark.createDataFrame([(f"i{k}", n) for k, n in enumerate(names, 1)], "prefix string, image string")


def attach(objects: DataFrame, values: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Left join on the keys; of columns that both have, the objects' value comes first and fills up from the other."""
    keys = list(keys)
    shared = [c for c in values.columns if c in objects.columns and c not in keys]
    joined = null_safe_join(objects, values.withColumnsRenamed({c: f"_right_{c}" for c in shared}), keys)
    return joined.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"`_right_{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in [*objects.columns, *[v for v in values.columns if v not in objects.columns]]])


def select_flights(objects: DataFrame, flight: str = "ALL", sensor: str = "ALL") -> DataFrame:
    """Objects of a flight and a sensor, where the table has both columns."""
    if {"flight_name", "sensor"} <= set(objects.columns):
        for column, wanted in (("flight_name", flight), ("sensor", sensor)):
            if wanted != "ALL":
                objects = objects.filter(F.col(column).isin(*([wanted] if isinstance(wanted, str) else wanted)))
    return objects


def union_named(tables: dict[str, DataFrame | None], name: str = "dfname") -> DataFrame:
    """Tables under each other, matched by column names, with a column for the table's name; missing tables are skipped."""
    parts = [t.withColumn(name, F.lit(k)) for k, t in tables.items() if t is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_all_null(df: DataFrame, group: str, values: Iterable[str]) -> DataFrame:
    """Rows of the groups in which at least one value is present; NaN is missing, as null is."""
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, FloatType | DoubleType)}
    seen = [F.max((nan_to_null(F.col(v)) if v in numbers else F.col(v)).isNotNull().cast("int")) for v in values]
    some = df.groupBy(group).agg(F.greatest(*seen, F.lit(0)).alias("_some")).filter("_some = 1").select(group)
    return df.join(some, group, "left_semi")
