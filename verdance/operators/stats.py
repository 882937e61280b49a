"""Ranks, quantile strata, samples, controls and cumulative distributions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.numeric import average_rank, nan_to_null


def crown_quantiles(pixels: DataFrame, zone: str, value: str, out: str = "quantile") -> DataFrame:
    """Each cell's rank in its zone on a scale to 100: ties share their mean rank, halves round to even, nulls stay null."""
    rank = average_rank(nan_to_null(F.col(value)), zone)
    ranked = pixels.withColumn("_rank", rank)
    top = F.max("_rank").over(Window.partitionBy(zone))
    return ranked.withColumn(out, F.bround(100 * F.col("_rank") / top, 0)).drop("_rank")


def trim_to_quantiles(pixels: DataFrame, zone: str, value: str, keep: Iterable[int]) -> DataFrame:
    """Cells of the zones whose quantile is one of ``keep``: the trimmed zones as sets of cells."""
    return crown_quantiles(pixels, zone, value).filter(F.col("quantile").isin(*[float(q) for q in keep]))


def mosaic_max(cells: DataFrame, frame: DataFrame, value: str, background: float | None = 0.0) -> DataFrame:
    """One value for each cell of ``frame``: the highest of overlapping zones, and ``background`` where there is none."""
    top = cells.groupBy("cell").agg(F.max(value).alias(value))
    joined = frame.select("cell").join(top, "cell", "left")
    return joined if background is None else joined.withColumn(value, F.coalesce(F.col(value), F.lit(background)))


def order_statistics(df: DataFrame, places: dict[str, list[int]], bins: int = 1024) -> dict[str, dict[int, float]]:
    """The values at the given places (from 0) of each column's ascending order, exactly; missing values have none.

    Each round cuts the intervals that still hold a place into ``bins`` and counts them in one scan, so that no task holds
    more than the bins, whatever the number of distinct values; a bin of a single value ends the search of its places.
    """
    values = {c: nan_to_null(F.col(c).cast("double")) for c in places}
    found: dict[str, dict[int, float]] = {c: {} for c in places}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in values.items()}
    wanted = lambda c: [F.min(finite[c]), F.max(finite[c]), F.count(finite[c]), F.count(F.when(values[c] == -float("inf"), 1))]
    ends = df.agg(F.lit(0), *[F.struct(*[e.alias(n) for e, n in zip(wanted(c), ("lo", "hi", "n", "low"), strict=True)]).alias(f"e{k}") for k, c in enumerate(places)]).first()
    open_ = []  # (column, least and greatest value, values below, places inside)
    for k, (c, at) in enumerate(places.items()):
        lo, hi, n, low = ends[f"e{k}"]
        found[c] = {p: -math.inf if p < low else math.inf for p in at if not low <= p < low + n}
        open_.append((c, lo, hi, low, sorted(set(at) - set(found[c]))))
    open_ = [o for o in open_ if o[4]]
    while open_:
        todo = []
        for c, lo, hi, below, at in open_:
            if lo == hi:
                found[c].update(dict.fromkeys(at, lo))
            else:
                todo.append((c, lo, hi, below, at))
        if not todo:
            break

        def bin_of(c: str, lo: float, hi: float) -> Column:
            scale = 0.5 if math.isinf(hi - lo) else 1.0
            share = (values[c] * scale - F.lit(lo * scale)) / F.lit(hi * scale - lo * scale)
            return F.when(values[c].between(F.lit(lo), F.lit(hi)), F.least(F.floor(share * bins), F.lit(bins - 1)))

        cut = F.array(*[F.struct(F.lit(k).alias("k"), bin_of(c, lo, hi).alias("bin"), values[c].alias("v")) for k, (c, lo, hi, _, _) in enumerate(todo)])
        counts = df.select(F.explode(cut).alias("e")).select("e.*").filter(F.col("bin").isNotNull()).groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by_task: dict[int, list] = {}
        for r in counts.orderBy("k", "bin").collect():  # at most ``bins`` rows for each open interval
            by_task.setdefault(r.k, []).append(r)
        open_ = []
        for k, (c, _, _, below, at) in enumerate(todo):
            for r in by_task[k]:
                here = [p for p in at if below <= p < below + r.n]
                if here:
                    open_.append((c, r.lo, r.hi, below, here))
                below += r.n
    return found


def quantile_breaks(df: DataFrame, columns: Iterable[str], quants: Iterable[float]) -> dict[str, list[float]]:
    """Exact interpolated quantiles of each column; the outer ones are moved out by a ten-thousandth of the range."""
    columns, quants = list(columns), list(quants)
    counts = df.agg(*[F.count(nan_to_null(F.col(c).cast("double"))).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    spots = {c: [(counts[f"n{k}"] - 1) * q for q in quants] if counts[f"n{k}"] else [] for k, c in enumerate(columns)}
    at = order_statistics(df, {c: [f(x) for x in spots[c] for f in (math.floor, math.ceil)] for c in columns})
    breaks = {}
    for c in columns:
        cuts = []
        for x in spots[c]:
            low, high = at[c][math.floor(x)], at[c][math.ceil(x)]
            cuts.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
        if cuts:
            width = 0.0001 * (cuts[-1] - cuts[0])
            cuts = [cuts[0] - width, *cuts[1:-1], cuts[-1] + width]
        breaks[c] = list(dict.fromkeys(cuts))
    return breaks


def strata(df: DataFrame, numeric: Iterable[str], categories: Iterable[str] = (), quants: Iterable[float] = (0, 0.05, 0.2, 0.8, 0.95, 1), out: str = "stratum") -> DataFrame:
    """``df`` with the stratum of each row: its bins by column, written side by side.

    Bins are closed at the right and numbered from 1; a constant column has bin 0, a null no bin (the stratum is then
    null). Text columns of ``categories`` stand as they are.
    """
    breaks = quantile_breaks(df, numeric, quants)

    def bin_of(c: str) -> Column:
        cuts, x = breaks[c], nan_to_null(F.col(c).cast("double"))
        if len(cuts) < 2:
            return F.when(x.isNotNull(), F.lit("0"))
        case = reduce(lambda e, k: e.when(x <= cuts[k], F.lit(str(k))), range(2, len(cuts)), F.when(x <= cuts[1], F.lit("1")))
        return F.when(x > cuts[0], case)

    return df.withColumn(out, F.concat(*[bin_of(c) for c in breaks], *[F.col(c).cast("string") for c in categories]))


def factor_codes(df: DataFrame, column: str, most: int = 3) -> DataFrame:
    """A column of few levels as the rank of each level; more than ``most`` levels are an error."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return df.withColumn(column, F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(levels, 1) for x in (v, k)]), F.col(column)) if levels else F.lit(None).cast("int"))


def _order(seed: int | None, key: str) -> list[Column]:
    """A random order that depends on the seed and the key alone (md5 of both as text), or the key's own order."""
    return [F.col(key)] if seed is None else [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)]


def sample_rows(df: DataFrame, most: int, key: str, seed: int | None = 0) -> DataFrame:
    """``most`` rows without replacement, all if there are fewer; reruns agree. Without a seed: those with the smallest keys."""
    return df.orderBy(*_order(seed, key)).limit(most)


def sample_by_group(df: DataFrame, group: str, most: int, key: str, seed: int | None = 0) -> DataFrame:
    """At most ``most`` rows of each group."""
    order = Window.partitionBy(group).orderBy(*_order(seed, key))
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def stratified_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int | None = 0) -> DataFrame:
    """The same number of rows from each stratum (all of a smaller one), ``n`` in all after a random trim."""
    levels = df.select(stratum).distinct().count()
    return sample_rows(sample_by_group(df, stratum, -(-n // max(1, levels)), key, seed), n, key, seed)


def sample_features(df: DataFrame, n: int, key: str, ignore: str | None = None, include: str | None = None, quants: Iterable[float] = (0, 0.3, 0.45, 0.55, 0.7, 1), seed: int | None = 0) -> DataFrame:
    """A sample of objects, spread evenly over the strata of the chosen columns, with all their attributes."""
    chosen = [c for c in select_columns(df, ignore, include) if c != key]
    texts = [c for c in chosen if dict(df.dtypes)[c] == "string"]
    found = strata(df, [c for c in chosen if c not in texts], texts, quants).dropna(subset=["stratum"])
    return df.join(stratified_sample(found, "stratum", n, key, seed).select(key), key, "left_semi")


def select_columns(df: DataFrame, ignore: str | None = None, include: str | None = None) -> list[str]:
    """Column names that match ``include`` (all without it) and not ``ignore``."""
    return [c for c in df.columns if (include is None or re.search(include, c)) and not (ignore and re.search(ignore, c))]


def pair_correlations(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    """(a, b, r): what a matrix of scatter plots shows, as correlations, from one aggregation."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.round(F.corr(a, b), digits).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def subtract_control(df: DataFrame, value: str = "DN_s", out: str = "DN_c", keys: Iterable[str] = ("dfname", "band"), own: str = "ID", neighbours: str = "IDneighb_", digits: int | None = None) -> DataFrame:
    """``value`` less the mean of the neighbours' medians of the same data set and band; as many rows as before.

    Neighbours without a median count nothing; without any the result is null. The neighbour columns are dropped.
    """
    keys, near = list(keys), [c for c in df.columns if c.startswith(neighbours)]
    medians = df.groupBy(own, *keys).agg(F.median(nan_to_null(F.col(value))).alias("_median"))
    out_df = df
    for k, column in enumerate(near):
        side = medians.select(F.col(own).alias(f"_id{k}"), *[F.col(c).alias(f"_{c}{k}") for c in keys], F.col("_median").alias(f"_median{k}"))
        match = reduce(lambda a, b: a & b, [out_df[column].eqNullSafe(side[f"_id{k}"]), *[out_df[c].eqNullSafe(side[f"_{c}{k}"]) for c in keys]])
        out_df = out_df.join(side, match, "left").drop(f"_id{k}", *[f"_{c}{k}" for c in keys])
    cells = [F.col(f"_median{k}") for k in range(len(near))]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cells])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in cells])
    result = F.col(value) - total / F.when(n > 0, n)
    return out_df.withColumn(out, F.round(result, digits) if digits is not None else result).drop(*near, *[f"_median{k}" for k in range(len(near))])


def growing_efficiency(crowns: DataFrame, prob_cut: int, step: int = 2) -> DataFrame:
    """By final cut-off: crowns, growth sequences that they took, and both as cumulative shares."""
    counts = crowns.groupBy("probcut").agg(F.count("*").alias("n"), F.sum(F.expr(f"({prob_cut} - probcut) div {step} + 1")).alias("sequences"))
    upto, every = Window.orderBy("probcut"), Window.partitionBy()  # a row for each cut-off
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(every)
    return counts.select("probcut", "n", "sequences", share("n").alias("ecdf"), share("sequences").alias("ecdf_weighted"))


def prob_cut_of(path: str) -> int:
    """The two digits before the suffix of a crown file's name."""
    found = re.search(r"(\d\d)\.[A-Za-z]+$", path)
    if not found:
        raise ValueError(f"no cut-off in {path}")
    return int(found[1])
