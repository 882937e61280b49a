"""Watershed of a whole image, the same however it is cut to blocks: steepest ascent, then a tree of saddles cut at a tolerance.

Every cell follows its highest neighbour until a peak is reached; the cells of one peak are a basin. Basins that touch have a
saddle, the highest of the lower cells of touching pairs. Saddles are taken from high to low, and each joins the two segments
that meet there if the lower of their peaks rises less than the tolerance above it. Equal heights go by cell, equal saddles
by the peaks of their basins, so that the result is one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.operators.focal import focal_mean
from verdance.operators.graph import stored
from verdance.operators.segment import mask_below

#: What a block tells: its cells with the cell they lead to, that of the cells at its border, saddles inside and across the
#: border, heights of peaks, and the smallest cell that leads to each end.
CELL, BORDER, INNER, ACROSS, PEAK, LEAST = range(6)
_TOLD = "kind int, row long, col long, a long, b long, s double"


def _block(cell: np.ndarray, height: np.ndarray, reach: int) -> list[tuple]:
    """Arrays (kind, row, col, a, b, s) told by one block whose arrays have a margin of ``reach`` cells; missing heights are NaN."""
    h, w = height.shape
    here = np.isfinite(height)
    rank = np.full(h * w, h * w)
    high_first = np.lexsort((cell.ravel(), -height.ravel()))[: here.sum()]
    rank[high_first] = np.arange(len(high_first))
    rank = rank.reshape(h, w)
    own = np.zeros((h, w), bool)
    own[reach : h - reach, reach : w - reach] = True
    inside = own & here
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) != (0, 0)]

    def moved(grid: np.ndarray, i: int, j: int) -> np.ndarray:
        return grid[reach + i : h - reach + i, reach + j : w - reach + j]

    best = moved(rank, 0, 0)
    for i, j in steps:
        best = np.minimum(best, moved(rank, i, j))
    to = np.arange(h * w).reshape(h, w)
    lead = np.append(high_first, 0)[np.minimum(best, len(high_first))]
    to[reach : h - reach, reach : w - reach] = np.where(moved(here, 0, 0), lead, moved(to, 0, 0))
    to = to.ravel()
    while not np.array_equal(to[to], to):
        to = to[to]
    ids, heights, at = cell.ravel(), height.ravel(), np.flatnonzero(inside)
    end = to[at]
    told = [(CELL, at // w, at % w, ids[at], ids[end], None)]
    rim = at[(at // w < 2 * reach) | (at // w >= h - 2 * reach) | (at % w < 2 * reach) | (at % w >= w - 2 * reach)]
    told.append((BORDER, None, None, ids[rim], ids[to[rim]], None))
    pairs = []
    for i, j in steps:
        other = at + i * w + j
        other, mine = other[here.ravel()[other]], at[here.ravel()[other]]
        known = own.ravel()[other]
        # a pair of own cells is met from both sides, one across the border is told by the side with the smaller cell
        for kind, keep in ((INNER, known & (to[mine] < to[other])), (ACROSS, ~known & (ids[mine] < ids[other]))):
            x, y = mine[keep], other[keep]
            pairs.append(pd.DataFrame({"kind": kind, "a": ids[to[x]], "b": ids[to[y]] if kind == INNER else ids[y], "s": np.minimum(heights[x], heights[y])}))
    met = pd.concat(pairs).groupby(["kind", "a", "b"], as_index=False)["s"].max()
    told += [(kind, None, None, m["a"].to_numpy(), m["b"].to_numpy(), m["s"].to_numpy()) for kind, m in met.groupby("kind")]
    tops = at[end == at]
    told.append((PEAK, None, None, ids[tops], None, heights[tops]))
    low = pd.Series(ids[at]).groupby(ids[end]).min()
    told.append((LEAST, None, None, low.index.to_numpy(), low.to_numpy(), None))
    return told


def _told(cells: DataFrame, value: str, reach: int, side: int) -> DataFrame:
    """What all blocks of ``side`` cells tell; a cell goes to its block and to those in whose margin it lies."""
    def near(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))

    v = F.col(f"`{value}`").cast("double")
    narrow = cells.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "cell")], v.alias("v")).dropna()
    spread = narrow.withColumn("bi", near("row")).withColumn("bj", near("col"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left, span = key[0] * side - reach, key[1] * side - reach, side + 2 * reach
        i, j = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        height = np.full((span, span), -np.inf)
        cell = np.zeros((span, span), np.int64)
        cell[i, j] = pdf["cell"]
        np.maximum.at(height, (i, j), np.where(np.isfinite(pdf["v"]), pdf["v"], -np.inf))
        height[np.isneginf(height)] = np.nan
        whole = lambda x, n: pd.array([pd.NA] * n if x is None else x, dtype="Int64")
        parts = []
        for k, r, c, a, b, s in _block(cell, height, reach):
            n = len(a)
            parts.append(pd.DataFrame({"kind": np.full(n, k), "row": whole(r, n), "col": whole(c, n), "a": whole(a, n), "b": whole(b, n), "s": np.full(n, np.nan) if s is None else s}))
        out = pd.concat(parts)
        return out.assign(row=out["row"] + top, col=out["col"] + left)

    return spread.groupBy("bi", "bj").applyInPandas(one, _TOLD)


def roots(links: DataFrame, label: str = "roots") -> DataFrame:
    """(u, v, p) of a forest of links, with v and its p the end of u's chain: pointer doubling, as many rounds as the longest has bits."""
    at = stored(links.select("u", "v", "p", F.lit(True).alias("more")), label)
    while not at.filter("more").isEmpty():
        on = at.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("p").alias("q"))
        at = stored(at.join(on, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.when(F.col("w").isNull(), F.col("p")).otherwise(F.col("q")).alias("p"), F.col("w").isNotNull().alias("more")), label)
    return at.select("u", "v", "p")


def _renamed(edges: DataFrame, found: DataFrame, ends: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Both ends of ``edges`` replaced by their roots, and the heights p_a and p_b by those of the roots where there are such columns."""
    for c in ends:
        edges = edges.join(found.select(F.col("u").alias(c), F.col("v").alias("_v"), F.col("p").alias("_p")), c, "left")
        if f"p_{c}" in edges.columns:
            edges = edges.withColumn(f"p_{c}", F.coalesce("_p", f"p_{c}"))
        edges = edges.withColumn(c, F.coalesce("_v", c)).drop("_v", "_p")
    return edges


def merged_basins(edges: DataFrame, tolerance: float) -> DataFrame:
    """(u, v, p): the peak u of each basin that is taken over, and the peak v, as high as p, of the segment that has it.

    ``edges`` (a, b, p_a, p_b, s): the saddle s of two basins by their peaks' cells and heights; one row a pair, a < b.

    A saddle that both peaks overtop by the tolerance joins nothing, then or later, as peaks only grow; it goes. Of those
    left, a segment's highest saddle is the first at which it meets another: if that one's peak is higher, it takes the
    segment over, and no saddle above is touched. So all such takings of a round are done at once, and when a round finds none,
    none is left. The rounds are not limited: each joins at least the highest saddle left.
    """
    lowest = F.least("p_a", "p_b")
    at = stored(edges.filter(lowest - F.col("s") < tolerance).select("a", "b", "p_a", "p_b", "s", (-F.col("a")).alias("k1"), (-F.col("b")).alias("k2")), "saddles")
    taken = []
    while True:
        back = at.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p_b").alias("p_a"), F.col("p_a").alias("p_b"), "s", "k1", "k2")
        first = at.unionByName(back).groupBy("a").agg(F.max(F.struct("s", "k1", "k2", "b", "p_a", "p_b")).alias("t")).select("a", "t.*")
        higher = (F.col("p_b") > F.col("p_a")) | ((F.col("p_b") == F.col("p_a")) & (F.col("b") < F.col("a")))
        taken.append(stored(first.filter(higher).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("p_b").alias("p")), "saddles-taken"))
        if taken[-1].isEmpty():
            return roots(reduce(DataFrame.unionByName, taken))
        new = _renamed(at, roots(taken[-1])).filter(F.col("a") != F.col("b")).filter(lowest - F.col("s") < tolerance)
        swap = F.col("a") > F.col("b")
        pair = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("p_b")).otherwise(F.col("p_a")).alias("p_a"), F.when(swap, F.col("p_a")).otherwise(F.col("p_b")).alias("p_b"), "s", "k1", "k2")
        at = stored(pair.groupBy("a", "b").agg(F.max(F.struct("s", "k1", "k2", "p_a", "p_b")).alias("t")).select("a", "b", "t.*"), "saddles")


def segments(cells: DataFrame, value: str, tolerance: float, reach: int = 1, side: int = 256) -> DataFrame:
    """(row, col, cell, label) of the cells that have a finite ``value``; a label is the smallest cell of its segment.

    ``cells`` (row, col, cell, value), a cell number a place; of repeated places the highest value counts, once. Rows with a
    null place or cell are left out; other columns are not looked at. Blocks of ``side`` cells bound a task's memory and
    change nothing else: basins are followed from block to block by pointer doubling over border cells, the saddles of two blocks meet by
    an equi-join over border cells, and the merging sees basins only.
    """
    if side < 2 * reach:
        raise ValueError("a block must be twice as wide as the reach")
    told = stored(_told(cells, value, reach, side), "basins")
    kind = lambda k: told.filter(F.col("kind") == k)
    onward = roots(kind(BORDER).filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(None).cast("double").alias("p")))
    met = _renamed(kind(INNER).select("a", "b", "s").unionByName(kind(ACROSS).select("a", "b", "s")), onward)
    pairs = met.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))
    for c in ("a", "b"):
        pairs = pairs.join(kind(PEAK).select(F.col("a").alias(c), F.col("s").alias(f"p_{c}")), c)
    found = merged_basins(pairs, tolerance)
    ends = kind(LEAST).groupBy("a").agg(F.min("b").alias("low")).withColumn("end", F.col("a"))
    named = stored(_renamed(_renamed(ends, onward, ("end",)), found, ("end",)), "basins-named")
    labels = named.join(named.groupBy("end").agg(F.min("low").alias("label")), "end").select(F.col("a").alias("b"), "label")
    return kind(CELL).select("row", "col", F.col("a").alias("cell"), "b").join(labels, "b").drop("b")


def crowns_of_image(cells: DataFrame, value: str, tolerance: float = 0.008, reach: int = 1, conditions: list[tuple[str, float]] | None = None, smooth: bool = True, side: int = 256) -> DataFrame:
    """Mask, 3 x 3 mean and ``segments``, in one."""
    masked = mask_below(cells, value, conditions or [])
    if smooth:
        masked = focal_mean(masked, value, "_smooth").drop(value).withColumnRenamed("_smooth", value)
    return segments(masked, value, tolerance, reach, side)
