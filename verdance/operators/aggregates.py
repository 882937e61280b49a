"""User aggregates by zone or by focal frame: a class with init, update, merge and finish, combined on each task before the shuffle."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from verdance.functions.numeric import nan_to_null
from verdance.operators.focal import _shifted

#: Ways over which the states of one zone are merged first, so that no task takes those of all others.
WAYS = 64


class Aggregate:
    """What a user writes. States are pickled; ``returns`` is the result's type as DDL.

    ``update`` takes the values of a batch that belong to one zone as doubles, missing ones left out; ``merge`` must not care
    for the order of states, and ``finish`` of ``init`` is what a zone without values gets.
    """

    returns = "double"

    def init(self) -> object:
        raise NotImplementedError

    def update(self, state: object, values: np.ndarray) -> object:
        raise NotImplementedError

    def merge(self, state: object, other: object) -> object:
        raise NotImplementedError

    def finish(self, state: object) -> object:
        raise NotImplementedError


class Counted(Aggregate):
    """State: different values in order, and how often each occurs; it grows with the number of different values."""

    def init(self) -> tuple[np.ndarray, np.ndarray]:
        return np.empty(0), np.empty(0, np.int64)

    def update(self, state: tuple, values: np.ndarray) -> tuple:
        return self.merge(state, np.unique(values, return_counts=True))

    def merge(self, state: tuple, other: tuple) -> tuple:
        values, at = np.unique(np.concatenate([state[0], other[0]]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate([state[1], other[1]]))
        return values, counts


class Mode(Counted):
    """The most frequent value, of equally frequent ones the smallest; null without values."""

    def finish(self, state: tuple) -> float | None:
        return float(state[0][np.argmax(state[1])]) if len(state[0]) else None


class Entropy(Counted):
    """Shannon's entropy of the values' shares, in nats; null without values."""

    def finish(self, state: tuple) -> float | None:
        share = state[1] / state[1].sum() if len(state[1]) else None
        return None if share is None else float(-(share * np.log(share)).sum())


class BinnedQuantile(Counted):
    """Lower end of the bin that holds the value at place ceil(q * n), from 1: below the quantile by less than ``width``."""

    def __init__(self, q: float, width: float):
        self.q, self.width = q, width

    def update(self, state: tuple, values: np.ndarray) -> tuple:
        return super().update(state, np.floor(values / self.width))

    def finish(self, state: tuple) -> float | None:
        if not len(state[0]):
            return None
        place = max(1, math.ceil(Fraction(str(self.q)) * int(state[1].sum())))
        return float(state[0][np.searchsorted(np.cumsum(state[1]), place)] * self.width)


def _same(key: tuple) -> tuple:
    """A key that equals itself: NaN is one value, as in a grouping."""
    return tuple("NaN" if isinstance(x, float) and x != x else 0.0 if x == 0 and isinstance(x, float) else x for x in key)


def _row(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _partial(keys: list[str], aggregate: Aggregate, schema: pa.Schema, at_once: int) -> Callable:
    """Batches of (keys, value) to (keys, state), one state a zone and task while the zones are few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.zeros(batch.num_rows, np.int64)
            for k in range(len(keys)):
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                number = np.unique(number * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            for at in np.split(order, starts[1:]):
                key = tuple(batch.column(k)[int(at[0])].as_py() for k in range(len(keys)))
                mine = held.setdefault(_same(key), [key, aggregate.init()])
                given = values[at]
                given = given[~np.isnan(given)]
                if len(given):
                    mine[1] = aggregate.update(mine[1], given)
            if len(held) > at_once:
                yield _row(schema, [(*key, pickle.dumps(state)) for key, state in held.values()])
                held = {}
        if held:
            yield _row(schema, [(*key, pickle.dumps(state)) for key, state in held.values()])

    return run


def _merging(n_keys: int, aggregate: Aggregate, last: bool, schema: pa.Schema) -> Callable:
    """Batches of (keys, state) in order of keys to one row a key: its state, or the result if ``last``. One state is held at a time."""
    def told(key: tuple, state: object) -> tuple:
        return (*key, aggregate.finish(state) if last else pickle.dumps(state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(n_keys + 1)]
            for *mine, packed in zip(*columns, strict=True):
                new = pickle.loads(packed)
                if key is not None and _same(tuple(mine)) == _same(key):
                    state = aggregate.merge(state, new)
                    continue
                if key is not None:
                    out.append(told(key, state))
                key, state = tuple(mine), new
            if out:
                yield _row(schema, out)
        if key is not None:
            yield _row(schema, [told(key, state)])

    return run


def aggregate_by(df: DataFrame, keys: Iterable[str], value: str, aggregate: Aggregate, out: str, at_once: int = 4096) -> DataFrame:
    """(keys, out): ``aggregate`` of ``value`` for each combination of ``keys``, among them nulls, of an empty table none.

    Tasks hand on one state a zone, so a zone with a third of all rows is as many small rows as there are tasks; its
    states are merged over ``WAYS`` ways, then once more. A task hands its states on when it holds those of more than
    ``at_once`` zones after a batch; later ones of the same zones merge behind the shuffle. ``df`` may have any other columns; they are not read.
    """
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    carried = StructType([*fields, StructField("state", BinaryType())])
    named = df.select(*[F.col(f"`{k}`") for k in keys], nan_to_null(F.col(f"`{value}`").cast("double")).alias("value"))
    states = named.mapInArrow(_partial(keys, aggregate, to_arrow_schema(carried), at_once), carried)
    result = StructType([*fields, StructField(out, StructType.fromDDL(f"x {aggregate.returns}")["x"].dataType)])
    by = [F.col(f"`{k}`") for k in keys]
    dealt = states.repartition(*by, F.pmod(F.spark_partition_id(), F.lit(WAYS))).sortWithinPartitions(*by)
    fewer = dealt.mapInArrow(_merging(len(keys), aggregate, False, to_arrow_schema(carried)), carried)
    return fewer.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merging(len(keys), aggregate, True, to_arrow_schema(result)), result)


def focal_aggregate(cells: DataFrame, value: str, offsets: list[tuple[int, int]], aggregate: Aggregate, out: str) -> DataFrame:
    """``cells`` (row, col, ...) with the aggregate of the values at ``offsets`` (row, col) around each; only frames of few cells."""
    moved = _shifted(cells.select("row", "col", F.col(f"`{value}`").alias("v")), offsets)
    return cells.join(aggregate_by(moved, ["row", "col"], "v", aggregate, out), ["row", "col"], "left")
