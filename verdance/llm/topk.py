"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components are floored to integers. The index holds blocks of vectors; a block's postings (vector, dimension, value) are
ordered by the size of their value, quantised to powers of two, in segments. A block of queries takes a block's segments
in descending impact and adds what they score. After a segment, the norms of what is still missing of each vector give
bounds on its final score. A query stops only when so few vectors can still be among its best that each is scored
exactly; so the result is the one of a full search. A few queries try the segments one by one; the others take those
up to the first after which one of these could stop at once, and then the rest.

Groups of index blocks meet groups of query blocks by an equi-join on their numbers; a task goes through its index blocks
one by one with the bar of those before, and of each meeting of groups only the best k are kept. Queries are a stated part
of the rows; every other row is a candidate. The work is queries times rows: exact search has no way round it.

Rows are told apart by a number of their own, not by their id: of rows with one id each is a candidate for the others
and, as a query, has its own k rows.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id
(the result could not name them); vectors meet only those of their own length; ties go to the smaller id; a query with
fewer than k candidates gets them all; components or scores that 63 bits might not hold (length * largest component squared)
are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import stored, table

SCALE = 256
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024
#: A query stops when at most this many vectors of a block can be among its best.
MEMBERS = 32
#: Queries that are tried first for a proof, before the whole block is.
PROBE = 16
#: Rows of a block that give a first bound on a query's k-th best.
FIRST = 512
#: Components of one side that a task takes, and groups of the index that there are for as long as these allow it.
GROUP_BYTES, GROUPS = 64 << 20, 96


def usable(vector: str | Column) -> Column:
    """A vector with at least one component, all of them finite; false for null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def floored(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, q): integer components of the usable vectors, written so that a row's number stays the same.

    A score is at most length * largest component squared in size; a vector that takes this beyond 63 bits is an error.
    """
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    most = F.sqrt(F.lit(float(2**62)) / F.size("embedding"))
    q = F.when(F.forall("embedding", lambda x: F.abs(scaled(x)) < most - 1), F.transform("embedding", lambda x: F.floor(scaled(x)))).otherwise(
        F.raise_error(F.lit("a component is so large that its scores could pass 63 bits")).cast("array<bigint>")
    )
    kept = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")), "floored")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(q: np.ndarray) -> tuple[bytes, str]:
    """A matrix of integers in the narrowest type that holds it, and that type's name."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not q.size or (np.iinfo(t).min <= q.min() and q.max() <= np.iinfo(t).max))
    return q.astype(kind).tobytes(), np.dtype(kind).str


def segments(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings (numbers into the flattened matrix) by descending impact level, and where each level ends; zeros have none."""
    level = np.frexp(np.abs(q.ravel()).astype(np.float64))[1].astype(np.int8)
    order = np.argsort(-level, kind="stable")
    order = order[: np.count_nonzero(level)]
    ends = np.flatnonzero(np.diff(level[order], append=-1)) + 1
    return order, ends


def block_of(number: str):
    """One row for a block: its rows' numbers, ids and components."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        q, kind = packed(matrix(rows.column("q")))
        return pa.table({
            "dim": pa.array([rows.column("dim")[0].as_py()], pa.int32()), number: pa.array([rows.column(number)[0].as_py()], pa.int32()),
            "rows": [rows.column("row").to_numpy().tobytes()], "ids": [rows.column("vec_id").to_numpy().tobytes()], "kind": [kind], "q": [q],
        })

    return run


def missing_norms(q: np.ndarray, postings: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each level the norms of what the levels after it add to each vector."""
    n, d = q.shape
    flat, begins = q.ravel().astype(np.float64), [0, *ends[:-1]]
    added = [np.bincount(postings[b:e] // d, weights=flat[postings[b:e]] ** 2, minlength=n) for b, e in zip(begins, ends, strict=True)]
    after = np.cumsum([np.zeros(n), *added[:0:-1]], axis=0)[::-1]
    return np.sqrt(after)


class Block:
    """An index block made ready once for all the query blocks that it meets."""

    def __init__(self, names: tuple[np.ndarray, np.ndarray], q: np.ndarray, postings: np.ndarray, ends: np.ndarray):
        self.own, self.ids, self.q, self.postings, self.ends = *names, q, postings, ends
        self.most = float(np.abs(q).max(initial=0))
        self.order = np.argsort(self.own)
        self.stop: int | None = None  # the level after which queries are tried, found with the first of them
        self._missing: np.ndarray | None = None
        self._as: dict[tuple, np.ndarray] = {}

    @property
    def missing(self) -> np.ndarray:
        if self._missing is None:
            self._missing = missing_norms(self.q, self.postings, self.ends)
        return self._missing

    def upto(self, level: int, kind: type, begin: int = 0) -> np.ndarray:
        """The components of the levels from ``begin`` up to ``level``, the others 0."""
        whole = begin == 0 and level >= len(self.ends)
        if (begin, level, kind) not in self._as:
            part = self.q.astype(kind) if whole else np.zeros(self.q.shape, kind)
            if not whole:
                take = self.postings[self.ends[begin - 1] if begin else 0 : self.ends[level - 1]]
                part.ravel()[take] = self.q.ravel()[take]
            self._as[(begin, level, kind)] = part
        return self._as[(begin, level, kind)]

    def places(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the queries are rows of the block, and which rows."""
        at = self.order[np.minimum(np.searchsorted(self.own[self.order], asking), len(self.own) - 1)]
        mine = np.flatnonzero(self.own[at] == asking)
        return mine, at[mine]


def best(names: tuple[np.ndarray, np.ndarray], q: np.ndarray, postings: np.ndarray, ends: np.ndarray, asking: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best k of a block for each query: see the module's text.

    names: row numbers and ids of the block; asking: row numbers of the queries.
    """
    return best_of(Block(names, q, postings, ends), asking, queries, k, np.full(len(queries), -np.inf))


def best_of(block: Block, asking: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best(), less the rows that score below each query's ``bar``, which k others are known to reach."""
    n, d = block.q.shape
    # Sums of products are exact in floats below 2**24, in doubles below 2**53, and slower but exact in 64-bit integers above.
    size = d * block.most * float(np.abs(queries).max(initial=0))
    kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    queries = queries.astype(kind)
    norm = np.linalg.norm(queries.astype(np.float64), axis=1)
    out = []

    def finish(who: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        """Ranks (query, row, score) triples and keeps the first k of each query."""
        others = block.own[rows] != asking[who]
        who, rows, score = who[others], rows[others], score[others]
        order = np.lexsort((block.ids[rows], -score, who))
        who, rows, score = who[order], rows[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((asking[who[keep]], block.ids[rows[keep]], score[keep].astype(np.int64)))

    def raised(who: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The queries' bars, or the k-th best of a first part of the rows where that is higher."""
        some = min(n, FIRST)
        return np.maximum(bar[who], np.partition(low[:, :some], some - k, axis=1)[:, some - k]) if some > k else bar[who]

    def proven(who: np.ndarray, got: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that can still be among each query's best k, and whether they are few."""
        slack = norm[who, None] * missing * (1 + 1e-9)
        low = got - slack
        mine, at = block.places(asking[who])
        low[mine, at] = -np.inf
        can = got + slack >= raised(who, low)[:, None]
        return can, can.sum(axis=1) <= MEMBERS

    active = np.arange(len(queries))
    levels = len(block.ends)
    if block.stop is None:
        block.stop = levels
        if n > MEMBERS:
            few, got = active[:PROBE], 0
            for level in range(1, levels):
                got = got + queries[few] @ block.upto(level, kind, level - 1).T
                if proven(few, got, block.missing[level - 1])[1].any():
                    block.stop = level
                    break
            block._as.clear()
    got = queries @ block.upto(block.stop, kind).T  # scores so far, of active queries
    if block.stop < levels:
        can, few = proven(active, got, block.missing[block.stop - 1])
        if few.any():
            who, rows = np.nonzero(can[few])
            who = active[few][who]
            exact = np.int64 if kind is np.int64 else np.float64
            finish(who, rows, np.einsum("ij,ij->i", queries[who].astype(exact), block.q[rows].astype(exact)))
            active, got = active[~few], got[~few]
        if len(active):
            got += queries[active] @ block.upto(levels, kind, block.stop).T
    if len(active):
        # Every posting is in: the scores are final. Only those that reach the bar are ranked.
        mine, at = block.places(asking[active])
        got[mine, at] = least
        who, rows = np.nonzero((got >= raised(active, got)[:, None]) & (got > least))
        finish(active[who], rows, got[who, rows])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and components of a block."""
    return np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q"], np.dtype(r["kind"])).reshape(-1, r["dim"])


def searched(k: int):
    """The best k of a group of index blocks for each query of a group of query blocks: blocks are taken one by one, and the k-th best so far is the next one's bar."""

    def run(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        questions = [unpacked(r) for r in asked.drop_columns(["group"]).to_pylist()]
        found = [(np.empty(0, np.int64),) * 3 for _ in questions]
        bars = [np.full(len(asking), -np.inf) for asking, _, _ in questions]
        for one in range(len(index)):
            own, ids, q = unpacked(index.slice(one, 1).to_pylist()[0])
            q = q.astype(np.int64)
            block = Block((own, ids), q, *segments(q))
            for m, (asking, _, queries) in enumerate(questions):
                row, vec, score = (np.concatenate(c) for c in zip(found[m], best_of(block, asking, queries.astype(np.int64), k, bars[m]), strict=True))
                order = np.lexsort((vec, -score, row))
                row, vec, score = row[order], vec[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                found[m] = row[rank < k], vec[rank < k], score[rank < k]
                last = rank == k - 1
                place = np.argsort(asking)
                # as a float a score beyond 2**53 may come out higher than it is
                bars[m][place[np.searchsorted(asking[place], row[last])]] = np.nextafter(score[last].astype(np.float64), -np.inf)
        return pa.table({c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in zip(("query_row", "vec_id", "score"), zip(*found, strict=True) if found else ([],) * 3, strict=True)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each row of ``queries``, some of its rows; as floored() has them.

    Blocks of both sides are dealt to groups of at most GROUP_BYTES, and a task takes one group of each: the index goes through the shuffle once for
    each group of queries, of which there are few, and the queries once for each of at least GROUPS groups of the index.
    """
    vectors, queries = (t.withColumn("dim", F.size("q")) for t in (vectors, queries))
    counts = lambda t: {r["dim"]: r["count"] for r in t.groupBy("dim").count().collect()}  # noqa: E731  (a row per length of vectors)
    have, ask = counts(vectors), counts(queries)

    def by_dim(number) -> Column:
        """A number for each length of vectors, from that length and how many rows of both sides have it."""
        pairs = [F.lit(x) for d, n in have.items() for x in (d, max(1, int(number(d, n, ask.get(d, 0)))))]
        return F.element_at(F.create_map(*pairs), F.col("dim")) if pairs else F.lit(1)

    def a_group(dim: int, rows: int) -> int:
        """Blocks of so many rows in a group, at two bytes a component."""
        return max(1, GROUP_BYTES // (2 * dim * rows))

    index_blocks, query_blocks = (lambda d, n, m: -(-n // INDEX_BLOCK)), (lambda d, n, m: -(-m // QUERY_BLOCK))
    per_group = lambda d, n, m: min(a_group(d, INDEX_BLOCK), -(-index_blocks(d, n, m) // GROUPS))
    groups = by_dim(lambda d, n, m: -(-index_blocks(d, n, m) // per_group(d, n, m)))
    query_groups = by_dim(lambda d, n, m: -(-query_blocks(d, n, m) // a_group(d, QUERY_BLOCK)))

    def blocks(rows: DataFrame, number: str, many: Column) -> DataFrame:
        # rows spread over the blocks evenly, whatever their order
        dealt = rows.withColumn(number, F.pmod(F.xxhash64("row"), many).cast("int"))
        return dealt.groupBy("dim", number).applyInArrow(block_of(number), f"dim int, {number} int, rows binary, ids binary, kind string, q binary")

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = blocks(vectors, "block", by_dim(index_blocks)).withColumn("group", F.pmod("block", groups)).withColumn("query_group", every(query_groups))
    asked = blocks(queries, "query_block", by_dim(query_blocks)).withColumn("query_group", F.pmod("query_block", query_groups)).withColumn("group", every(groups))
    meet = ["dim", "group", "query_group"]
    met = index.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInArrow(searched(k), "query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(named, "query_row").select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The five best rows for each row of embeddings whose id is divisible by 50."""
    vectors = floored(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
