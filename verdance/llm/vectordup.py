"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine, as distance on the unit sphere. Copies of one vector are a class with a
number of members from the start. The classes of a label are dealt to blocks of bounded size; each block becomes a cover
tree, grown once and stored: nested levels of centres whose covering radii halve. Blocks of a label meet in pairs, and
two trees are traversed together: a pair of nodes farther apart than the threshold and both covering radii is pruned, one whose
members are all within the threshold is counted whole, others are opened. So a group of near copies of any size is
counted node by node, and a meeting of two blocks returns one row per linked vector (its number of links and one vector
that it is connected to), never pairs.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components, and those with a null label, link
with nothing, nor do rows with a null id (component null); vectors of different lengths are not compared; repeated
rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import components, stored, table
from verdance.llm.topk import matrix, usable

LEAST_COSINE = 0.93
#: Classes in a block, about.
BLOCK = 1024
#: Node pairs with fewer member pairs than this are decided by their members at once.
SMALL = 4096
#: Slack of the bounds for rounding; decisions within it are made on cosines.
EPS = 1e-7


class CoverTree:
    """Cover tree over unit vectors. Members are in depth-first order, so that a node's are ``lo:hi``."""

    def __init__(self, vectors: np.ndarray):
        self.nodes: list[tuple[int, int, int, float, list[int]]] = []  # (centre, lo, hi, radius, children)
        self.order: list[int] = []
        self.vectors = vectors
        self.root = self._grow(0, np.arange(len(vectors)), self._distances(0, np.arange(len(vectors))), 1.0)
        self.order = np.array(self.order)
        self.sorted = vectors[self.order]

    def packed(self) -> bytes:
        return pickle.dumps((self.nodes, self.root, self.order))

    @classmethod
    def restored(cls, vectors: np.ndarray, data: bytes) -> CoverTree:
        """The tree over ``vectors`` that packed() gave."""
        tree = cls.__new__(cls)
        tree.vectors = vectors
        tree.nodes, tree.root, tree.order = pickle.loads(data)
        tree.sorted = vectors[tree.order]
        return tree

    def _distances(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.vectors[members] @ self.vectors[centre])))

    def _grow(self, centre: int, members: np.ndarray, away: np.ndarray, radius: float) -> int:
        """Node over ``members``, ``away`` from ``centre``; children are centres more than ``radius`` apart."""
        lo, reach = len(self.order), float(away.max())
        children: list[int] = []
        while 0 < reach <= radius and radius > EPS:  # one centre covers them all: no level of its own
            radius /= 2
        if len(members) == 1 or radius <= EPS:
            self.order.extend(members.tolist())
        else:
            centres, nearest, closest = [centre], np.zeros(len(members), int), away.copy()
            while True:
                left = np.flatnonzero(closest > radius)
                if not len(left):
                    break
                new = int(members[left[0]])
                d = self._distances(new, members)
                closer = d < closest
                nearest[closer], closest[closer] = len(centres), d[closer]
                centres.append(new)
            for k, c in enumerate(centres):
                mine = nearest == k
                children.append(self._grow(c, members[mine], closest[mine], radius / 2))
        self.nodes.append((centre, lo, len(self.order), reach, children))
        return len(self.nodes) - 1


class Union:
    """Disjoint sets of numbers; the smallest one names a set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def dual_links(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, Union]:
    """Links of each member of ``a`` to ``b`` and back, by the trees' orders, and the sets that they connect.

    The members of ``a`` are numbers 0.. and those of ``b`` follow, except where both are one tree: then no member is
    linked to itself, and both arrays are the same. Weights are numbers of copies.
    """
    same = a is b
    far = np.sqrt(2 - 2 * cosine)
    n, m = len(a.order), len(b.order)
    base = 0 if same else n
    wa, wb = weight_a[a.order], weight_b[b.order]
    sum_a, sum_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    whole_a, links_a = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    whole_b, links_b = (whole_a, links_a) if same else (np.zeros(m + 1, np.int64), np.zeros(m, np.int64))
    sets = Union(n if same else n + m)

    def all_linked(i: int, j: int) -> None:
        """Every member of node i with every member of node j."""
        (_, lo, hi, _, _), (_, lo2, hi2, _, _) = a.nodes[i], b.nodes[j]
        whole_a[lo] += sum_b[hi2] - sum_b[lo2]
        whole_a[hi] -= sum_b[hi2] - sum_b[lo2]
        if same and i == j:
            links_a[lo:hi] -= wa[lo:hi]
        else:
            whole_b[lo2] += sum_a[hi] - sum_a[lo]
            whole_b[hi2] -= sum_a[hi] - sum_a[lo]
        for x in range(lo, hi):
            sets.join(x, base + lo2)
        for y in range(lo2, hi2):
            sets.join(lo, base + y)

    def by_members(i: int, j: int) -> None:
        (_, lo, hi, _, _), (_, lo2, hi2, _, _) = a.nodes[i], b.nodes[j]
        linked = a.sorted[lo:hi] @ b.sorted[lo2:hi2].T >= cosine
        if same and i == j:
            np.fill_diagonal(linked, False)
        else:
            links_b[lo2:hi2] += wa[lo:hi] @ linked
        links_a[lo:hi] += linked @ wb[lo2:hi2]
        for x, y in zip(*np.nonzero(linked), strict=True):
            sets.join(lo + int(x), base + lo2 + int(y))

    def open_pair(i: int, j: int) -> tuple[list[int], list[int]]:
        """The nodes to compare next: the wider node's children, both nodes' where they are alike."""
        ki, kj = a.nodes[i][4], b.nodes[j][4]
        if same and i == j:
            return ki, ki
        if not ki or (kj and b.nodes[j][3] > 2 * a.nodes[i][3]):
            return [i], kj
        if not kj or a.nodes[i][3] > 2 * b.nodes[j][3]:
            return ki, [j]
        return ki, kj

    centre_a, centre_b = (np.array([t.nodes[k][0] for k in range(len(t.nodes))]) for t in (a, b))
    radius_a, radius_b = (np.array([t.nodes[k][3] for k in range(len(t.nodes))]) for t in (a, b))
    alone = np.array([hi - lo == 1 for _, lo, hi, _, _ in a.nodes])
    todo = [(a.root, b.root)]
    while todo:
        i, j = todo.pop()
        if (a.nodes[i][2] - a.nodes[i][1]) * (b.nodes[j][2] - b.nodes[j][1]) <= SMALL or not (a.nodes[i][4] or b.nodes[j][4]):
            by_members(i, j)
            continue
        left, right = (np.array(x) for x in open_pair(i, j))
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.vectors[centre_a[left]] @ b.vectors[centre_b[right]].T)))
        reach = radius_a[left][:, None] + radius_b[right][None, :]
        within, near = d + reach < far - EPS, d - reach <= far + EPS
        if same and i == j:  # each unordered pair once, and no member with itself
            near &= np.triu(np.ones(near.shape, bool))
            near[np.eye(len(left), dtype=bool) & alone[left]] = False
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = int(left[x]), int(right[y])
            if within[x, y]:
                all_linked(p, q)
            else:
                todo.append((p, q))
    return links_a + np.cumsum(whole_a)[:-1], links_b + np.cumsum(whole_b)[:-1], sets


def planted(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: ids, numbers of copies, unit vectors and the cover tree over them, grown once for all meetings."""
    rows = rows.sort_by("rep")
    v = matrix(rows.column("vector")).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny and huge components stay in range
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return pa.table({
        "label": pa.array([rows.column("label")[0].as_py()], pa.int64()), "dim": pa.array([v.shape[1]], pa.int32()), "blocks": pa.array([rows.column("blocks")[0].as_py()], pa.int32()),
        "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "ids": [rows.column("rep").to_numpy().tobytes()],
        "copies": [rows.column("copies").to_numpy().tobytes()], "vectors": [v.tobytes()], "tree": [CoverTree(v).packed()],
    })


def met(cosine: float):
    """A block with itself (no row on the right), or two blocks: (rep, links, root) of their linked members."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not (right.num_rows or key[-1].as_py() == key[-2].as_py()):  # an empty block
            return pa.table({c: np.empty(0, np.int64) for c in ("rep", "links", "root")})
        sides = []
        for t in (left, right):
            for r in t.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                sides.append((ids, np.frombuffer(r["copies"], np.int64), CoverTree.restored(np.frombuffer(r["vectors"], np.float64).reshape(len(ids), -1), r["tree"])))
        (ids, copies, a), (ids2, copies2, b) = sides[0], sides[-1]
        links, back, sets = dual_links(a, b, copies, copies2, cosine)
        names = ids[a.order] if a is b else np.concatenate([ids[a.order], ids2[b.order]])
        links = links if a is b else np.concatenate([links, back])
        some = np.flatnonzero(links > 0)
        root = np.array([sets.find(int(x)) for x in some], int)
        return pa.table({"rep": names[some], "links": links[some], "root": names[root] if len(root) else np.empty(0, np.int64)})

    return run


def vector_classes(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding, label)."""
    zero = ~F.exists("embedding", lambda x: x != 0)
    # rows that take no part get a group of their own, and so do not meet in one task
    part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding") & ~zero, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", part.alias("part"))
    joined = rows.filter("part")
    reps = stored(joined.groupBy("label", F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "vector-classes")
    blocks = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = reps.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    trees = stored(dealt.groupBy("label", "dim", "block").applyInArrow(planted, "label long, dim int, blocks int, block int, ids binary, copies binary, vectors binary, tree binary"), "vector-blocks")
    # Meeting (i, j), i <= j: block i comes from the left, block j from the right unless it is the same one.
    keys = ["label", "dim", "i", "j"]
    left = trees.withColumn("i", F.col("block")).withColumn("j", F.explode(F.expr("sequence(block, blocks - 1)")))
    right = trees.filter("block > 0").withColumn("j", F.col("block")).withColumn("i", F.explode(F.expr("sequence(0, block - 1)")))
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met(cosine), "rep long, links long, root long"), "vector-links")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        reps.join(counted, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = joined.join(named, (joined["label"] == named["label"]) & (joined["embedding"] == named["vector"])).select("vec_id", "n_links", "component_id")
    return out.unionByName(rows.filter("not part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings."""
    return vector_classes(table(spark, sf_dir, "embeddings")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
