"""MinHash near-dedup over HyperMinHash registers.

A document's set is that of its distinct 5-word shingles, held as 64-bit hashes. One permutation deals the hashes to
``REGISTERS`` buckets; of each bucket's least value only the number of leading zeros (6 bits) and the next 10 bits
(mantissa) are kept, two bytes a bucket. A bucket without a value takes the least value of the whole set under a hash of its
own, so that small sets have full registers too. Bands of compressed registers bring likely pairs together, a Jaccard
estimate corrected for chance collisions drops the hopeless ones, and the pairs left are confirmed on full sets.

Documents with equal sets are one class from the start; only class representatives are banded. In a band's group
every member first meets the group's centre (its first member in every other band, its last one in the rest), and the
confirmed links are joined to components: a group of near copies of any size gives rows in proportion. Then members of one group that are still in different
components meet each other, so that no pair that any band brings together is left undecided: small groups by a join, large
ones (groups with common members as one cluster) block by block inside tasks, which return only links that join components.

With 48 bands of 5 registers, a pair at Jaccard 0.75 shares no band with a probability of about 2e-6, and the estimate
drops it with one of about 3e-5.

Edge cases: null or blank texts have empty sets and link with nothing; texts of one to four words are a single
shingle; very long texts only have larger sets; null ids are kept as rows but take no part in links; repeated rows form one
class, and where a document of a class stays, all rows of its id stay; rows of one id with different texts are one document,
linked with whatever any of its texts is linked with; an empty table gives an empty result; other columns are ignored, and
drop_near_copies returns them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import components, light, stored, table, words_of

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations below the threshold at which an estimate drops a pair.
SLACK = 4.0
#: Members of a group up to which all of its pairs across components are listed; larger ones are compared in blocks of
#: about so many shingles.
SMALL_GROUP, BLOCK = 64, 500_000
#: Words whose hashes a task keeps at once.
KEPT_WORDS = 300_000

_A, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes."""

    def __init__(self, n: int = 5):
        self.n, self.seen = n, {}

    def words(self, text: bytes | None) -> np.ndarray:
        words, seen = words_of(text), self.seen
        if len(seen) > KEPT_WORDS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _A + w[k : len(w) - n + 1 + k]
        return np.unique(mixed(h))


#: What the own hash of each bucket is mixed with.
SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _A)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a set that isn't empty: leading zeros and mantissa of each bucket's least value.

    Values are scaled so that the bucket is their integer part; sorted hashes have sorted buckets, so a bucket's least
    value is its first.
    """
    m = np.uint64(REGISTERS)
    scaled = (hashes >> _HALF) * m + (((hashes & _LOW) * m) >> _HALF)
    bucket = (scaled >> _HALF).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    part, full = np.zeros(REGISTERS, np.int64), np.zeros(REGISTERS, bool)
    part[bucket[first]], full[bucket[first]] = (scaled[first] & _LOW).astype(np.int64), True
    empty = np.flatnonzero(~full)
    if len(empty):
        own = (hashes[None, :] ^ SEEDS[empty][:, None]) * _M1
        part[empty] = (own.min(axis=1) >> _HALF).astype(np.int64)
    length = np.frexp(part.astype(np.float64))[1]  # bits in use
    mantissa = ((part << (33 - length)) & 0xFFFFFFFF) >> (32 - MANTISSA)
    return (((32 - length) << MANTISSA) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS)).copy()
    for k in range(ROWS):
        h = mixed(h * _A + regs[:, k::ROWS])
    return h.view(np.int64)


def chance_collisions(n: float, m: float) -> float:
    """Share of registers that agree by chance, for disjoint sets of n and m values.

    A register's least of n values lies in an interval of length d at x with probability exp(-n x) - exp(-n (x + d)); the sum
    over all (zeros, mantissa) intervals is the chance that two such agree. A register has at least one value.
    """
    n, m = max(n / REGISTERS, 1.0), max(m / REGISTERS, 1.0)
    total = 0.0
    for zeros in range(24):
        d = 2.0 ** -(zeros + 1 + MANTISSA)
        x = 2.0 ** -(zeros + 1) + d * np.arange(1 << MANTISSA)
        total += float((np.exp(-(n + m) * x) * (-np.expm1(-n * d)) * (-np.expm1(-m * d))).sum())
    return total


class Estimator:
    """Tells which pairs can be linked: a Jaccard estimate from registers, corrected for chance collisions."""

    def __init__(self, threshold: float):
        self.threshold, self.known = threshold, {}
        self.least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def possible(self, n: int, regs: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For one set against many: False where sizes or the estimate rule a link out."""
        agree = (others == regs).mean(axis=1)
        chance = np.array([self._chance(n, x) for x in others_n.tolist()])
        estimate = (agree - chance) / (1 - chance)
        return (np.minimum(n, others_n) >= self.threshold * np.maximum(n, others_n)) & (estimate >= self.least)

    def _chance(self, n: int, m: int) -> float:
        key = (n.bit_length(), m.bit_length())  # it varies slowly with the sizes
        if key not in self.known:
            self.known[key] = chance_collisions(1.5 * 2 ** (key[0] - 1), 1.5 * 2 ** (key[1] - 1))
        return self.known[key]


def may_link(threshold: float):
    """Arrow batches of (x, y, n_x, n_y, r_x, r_y): keeps the pairs whose estimate doesn't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimator = Estimator(threshold)
        for batch in batches:
            keep = [
                bool(estimator.possible(nx, np.frombuffer(rx, np.uint16), np.array([ny]), np.frombuffer(ry, np.uint16)[None, :])[0])
                for nx, ny, rx, ry in zip(*(batch.column(c).to_pylist() for c in ("n_x", "n_y", "r_x", "r_y")), strict=True)
            ]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked_in_blocks(percent: int):
    """Two blocks of a cluster (or one, with itself): links (x, y) between members of different components.

    A link that joins two components makes further links between them needless, so there are fewer rows than members.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        alone = key[1].as_py() == key[2].as_py()
        if not left.num_rows or not (alone or right.num_rows):  # no member fell to one of the blocks
            return pa.table({c: np.empty(0, np.int64) for c in ("x", "y")})

        def side(t: pa.Table) -> tuple:
            sets = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
            return t.column("rep").to_numpy(), t.column("component").to_numpy().copy(), np.array([len(h) for h in sets]), np.stack([registers(h) for h in sets]), sets

        estimator, links = Estimator(percent / 100), []
        a = side(left)
        b = a if alone else side(right)
        for k in range(len(a[0])):
            rows = np.flatnonzero(b[1] != a[1][k])
            if b is a:
                rows = rows[rows > k]
            if not len(rows):
                continue
            for y in rows[estimator.possible(int(a[2][k]), a[3][k], b[2][rows], b[3][rows])].tolist():
                if a[1][k] != b[1][y]:
                    both = len(np.intersect1d(a[4][k], b[4][y], assume_unique=True))
                    if 100 * both >= percent * int(a[2][k] + b[2][y] - both):
                        links.append((int(a[0][k]), int(b[0][y])))
                        was, now = max(a[1][k], b[1][y]), min(a[1][k], b[1][y])
                        a[1][a[1] == was] = now
                        b[1][b[1] == was] = now
        x, y = zip(*links, strict=True) if links else ((), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for batch in batches:
        yield pa.record_batch([batch.column("rep"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["rep", "hashes"])


def confirm(percent: int):
    """Arrow batches of (x, y, t_x, t_y): keeps the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, base = Shingler(), None, None
        for batch in batches:
            keep = []
            for x, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("x", "t_x", "t_y")), strict=True):
                if x != last:
                    last, base = x, shingles(tx)
                other = shingles(ty)
                both = len(np.intersect1d(base, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(base) + len(other) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for batch in batches:
        n, digest, regs = [], [], []
        for text in batch.column("text"):
            h = shingles(text.as_py())
            n.append(len(h))
            digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            regs.append(registers(h).tobytes() if len(h) else None)
        yield pa.record_batch([batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "registers"])


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["band", "rep"])


def with_hash(docs: DataFrame) -> DataFrame:
    """(id, text_hash, text) of ``docs``: what finds a text again."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, registers) of every row; digest and registers are null for empty sets."""
    return with_hash(docs).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary")


def texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """(rep, text) of the classes in ``wanted`` (rep)."""
    where = stored(reps.select("rep", "id", "text_hash").join(light(wanted), "rep", "left_semi"), f"{label}-places")
    return stored(with_hash(docs).join(light(where), ["id", "text_hash"]).groupBy("rep").agg(F.min("text").alias("text")), f"{label}-texts")


def linked_in_clusters(docs: DataFrame, reps: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """(x, y): links between different components of large groups' members (rep, component, first: of the group)."""
    clusters = components(apart.select(F.col("rep").alias("a"), F.col("first").alias("b")), "clusters")
    members = stored(apart.select("rep", "component").distinct().join(clusters.toDF("rep", "cluster"), "rep"), "cluster-members")
    texts = texts_of(docs, reps, members.select("rep"), "cluster")
    sets = stored(texts.mapInArrow(shingled, "rep long, hashes binary").join(members, "rep"), "cluster-sets")
    size = F.octet_length("hashes") / 8
    blocks = sets.groupBy("cluster").agg(F.ceil(F.sum(size) / BLOCK).cast("int").alias("blocks"))
    dealt = sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    held, keys = ["cluster", "i", "j", "rep", "component", "hashes"], ["cluster", "i", "j"]
    left = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode(F.expr("sequence(block, blocks - 1)"))).select(*held)
    right = dealt.filter("block > 0").withColumn("j", F.col("block")).withColumn("i", F.explode(F.expr("sequence(0, block - 1)"))).select(*held).toDF(*held)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(linked_in_blocks(percent), "x long, y long")


def near_classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, digest, component_id) of every row of ``docs`` (doc_id, text)."""
    seen = stored(sketches(docs), "sketches")
    full = seen.filter("digest is not null and doc_id is not null")
    # A class of equal sets is numbered, and found again by its smallest id and one of that id's texts.
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = full.groupBy("digest").agg(first.alias("at"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("rep"), F.col("at.doc_id").alias("id"), F.col("at.text_hash").alias("text_hash"), "n", "digest", "registers"), "set-classes")
    placed = reps.select("rep", "registers").mapInArrow(banded, "band long, rep long")
    # Most keys stand alone: only their number and ends are asked for before the groups are put together.
    groups = placed.groupBy("band").agg(F.count("*").alias("members"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("members > 1")
    centre = F.when(F.col("band") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("centre")
    met = stored(placed.join(groups.select("band", "members", centre), "band"), "band-groups")
    stars = stored(met.filter("rep <> centre").select(F.col("centre").alias("x"), F.col("rep").alias("y")).distinct(), "stars")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        sized = reps.select("rep", "n", "registers")
        side = lambda c: sized.toDF(c, f"n_{c}", f"r_{c}")
        likely = stored(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(may_link(percent / 100), "x long, y long"), f"{label}-likely")
        ids = stored(likely.select(F.col("x").alias("rep")).unionByName(likely.select(F.col("y").alias("rep"))).distinct(), f"{label}-ids")
        texts = texts_of(docs, reps, ids, label)
        read = lambda c: texts.toDF(c, f"t_{c}")
        # the second join leaves the rows of one centre side by side
        both = likely.join(read("y"), "y").join(read("x"), "x").select("x", "y", "t_x", "t_y")
        return stored(both.mapInArrow(confirm(percent), "x long, y long"), f"{label}-links")

    found = components(linked(stars, "stars").toDF("a", "b"), "stars")
    named = met.join(found.toDF("rep", "component"), "rep", "left").select("band", "members", "rep", F.coalesce("component", "rep").alias("component"))
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first")).filter("lo <> hi").select("band", "first")
    apart = stored(named.join(split, "band"), "apart")
    # What more links there are is put to the stars found so far, each node's edge to its component's centre.
    edges = [found.toDF("a", "b")]
    few, many = apart.filter(F.col("members") <= SMALL_GROUP).drop("members", "first"), apart.filter(F.col("members") > SMALL_GROUP)
    if not few.isEmpty():
        listed = few.toDF("band", "x", "c_x").join(few.toDF("band", "y", "c_y"), "band").filter("c_x <> c_y and x < y").select("x", "y")
        tried = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        edges.append(linked(listed.distinct().join(tried, ["x", "y"], "left_anti"), "apart").toDF("a", "b"))
    if not many.isEmpty():
        edges.append(linked_in_clusters(docs, reps, many, percent).toDF("a", "b"))
    # Texts of one id belong together: ids with several sets, of which few tables have any.
    several = stored(full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id"), "several-texts")
    if not several.isEmpty():
        own = full.join(light(several), "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest")
        edges.append(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    if len(edges) > 1:
        found = components(reduce(DataFrame.unionByName, edges), "links")
    # The name of a component is its smallest id.
    linked_ids = found.toDF("rep", "component").join(reps.select("rep", "id"), "rep")
    names = linked_ids.groupBy("component").agg(F.min("id").alias("component_id"))
    named_reps = linked_ids.join(names, "component").select("rep", "component_id")
    named_sets = reps.join(named_reps, "rep", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    return (
        seen.join(named_sets, "digest", "left")
        .select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each class of near copies, the one with the smallest id; empty texts all stay."""
    gone = stored(near_classes(docs, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(light(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
