"""Audit of how the sources of a language diverge from each other and from the language as a whole.

A task counts its documents' terms by (language, source); sums over tasks and the terms in enough documents of a language
are the vocabulary. A term's rate in a group is p = 1 + floor(10**9 (count + 1) / (N + V)), its part of a divergence
from rate q is floor((p - q)**2 / q); all of it is integer arithmetic.

Most counts are zero, and zeros all have their group's baseline rate b. So the sum over the vocabulary for a pair of
sources (s, t) is that of the baselines, V f(b_s, b_t), and corrections for the counts that aren't zero:
    f(p_s, b_t) - f(b_s, b_t)      for each term of s: as many rows as s has different counts,
    f(b_s, p_t) - f(b_s, b_t)      for each term of t, likewise,
    f(p_s, p_t) - f(p_s, b_t) - f(b_s, p_t) + f(b_s, b_t)      for each term of both, summed by pair inside tasks.

The k highest terms of a group are found by radix selection: a distributed histogram over the highest byte of the values
tells in which bin the k-th lies, the next one counts inside that bin, and so on to the last byte; terms equal to the
threshold are then counted by the bytes of their text in the same way. A pass moves at most 256 rows a group and task, and only the
k rows of a group, and a last bin of at most ``SMALL``, are ever sorted.

Edge cases: null text, lang and source are empty texts; a source without terms, or a language without vocabulary, has its
pairs with value 0; a source alone in its language has no pairs; repeated rows are documents of their own; ties go to the
smaller text by UTF-8 bytes; very long texts and terms are counted whole; sums beyond 63 bits are an error; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import light, stored, table

#: Bytes that end a term become blanks, A-Z become a-z, all others stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x80 and not 0x61 <= b <= 0x7A else b for b in range(256))
MIN_DOCS, TOP = 3, 200
UNIT = 10**9
#: Terms that a task counts before it hands them on, and pairs of sources that it sums at once.
HELD_TERMS, CHUNK = 400_000, 1_000_000
#: A bin of so many rows is not narrowed further: the final sort of a key's rows puts them in order.
SMALL = 1_000
GROUP = ["lang", "source"]
#: Keys up to which a table with a row for each of them is broadcast.
MOST_LIGHT = 1_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the documents of a task, with a row without a term for each group."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms, size = [None, *n], len(n) + 1
            yield pa.record_batch([
                pa.array([lang] * size), pa.array([source] * size), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
            ], names)

    held = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for batch in batches:
        for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, docs = held[lang, source]
            size -= len(n)
            terms = text.encode().translate(FOLD).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size > HELD_TERMS:
                yield from rows()
                held.clear()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group; each group has a row without a term too."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", *GROUP)])
    parts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 1) / (total + terms)); null where there are no terms."""
    high = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", high, F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0)))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, t, value): corrections for the terms of both sources, summed by pair of groups; a row of the input is a term's groups."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        group, p, b = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
        names, dense = np.unique(group, return_inverse=True)
        many = np.repeat(sizes, sizes)  # partners of each member, itself included
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs = np.cumsum(many)
        begin = 0
        while begin < len(many):
            end = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + CHUNK, side="right")))
            m = many[begin:end]
            s = np.repeat(np.arange(begin, end), m)
            t = np.repeat(first[begin:end], m) + np.arange(len(s)) - np.repeat(np.cumsum(m) - m, m)
            s, t = s[s != t], t[s != t]
            value = _gaps(p[s], p[t]) - _gaps(p[s], b[t]) - _gaps(b[s], p[t]) + _gaps(b[s], b[t])
            codes, at = np.unique(dense[s] * len(names) + dense[t], return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, at, value)
            yield pa.record_batch([pa.array(names[codes // len(names)]), pa.array(names[codes % len(names)]), pa.array(total)], ["s", "t", "value"])
            begin = end


def top_ranked(rows: DataFrame, keys: list[str], k: int, value: str = "value", item: str = "item") -> DataFrame:
    """The ``k`` rows of each key with the highest values (long, not negative), ties by the text's bytes, with their ``rank``.

    ``rows`` is read once for each byte of the largest value and of the texts that ties need, so it should be a written table.
    """
    text, size = F.col(item).cast("binary"), F.col("size")
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("size"), F.max(value).alias("most")), "radix-sizes")
    n_keys, largest = sizes.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(0))).first()
    few = F.broadcast if n_keys <= MOST_LIGHT else lambda df: df  # a state has a row for each key at most

    def binned(state: DataFrame, inside: Column, digit: Column, down: bool) -> DataFrame:
        """Each key's bin with its row of rank ``need`` among the rows inside: ``need`` is then the place in the bin, ``size`` what it holds."""
        told = [c for c in state.columns if c not in keys]
        counts = rows.join(few(state), keys).filter(inside).groupBy(*keys, *told, digit.alias("digit")).agg(F.count("*").alias("size"))
        order = F.col("digit").desc() if down else F.col("digit")
        upto = F.sum("size").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("upto") - size
        found = counts.withColumn("upto", upto).filter((F.col("need") <= F.col("upto")) & (F.col("need") > before))
        return found.withColumn("need", F.col("need") - before).drop("upto")

    state = sizes.filter(size > k).select(*keys, F.lit(0).cast("long").alias("threshold"), F.lit(k).cast("long").alias("need"))
    for shift in range(max(0, (largest.bit_length() - 1) // 8 * 8), -1, -8):
        v = F.col(value)
        found = binned(state, F.shiftright(v, shift + 8) == F.col("threshold"), F.shiftright(v, shift).bitwiseAND(F.lit(255)), True)
        state = found.select(*keys, (F.col("threshold") * 256 + F.col("digit")).alias("threshold"), "need", *["size"] * (shift == 0))
    # Of the rows equal to the threshold those up to ``bound`` in their first bytes stay for the final sort; null keeps all.
    none = F.lit("").cast("binary")
    at = stored(state.select(*keys, "threshold", "need", none.alias("bound"), ((F.col("need") == size) | (size <= SMALL)).alias("done")), "radix-0")
    limits, length = at.filter("done").select(*keys, "threshold", F.lit(None).cast("binary").alias("bound")), 0
    while not (left := at.filter("not done").select(*keys, "threshold", "need", "bound")).isEmpty():
        inside = (F.col(value) == F.col("threshold")) & (F.substring(text, 1, length) == F.col("bound"))
        found = binned(left, inside, F.substring(text, length + 1, 1), False)
        done = (F.col("need") == size) | (size <= SMALL) | (F.length("digit") == 0)
        length += 1
        at = stored(found.select(*keys, "threshold", "need", F.concat("bound", "digit").alias("bound"), done.alias("done")), f"radix-{length}")
        limits = limits.unionByName(at.filter("done").select(*keys, "threshold", "bound"))
    tie = F.col("bound").isNull() | (F.substring(text, F.lit(1), F.length("bound")) <= F.col("bound"))
    kept = rows.join(few(limits), keys, "left").filter(F.col("threshold").isNull() | (F.col(value) > F.col("threshold")) | ((F.col(value) == F.col("threshold")) & tie))
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), text)
    return kept.drop("threshold", "bound").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for the other sources of the language, ``term`` rows for the top terms."""
    counts = stored(term_counts(docs), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    marked = counts.filter("term is not null").withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    kept = stored(marked.filter(F.col("in_docs") >= min_docs).select(*GROUP, "term", "n", "lang_n"), "kept-terms")
    # one row a group: its number, words N, its language's words and vocabulary V, and the baseline rate
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    own = counts.filter("term is null").select(*GROUP).join(totals, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = stored(own.withColumn("b", rate(F.lit(0).cast("long"), F.col("total"), F.col("v"))).withColumn("g", F.monotonically_increasing_id()), "groups")
    rated = kept.join(light(groups), GROUP).withColumn("p", rate(F.col("n"), F.col("total"), F.col("v")))

    q = rate(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = rated.withColumn("q", q).filter("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = top_ranked(stored(above, "term-gaps"), GROUP, top)

    side = lambda a: groups.select("lang", *[F.col(c).alias(f"{a}_{c}") for c in ("g", "b", "v", "total", "source")])
    s_p, t_p = F.col("s_p"), F.col("t_p")
    s_b, t_b, value = F.col("s_b"), F.col("t_b"), lambda x: x.alias("value")
    others = side("s").join(side("t"), "lang").filter("s_g <> t_g")
    base = others.select("s_g", "t_g", value(F.coalesce(F.col("s_v") * gap(s_b, t_b), F.lit(0))))
    # groups by their different counts: one row stands for all terms of a count
    by_count = rated.groupBy("lang", "g", "b", "p").agg(F.count("*").alias("m"))
    alone = by_count.select("lang", *[F.col(c).alias(f"s_{c}") for c in ("g", "b", "p")], "m").join(side("t").select("lang", "t_g", "t_b"), "lang").filter("s_g <> t_g")
    both_ways = F.explode(F.array(
        F.struct(F.col("s_g").alias("s_g"), F.col("t_g").alias("t_g"), value(F.col("m") * (gap(s_p, t_b) - gap(s_b, t_b)))),
        F.struct(F.col("t_g").alias("s_g"), F.col("s_g").alias("t_g"), value(F.col("m") * (gap(t_b, s_p) - gap(t_b, s_b)))),
    ))
    single = alone.select(both_ways.alias("x")).select("x.*")
    shared = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "b")).alias("members")).filter(F.size("members") > 1).select("members")
    double = shared.mapInArrow(_both, "s_g long, t_g long, value long")
    summed = base.unionByName(single).unionByName(double).groupBy("s_g", "t_g").agg(F.sum("value").alias("value"))
    named = summed.join(groups.select(F.col("g").alias("s_g"), *GROUP), "s_g").join(groups.select(F.col("g").alias("t_g"), F.col("source").alias("item")), "t_g")
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    pairs = named.select(*GROUP, "item", "value", F.row_number().over(order).alias("rank"))

    columns = lambda part: [*GROUP, F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank) over all documents."""
    return audit(table(spark, sf_dir, "documents"))


#: Dense, over every group and kept term, in integers of 128 bits.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
rates AS MATERIALIZED (
  SELECT lang, source, term, n,
         1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // (sum(lang_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q
  FROM dense),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM every_pair LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
