"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within a source, rows are ordered by that key; the key's leading bits cut the
order into ranges, so that a source of any size spreads over many tasks. Prefix sums are taken inside each range
and shifted by the sum of the ranges before it. A source's budget is its number of whole epochs plus a prefix of
the order that holds the rest, cut at the exact word.

Edge cases: a null text has size 0; null is a source of its own; a source without words has target 0 and nothing is
taken; repeated rows are mixed one by one (rows alike in all columns used are interchangeable); rows with a null id
share a key and are ordered by size; very long texts only count more; an empty table gives an empty result; other columns
are ignored, and keep_mixed returns them whatever their names. Sources are ranked in one task, a narrow row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import held, light, released, stored, table, word_count

#: Leading bits of the key that make a range: 1024 ranges a source.
RANGE_BITS = 10
KEY_BITS = 60


def random_key(row_id: Column, seed: int) -> Column:
    """60 bits that depend on the id and the seed alone: the same in every run and in other SQL engines."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of (source, source_size): adds ``target``, the words that the mix takes from it.

    Sources in code-point order, null last, take the weights in turn. The targets share the sum of all sizes by
    weight, but none exceeds ``max_epochs`` times its source; what is over is shared again by weight. In order of
    cap per weight the capped sources come first, so running sums give each source the level that it would set as the
    first one not capped; the highest such level is the common one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(common * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row; see the module's text."""
    # Written once, so that texts are read and words counted once.
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key")), "mix-rows")
    ranged = sized.withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS))
    # One shuffle of narrow rows serves both the range sums and the sort within ranges.
    dealt = ranged.repartition("source", "range")
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs, weights)
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("p_source"), F.col("s.range").alias("p_range"), "start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("start") - F.col("within")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def keep_mixed(docs: DataFrame, seed: int = 17, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns.

    A document is repeated once for each epoch that takes at least half of its words, so the text of the one that
    straddles a source's cut is never torn. Documents without words are not taken. Since the last epoch is a prefix of the
    source's order, it is told by its last row, and texts are not shuffled: each row is held against its source's last one.
    """
    place = lambda size: F.struct(random_key(F.col("doc_id"), seed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(size).alias("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rows = mix(docs, seed, max_epochs, weights).withColumn("epochs", epochs)
    in_last = (F.col("size") > 0) & (2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size"))
    plan = rows.groupBy(F.col("source").alias("mixed")).agg(F.max("epochs").alias("epochs"), F.max(F.when(in_last, place("size"))).alias("last"))
    used = ("doc_id", "source", "text")
    sized = held(docs, *used).withColumn("size", word_count(F.col("text"))).withColumn("place", place("size"))
    joined = sized.join(light(stored(plan, "mix-plan")), F.col("source").eqNullSafe(F.col("mixed")))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.coalesce((F.col("place") <= F.col("last")).cast("int"), F.lit(0)))
    copies = joined.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*released(docs, *used))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap,
         CAST(CAST(sum(source_size) OVER () AS BIGINT)
              - coalesce(CAST(sum(3 * source_size) OVER before AS BIGINT), 0) AS DOUBLE)
         / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER before AS BIGINT), 0) AS DOUBLE) AS level
  FROM s
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE)
              ELSE (max(level) FILTER (WHERE level * weight < cap) OVER ()) * weight END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(round(target - epochs * source_size) AS BIGINT) - start)) AS BIGINT) AS taken
FROM p
"""
