"""Line dedup by distinct-site spread, with DataFrame operations only.

A line (a text's part between line feeds, trimmed of blanks) is boilerplate when it stands on at least ``min_sites``
distinct sites and in at least as many different texts. Both are counted by HyperLogLog sketches per line hash, merged by
aggregation; where an estimate is so near to the threshold that the sketch could err, the distinct values are counted
exactly. Texts that are copied whole are one text, on all the sites that have them: without the second count a document
with many mirrors would lose all its lines.
Every boilerplate line is cut, whatever its share of the document; a caller who wants documents that are mostly
boilerplate left whole passes a ``max_share`` of the characters below 1.

Edge cases: a null text stays null and has no lines; blank lines are never boilerplate and stay where they are; a
null site counts as one site, the same as an empty name; repeated rows are copies; very long texts only make more
lines; other columns pass through whatever their names, but for those that ``counts`` names, which are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import held, released, stored, table

#: Standard error of a sketch with 2**LG_K registers is about 1.04 / 2**(LG_K / 2).
LG_K = 10
#: Lines to be cut, over all documents, up to which the table of them is broadcast: 8 bytes each, and a few for their document.
MOST_CUT = 1_000_000


def line_hash(line: Column) -> Column:
    """64-bit hash of a trimmed line, null for a blank one."""
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def line_hashes(text: Column) -> Column:
    """The distinct line hashes of a text."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_hash), lambda h: h.isNotNull()))


def spread_lines(docs: DataFrame, min_sites: int = 10, margin: float = 0.25) -> DataFrame:
    """(line): hashes of the lines that stand on at least ``min_sites`` distinct sites and in as many different texts.

    ``margin``: share of the threshold within which an estimate isn't trusted; over seven standard errors of the
    sketch. Lines farther off, nearly all of them, end with the sketch.
    """
    copied = F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy")
    site = F.coalesce("source", F.lit("")).alias("site")
    placed = docs.filter("text is not null").select(copied, site, F.explode(line_hashes(F.col("text"))).alias("line"))
    placed = stored(placed, "line-sites")
    both = ("site", "copy")
    sketched = placed.groupBy("line").agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K))).alias(f"{c}_n") for c in both])
    likely = stored(sketched.filter(F.least(*[f"{c}_n" for c in both]) >= min_sites * (1 - margin)), "line-spread")
    spread = likely.select("line")
    for c in both:
        near = likely.filter(F.col(f"{c}_n") <= min_sites * (1 + margin)).select("line")
        # distinct first: a common line's rows are merged before the shuffle that counts them
        counted = placed.select("line", c).join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n"))
        spread = spread.join(counted.filter(F.col("n") < min_sites), "line", "left_anti")
    return spread


def drop_spread_lines(docs: DataFrame, min_sites: int = 10, max_share: float = 1.0, counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; adds ``counts``, the numbers of lines and of lines cut."""
    spread = stored(spread_lines(docs, min_sites), "spread-lines")
    found = (
        docs.filter("text is not null")
        .select("doc_id", F.xxhash64("text").alias("copy"), F.explode(line_hashes(F.col("text"))).alias("line"))
        .join(spread, "line")
        .groupBy("doc_id", "copy")
        .agg(F.collect_set("line").alias("cut"))
        .withColumnRenamed("doc_id", "id")
    )
    # where the documents that lose a line are few, no text is moved
    found = stored(found, "cut-lines")
    if (found.agg(F.sum(F.size("cut"))).first()[0] or 0) <= MOST_CUT:
        found = F.broadcast(found)
    joined = held(docs, "doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("copy")), "left")
    joined = joined.withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("cut").isNotNull(), F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("cut"), line_hash(x)), F.lit(False))))
    if max_share < 1:  # a document that would lose more of its characters is left whole
        chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
        kept = F.when(chars(F.col("lines")) - chars(kept) <= max_share * chars(F.col("lines")), kept)
    final = joined.withColumn("kept", kept)
    out = final.withColumn("text", F.coalesce(F.array_join("kept", "\n"), F.col("text")))
    return out.select(
        *[c for c, name in zip(released(docs, "doc_id", "text"), docs.columns, strict=True) if name.lower() not in {c.lower() for c in counts}],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias(counts[1]),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, clean_chars, clean_md5) for every document."""
    return drop_spread_lines(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.length("text").cast("long").alias("clean_chars"),
        F.md5(F.col("text").cast("binary")).alias("clean_md5"),
    )


#: Written from the definition above: every row is split, every line judged by exact distinct counts over all rows.
ORACLE = r"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
parts AS (
  SELECT r, md5(text) AS content, coalesce(source, '') AS site,
         unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM rows WHERE text IS NOT NULL),
boilerplate AS (
  SELECT trim(part) AS line FROM parts WHERE trim(part) <> ''
  GROUP BY trim(part) HAVING count(DISTINCT site) >= 10 AND count(DISTINCT content) >= 10),
cleaned AS (
  SELECT r, count(*) AS n_lines, count(line) AS n_removed,
         coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE line IS NULL), '') AS clean
  FROM parts LEFT JOIN boilerplate ON trim(part) = line GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(clean) AS clean_chars, md5(clean) AS clean_md5
FROM rows LEFT JOIN cleaned USING (r)
"""
