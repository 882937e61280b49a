"""Resolution of not-modified revisits in a crawl's captures.

A revisit record says that a page had not changed since an earlier capture. Each is matched as of its time with the latest
earlier full response of its canonical URL; the match holds if the validators agree (weak comparison of the ETag, or else
equality of Last-Modified), and then the stored response's headers are updated by those that the revisit may change.

A site may answer under several host names. The caller names the first labels that don't make another site (``aliases``);
a page then has the latest response of each of its hosts, and a revisit takes that of its own host if the validators agree,
or else the latest one of the other hosts with which they agree. So sites with bodies of their own for each host lose nothing.

The as-of join is a distributed "last value so far": captures are range-partitioned by (URL, time, id) and keep the number
of their range, each (URL, range) finds its last full response (of each alias), those summaries (at most one for each URL
and range) carry it over to the ranges that follow, and inside a range a window fills in the rest. A URL with a third of
all captures so spreads over as many tasks as it has ranges.

Edge cases: captures with a null URL, time or id can't be placed: no revisit is resolved to them, revisits among them are
orphans and full responses stay full, with their own headers; a null is_revisit is an orphan; a full response at the
revisit's own time counts as earlier if its id is smaller; repeated rows are resolved one by one; null header maps are
empty; bodies are not moved (the result names the capture that has the body); other columns pass through whatever their
names, but for those that the result adds, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import held, released, stored, table

#: Headers of a revisit that don't touch the stored response: they describe the message or the connection, not the page.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't change a page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
#: First labels of hosts that the query takes as other names of the site without them.
ALIASES = ("www", "m")
#: Labels under which countries register names: ``co.uk`` is nobody's site, so that ``m.co.uk`` is one of its own.
SECOND_LEVEL = "ac|co|com|edu|gob|gov|go|gub|mil|ne|net|nom|or|org"


def bare_url(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.concat(F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)), F.regexp_replace(bare, r"^[^/?#]*", ""))
    return F.regexp_replace(bare, r"#.*$", "")


def alias_pattern(aliases: Sequence[str]) -> str:
    """An alias that begins a bare URL and leaves a registered name: two labels, and not only a country's second level."""
    return rf"^({'|'.join(map(re.escape, aliases))})\.(?!(?:{SECOND_LEVEL})\.[a-z]{{2}}\.?(?:[:/?]|$))(?=[^./?:]+\.[^./?:])"


def host_alias(url: Column, aliases: Sequence[str]) -> Column:
    """The one of ``aliases`` that canonical_url(url, aliases) takes away; empty if it takes none."""
    return F.regexp_extract(bare_url(url), alias_pattern(aliases), 1) if aliases else F.lit("")


def canonical_url(url: Column, aliases: Sequence[str] = ()) -> Column:
    """Scheme, default ports, fragment, tracking parameters and a last slash don't make another page.

    The host is in lower case and otherwise as it was: that of another name is another site, even where only ``www.`` or
    ``m.`` differs, unless the caller names such labels as ``aliases`` and a registered name is left without them. Path and
    query are as they were, since case tells pages apart there.
    """
    bare = F.regexp_replace(bare_url(url), alias_pattern(aliases), "") if aliases else bare_url(url)
    bare = F.regexp_replace(bare, r"^([^/:?]+):(80|443)(?=/|\?|$)", "$1")
    bare = F.regexp_replace(bare, rf"(?<=[?&]){TRACKING}=[^&]*&?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?&]$", ""), r"/$", "")


def opaque(etag: Column) -> Column:
    """An ETag for weak comparison."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def lowered(headers: Column) -> Column:
    """Header names in lower case; null is no headers. Of names that then clash the last by (name, value) stays."""
    entries = F.array_sort(F.map_entries(headers))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.expr("cast(map() as map<string,string>)"))


def agree(here: Column, there: Column) -> Column:
    """Whether the validators of two header maps agree; false if they have none in common."""
    tag, old_tag = opaque(here["etag"]), opaque(there["etag"])
    return F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).otherwise(F.coalesce(here["last-modified"] == there["last-modified"], F.lit(False)))


def resolve(captures: DataFrame, aliases: Sequence[str] = ()) -> DataFrame:
    """``captures`` (capture_id, url, ts, is_revisit, headers) with status, response_id and merged_headers.

    status: ``full`` for a full response, else ``resolved``, ``mismatch`` (earlier full responses, other validators) or
    ``orphan`` (none). response_id and merged_headers are those of full and resolved records; the id names the capture
    with the body. ``aliases``, in lower case, are first labels of hosts that don't make another site.
    """
    added = ("canonical", "status", "response_id", "merged_headers")
    used = ("capture_id", "url", "ts", "is_revisit", "headers")
    own = captures.drop(*added)
    rows = held(own, *used).select("*", canonical_url(F.col("url"), aliases).alias("canonical"), host_alias(F.col("url"), aliases).alias("_r_alias"), lowered(F.col("headers")).alias("_r_headers"))
    usable = F.coalesce(F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("capture_id").isNotNull() & F.col("is_revisit").isNotNull(), F.lit(False))
    # Written before the ranges are sampled, so that URLs and headers are worked out once.
    ready = stored(rows.withColumn("_r_usable", usable), "captures-read")
    ranged = ready.filter("_r_usable").repartitionByRange("canonical", "ts", "capture_id").withColumn("_r_range", F.spark_partition_id())
    placed = stored(ranged, "captures")
    full = F.when(~F.col("is_revisit"), F.struct("ts", "capture_id", "_r_alias", F.col("_r_headers").alias("headers")))
    when = F.struct("ts", "capture_id")
    names = {name: f"_r_last{i}" for i, name in enumerate(dict.fromkeys(("", *aliases)))}
    of = lambda name, value: F.when(F.col("_r_alias") == name, value)
    last = placed.filter("not is_revisit").groupBy("canonical", "_r_range").agg(*[F.max_by(full, of(name, when)).alias(c) for name, c in names.items()])
    ranges = placed.select("canonical", "_r_range").distinct().join(last, ["canonical", "_r_range"], "left")
    earlier = Window.partitionBy("canonical").orderBy("_r_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("canonical", "_r_range", *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in names.values()])
    inside = Window.partitionBy("canonical", "_r_range").orderBy("ts", "capture_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumns({f"_r_inside{c}": F.last(of(name, full), ignorenulls=True).over(inside) for name, c in names.items()}).join(carried, ["canonical", "_r_range"])
    here = F.col("_r_headers")
    bases = F.array_compact(F.array(*[F.coalesce(f"_r_inside{c}", c) for c in names.values()]))
    agreed = F.filter("_r_bases", lambda b: agree(here, b["headers"]))
    rank = lambda b: F.struct(b["_r_alias"] == F.col("_r_alias"), b["ts"], b["capture_id"])
    best = F.reduce(agreed, F.get(agreed, F.lit(0)), lambda a, b: F.when(rank(b) > rank(a), b).otherwise(a))
    seen = seen.withColumn("_r_bases", bases).withColumn("_r_base", best)
    base = F.col("_r_base")
    there = base["headers"]
    status = F.when(~F.col("is_revisit"), "full").when(base.isNotNull(), "resolved").when(F.size("_r_bases") > 0, "mismatch").otherwise("orphan")
    changed = F.map_filter(here, lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(there, lambda k, _: ~F.map_contains_key(changed, k)), changed)
    out = seen.withColumn("status", status).select(
        "row", *used, "canonical", "status",
        F.when(F.col("status") == "full", F.col("capture_id")).when(F.col("status") == "resolved", base["capture_id"]).alias("response_id"),
        F.when(F.col("status") == "full", here).when(F.col("status") == "resolved", merged).alias("merged_headers"),
    )
    is_full = F.coalesce(~F.col("is_revisit"), F.lit(False))
    left_out = ready.filter("not _r_usable").select(
        "row", *used, "canonical", F.when(is_full, "full").otherwise("orphan").alias("status"), F.when(is_full, F.col("capture_id")).alias("response_id"), F.when(is_full, here).alias("merged_headers")
    )
    return out.unionByName(left_out).select(*released(own, *used), *added)


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved records with the body of the response that they stand for; ``bodies`` is (capture_id, body).

    A body that many revisits share is a hot key of this join, which adaptive execution splits.
    """
    return resolved.join(bodies.select(F.col("capture_id").alias("response_id"), "body"), "response_id", "left")


def page_captures(pages: DataFrame) -> DataFrame:
    """The crawl log that the query reads from ``pages``: four visits for each page, the first one a full response.

    A visit's time is derived from the page's id. The second visit is a revisit with the page's own ETag, the third one
    has a Last-Modified only, which is wrong for each seventh page, and the fourth one an ETag in weak form, which is wrong for
    each fifth. Pages with an odd number in tens give no full response, so that their visits need those of other pages.
    """
    visit = F.explode(F.expr("sequence(0L, 3L)"))
    tag = F.substring(F.md5(F.col("html").cast("binary")), 1, 12)
    day = lambda c: F.date_format(F.date_add(F.lit("2020-01-01"), c.cast("int")), "yyyy-MM-dd")
    modified = day(F.col("page_id") % 300)
    v, p = F.col("visit"), F.col("page_id")
    visits = pages.select("page_id", "url", "html", visit.alias("visit")).filter(~((v == 0) & ((p / 10).cast("long") % 2 == 1) & (p % 3 == 0)))
    none = F.lit(None).cast("string")
    entries = F.array(
        F.struct(F.lit("ETag").alias("key"), F.when(v.isin(0, 1), tag).when(v == 3, F.when(p % 5 == 0, F.lit("W/other")).otherwise(F.concat(F.lit("W/"), tag))).otherwise(none).alias("value")),
        F.struct(F.lit("Last-Modified").alias("key"), F.when(v == 0, modified).when(v == 2, F.when(p % 7 == 0, F.lit("1999-01-01")).otherwise(modified)).otherwise(none).alias("value")),
        F.struct(F.lit("Content-Type").alias("key"), F.when(v == 0, F.lit("text/html")).otherwise(F.lit("text/plain")).alias("value")),
        F.struct(F.lit("Cache-Control").alias("key"), F.concat(F.lit("max-age="), (v * 60).cast("string")).alias("value")),
        F.struct(F.lit("Content-Length").alias("key"), F.when(v == 0, F.length("html").cast("string")).otherwise(none).alias("value")),
    )
    return visits.select(
        (p * 4 + v).alias("capture_id"), "url", (v * 1_000_000_000 + p).alias("ts"), (v > 0).alias("is_revisit"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
    )


def op3_revisits(spark, sf_dir: str) -> DataFrame:
    """(capture_id, canonical, status, response_id, headers) of every capture derived from pages; headers as sorted text."""
    done = resolve(page_captures(table(spark, sf_dir, "pages")), ALIASES)
    lines = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return done.select("capture_id", "canonical", "status", "response_id", F.array_join(lines, "\n").alias("headers"))


ORACLE = r"""
WITH v AS (
  SELECT page_id, url, html, visit, row_number() OVER () AS rid FROM pages, range(4) r(visit) WHERE NOT (visit = 0 AND (page_id // 10) % 2 = 1 AND page_id % 3 = 0)),
c AS (
  SELECT rid, page_id * 4 + visit AS capture_id, visit * 1000000000 + page_id AS ts, visit > 0 AS is_revisit,
         regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS w, regexp_extract(w, '^[^/?#]*') AS host,
         CASE WHEN regexp_matches(lower(host), '^(www|m)\.[^.:]+\.[^.:]') AND NOT regexp_matches(lower(host), '^(www|m)\.(ac|co|com|edu|gob|gov|go|gub|mil|ne|net|nom|or|org)\.[a-z][a-z]\.?(:|$)')
              THEN regexp_extract(lower(host), '^(www|m)\.', 1) ELSE '' END AS alias,
         CASE alias WHEN '' THEN lower(host) ELSE substr(lower(host), length(alias) + 2) END || substr(w, length(host) + 1) AS u,
         CASE WHEN visit IN (0, 1) THEN substr(md5(html), 1, 12)
              WHEN visit = 3 THEN CASE WHEN page_id % 5 = 0 THEN 'W/other' ELSE 'W/' || substr(md5(html), 1, 12) END END AS etag,
         CASE WHEN visit = 0 OR (visit = 2 AND page_id % 7 <> 0) THEN strftime(DATE '2020-01-01' + CAST(page_id % 300 AS INTEGER), '%Y-%m-%d')
              WHEN visit = 2 THEN '1999-01-01' END AS modified,
         CASE WHEN visit = 0 THEN 'text/html' ELSE 'text/plain' END AS content_type,
         'max-age=' || visit * 60 AS cache, CASE WHEN visit = 0 THEN CAST(length(html) AS VARCHAR) END AS size
  FROM v),
n AS (
  SELECT * EXCLUDE (u, w, host), regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(regexp_replace(u, '#.*$', ''), '^([^/:?]+):(80|443)(/|\?|$)', '\1\3'),
           '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?', '\1', 'g'), '[?&]$', ''), '/$', '') AS canonical
  FROM c),
r AS (
  SELECT *, CASE WHEN NOT is_revisit THEN struct_pack(ts := ts, id := capture_id, alias := alias, etag := etag, modified := modified, content_type := content_type, cache := cache, size := size) END AS own FROM n),
b AS (
  SELECT *, last_value(CASE alias WHEN '' THEN own END IGNORE NULLS) OVER before AS b0, last_value(CASE alias WHEN 'www' THEN own END IGNORE NULLS) OVER before AS b1,
         last_value(CASE alias WHEN 'm' THEN own END IGNORE NULLS) OVER before AS b2
  FROM r WINDOW before AS (PARTITION BY canonical ORDER BY ts, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (
  SELECT * EXCLUDE (b0, b1, b2), unnest([b0, b1, b2]) AS base, b0 IS NULL AND b1 IS NULL AND b2 IS NULL AS alone FROM b),
a AS (
  SELECT *, CASE WHEN base IS NULL THEN false WHEN etag IS NOT NULL AND base.etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(base.etag, '^W/', '')
                 ELSE coalesce(modified = base.modified, false) END AS agrees FROM p),
s AS (
  SELECT *, CASE WHEN NOT is_revisit THEN 'full' WHEN alone THEN 'orphan' WHEN agrees THEN 'resolved' ELSE 'mismatch' END AS status
  FROM a QUALIFY row_number() OVER (PARTITION BY rid ORDER BY agrees DESC, coalesce(base.alias = alias, false) DESC, base.ts DESC NULLS LAST, base.id DESC NULLS LAST) = 1)
SELECT capture_id, canonical, status, CASE status WHEN 'full' THEN capture_id WHEN 'resolved' THEN base.id END AS response_id,
       CASE status
         WHEN 'full' THEN concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || size, 'content-type: ' || content_type, 'etag: ' || etag, 'last-modified: ' || modified)
         WHEN 'resolved' THEN concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || base.size, 'content-type: ' || base.content_type,
                                        'etag: ' || coalesce(etag, base.etag), 'last-modified: ' || coalesce(modified, base.modified)) END AS headers
FROM s
"""
