"""Vector operators and revisits against brute force, with the edge cases of their docstrings."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdance.llm import revisits, topk, vectordup

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], VECTORS)


def some_vectors(n=260, dim=12, seed=1):
    """Clusters of near copies, exact copies, scaled copies and lone vectors under two labels."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    while k < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 2, 5, 25]))):
            v = centre + rng.normal(scale=float(rng.choice([0.0, 0.05, 0.2])), size=dim)
            rows.append((k, np.float32(v * rng.choice([1.0, 3.0])), int(rng.integers(0, 2))))
            k += 1
    return rows


def brute_links(rows, cosine=0.93):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None and r[0] is not None for r in rows]
    unit = [np.asarray(r[1], float) / np.linalg.norm(np.asarray(r[1], float)) if k else None for r, k in zip(rows, ok, strict=True)]
    near = {i: set() for i in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                near[a].add(b)
    at = list(ids)
    while True:
        new = [min([at[a], *(at[b] for b in near[a])]) if near[a] else at[a] for a in range(len(rows))]
        if new == at:
            return {ids[a]: (len(near[a]), at[a]) for a in range(len(rows))}
        at = new


@pytest.mark.parametrize(("block", "small"), [(1024, 4096), (40, 30), (7, 1)])
def test_vector_classes_equal_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(vectordup, "BLOCK", block)
    monkeypatch.setattr(vectordup, "SMALL", small)
    rows = some_vectors()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordup.vector_classes(vectors(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_dual_traversal_on_trees_of_any_shape():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = np.concatenate([c + rng.normal(scale=s, size=(30, 5)) for c, s in ((rng.normal(size=5), 0.01), (rng.normal(size=5), 0.2), (rng.normal(size=5), 1.0))])
        x = np.concatenate([x, x[:3] * 2])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = vectordup.CoverTree(x[:50]), vectordup.CoverTree(x[50:])
        assert sorted(a.order.tolist()) == list(range(50))
        for centre, lo, hi, radius, _ in a.nodes:
            assert np.linalg.norm(x[a.order[lo:hi]] - x[centre], axis=1).max() <= radius + 1e-7
        one, two = np.ones(50, np.int64), np.full(len(x) - 50, 2)
        links, back, _ = vectordup.dual_links(a, b, one, two, 0.93)
        true = x[:50] @ x[50:].T >= 0.93
        assert links.tolist() == (2 * true.sum(axis=1))[a.order].tolist() and back.tolist() == true.sum(axis=0)[b.order].tolist()
        own, _, _ = vectordup.dual_links(a, a, one, one, 0.93)
        assert own.tolist() == ((x[:50] @ x[:50].T >= 0.93).sum(axis=1) - 1)[a.order].tolist()


def odd_vectors():
    inf, nan = float("inf"), float("nan")
    return [
        (1, [1, 0], 1), (2, [1, 0], 1), (3, [2, 0], 1), (4, [1, 0], None), (5, None, 1), (6, [0, 0], 1), (7, [1, None], 1), (8, [inf, 1], 1), (9, [nan, 1], 1), (10, [], 1),
        (11, [1, 0, 0], 1), (12, [1, 0], 2), (None, [1, 0], 1), (13, [-0.0, 1], 1), (14, [0.0, 1], 1),
    ]


def test_vector_edge_cases(spark):
    out = vectordup.vector_classes(vectors(spark, odd_vectors()).withColumn("rep", F.lit(1))).collect()
    assert len(out) == len(odd_vectors())
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    assert got == {k: v for k, v in brute_links([r for r in odd_vectors() if r[0] is not None]).items()}
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)]
    assert vectordup.vector_classes(vectors(spark, [])).count() == 0


def brute_top(rows, every, k=5):
    """Places in the table tell rows apart, so that rows of one id meet each other."""
    out = []
    q = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    for i, (query, _, _) in enumerate(rows):
        if query % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), rows[j][0]) for j in range(len(rows)) if j != i and len(q[j]) == len(q[i]))[:k]
            out += [(query, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "MEMBERS", 8)
    rows = some_vectors(seed=3)
    rows += [(i, np.float32(v * (2 + k)), label) for k, (i, v, label) in enumerate(rows[:40])]  # ids with several vectors
    v = topk.floored(vectors(spark, rows))
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 5 = 0")).collect())
    assert [(a, b, c, d) for a, b, c, d in got] == brute_top(rows, 5)


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    q = np.floor(rng.normal(size=(400, 8)) ** 5 * 40).astype(np.int64)
    order, ends = topk.segments(q)
    ids = np.arange(400) * 3
    who, found, score = topk.best((ids, ids), q, order, ends, ids[:50], q[:50], 5)
    true = q[:50] @ q.T
    for i in range(50):
        best = [j for j in np.lexsort((ids, -true[i])) if j != i][:5]
        mine = who == ids[i]
        assert found[mine].tolist() == ids[best].tolist() and score[mine].tolist() == true[i][best].tolist()


def test_top_k_goes_by_groups_of_blocks(spark, monkeypatch):
    for name, value in (("INDEX_BLOCK", 25), ("QUERY_BLOCK", 4), ("MEMBERS", 4), ("FIRST", 10), ("GROUPS", 3), ("GROUP_BYTES", 4 * 25 * 2 * 16)):
        monkeypatch.setattr(topk, name, value)
    rows = some_vectors(seed=5)
    v = topk.floored(vectors(spark, rows))
    assert sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 5 = 0")).collect()) == brute_top(rows, 5)
    # a block goes through the shuffle with two bytes a component, and nothing that can be worked out from it
    some = pa.table({"dim": [64] * 50, "block": [0] * 50, "row": range(50), "vec_id": range(50), "q": [[300] * 64] * 50})
    assert topk.block_of("block")((), some).nbytes < 50 * (64 * 2 + 16) + 100


def test_top_k_edge_cases(spark):
    v = topk.floored(vectors(spark, odd_vectors() + [(50, [1, 0], 1), (50, [3, 0], 1), (100, [1, 0, 0, 0], 1)]).withColumn("row", F.lit(1)))
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 50 = 0")).collect())
    # ties go to the smaller id; zero vectors take part; other lengths don't; a query alone in its length has no rows;
    # of two rows with one id each finds the other
    one = [(50, 196608), (3, 131072), (1, 65536), (2, 65536), (4, 65536)]
    three = [(3, 393216), (1, 196608), (2, 196608), (4, 196608), (12, 196608)]
    assert got == sorted((50, rank, i, score) for best in (one, three) for rank, (i, score) in enumerate(best, 1))
    empty = topk.floored(vectors(spark, []))
    assert topk.top_k(empty, empty).count() == 0


CAPTURES = "capture_id long, url string, ts long, is_revisit boolean, headers map<string,string>"


def brute_resolve(rows):
    out = {}
    for cid, url, ts, revisit, headers in rows:
        own = {k.lower(): v for k, v in (headers or {}).items()}
        if not revisit:
            out[cid] = ("full", cid, own)
            continue
        before = [r for r in rows if not r[3] and r[1] == url and (r[2], r[0]) < (ts, cid)]
        if not before:
            out[cid] = ("orphan", None, None)
            continue
        base = max(before, key=lambda r: (r[2], r[0]))
        old = {k.lower(): v for k, v in (base[4] or {}).items()}
        weak = lambda t: t.strip().removeprefix("W/")
        same = weak(own["etag"]) == weak(old["etag"]) if "etag" in own and "etag" in old else own.get("last-modified") is not None and own.get("last-modified") == old.get("last-modified")
        out[cid] = ("resolved", base[0], old | {k: v for k, v in own.items() if k not in revisits.KEPT_HEADERS}) if same else ("mismatch", None, None)
    return out


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        url = "hot.example/p" if k % 3 == 0 else f"site.example/{int(rng.integers(0, 30))}"
        headers = {"ETag": ["a", "W/a", "b"][int(rng.integers(0, 3))], "Content-Type": f"t{k}", "Date": f"d{k}"} if rng.random() < 0.6 else {"Last-Modified": f"m{int(rng.integers(0, 2))}", "date": f"d{k}"}
        rows.append((k, url, int(rng.integers(0, 200)), bool(rng.random() < 0.7), headers))
    got = {r.capture_id: (r.status, r.response_id, r.merged_headers) for r in revisits.resolve(spark.createDataFrame(rows, CAPTURES).repartition(5)).collect()}
    assert got == brute_resolve(rows)


def test_revisit_edge_cases(spark):
    rows = [(1, "u", 5, False, None), (2, "u", 5, True, {"ETag": "x"}), (3, None, 6, True, {}), (4, "u", None, True, None), (None, "u", 7, False, None), (5, "u", 8, None, None), (2, "u", 5, True, {"ETag": "x"}), (6, "u/", 9, True, {"a": "1", "A": "2"})]
    df = spark.createDataFrame(rows, CAPTURES).select("*", *[F.lit("kept").alias(c) for c in ("site", "row", "_r_range", "_r_headers", "_r_usable")])
    out = revisits.resolve(df).collect()
    assert len(out) == len(rows) and {(r.site, r.row, r._r_range, r._r_headers, r._r_usable) for r in out} == {("kept",) * 5}
    unplaced = next(r for r in out if r.capture_id is None)
    assert (unplaced.status, unplaced.response_id, unplaced.merged_headers) == ("full", None, {})
    status = sorted((r.capture_id or 0, r.status) for r in out)
    assert status == [(0, "full"), (1, "full"), (2, "mismatch"), (2, "mismatch"), (3, "orphan"), (4, "orphan"), (5, "orphan"), (6, "mismatch")]
    assert revisits.resolve(spark.createDataFrame([], CAPTURES)).count() == 0
    again = revisits.resolve(df.withColumn("status", F.lit(1)))
    assert sorted((r.capture_id or 0, r.status) for r in again.collect()) == status and again.columns.count("status") == 1


def test_scores_beyond_63_bits_are_refused(spark):
    df = vectors(spark, [(50, [1e30, 1.0], 1), (1, [1e30, 2.0], 1)])
    with pytest.raises(Exception, match="63 bits"):
        topk.floored(df)


def test_canonical_urls(spark):
    urls = {
        "http://www.A.example:80/x/?utm_source=f#top": "www.a.example/x", "https://m.a.example/x?page=2&ref=y": "m.a.example/x?page=2", "http://m.com/a": "m.com/a", "http://www.com/a": "www.com/a", "a.example/x?ref=1&page=2": "a.example/x?page=2", " https://a.example:8080/ ": "a.example:8080",
        "HTTP://A.Example/Page?Id=B": "a.example/Page?Id=B", "a.example/page?id=b": "a.example/page?id=b", "A.example": "a.example",
    }
    df = spark.createDataFrame([(u, w) for u, w in urls.items()], "u string, want string")
    assert [r.got for r in df.select(revisits.canonical_url(F.col("u")).alias("got"), "want").collect()] == list(urls.values())


def test_bodies_follow_the_response(spark):
    rows = [(1, "u", 1, False, {"ETag": "x"}), (2, "u", 2, True, {"ETag": "x"})]
    done = revisits.resolve(spark.createDataFrame(rows, CAPTURES))
    out = revisits.with_bodies(done, spark.createDataFrame([(1, "html")], "capture_id long, body string")).collect()
    assert {(r.capture_id, r.body) for r in out} == {(1, "html"), (2, "html")}


def test_canonical_urls_with_aliases(spark):
    urls = {
        "http://www.A.example:80/x/?utm_source=f#top": ("a.example/x", "www"), "https://m.a.example/x?page=2&ref=y": ("a.example/x?page=2", "m"), "www.m.a.example": ("m.a.example", "www"), "a.example/www.b.c/": ("a.example/www.b.c", ""),
        "http://m.com/a": ("m.com/a", ""), "http://www.com:8080/a.b": ("www.com:8080/a.b", ""), "m.co.uk": ("m.co.uk", ""), "m.co.uk:80/a": ("m.co.uk/a", ""), "www.m.co.uk": ("m.co.uk", "www"), "m.localhost#a.b": ("m.localhost", ""), "mail.a.example": ("mail.a.example", ""),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(revisits.canonical_url(F.col("u"), ("www", "m")), revisits.host_alias(F.col("u"), ("www", "m"))).collect()
    assert [tuple(r) for r in got] == list(urls.values())


def test_revisits_of_sites_with_several_hosts(spark):
    rng = np.random.default_rng(9)
    rows, of = [], {}
    for k in range(500):
        host, page = ["", "www.", "m."][int(rng.integers(0, 3))], "hot" if k % 3 == 0 else int(rng.integers(0, 30))
        headers = {"etag": "abcd"[int(rng.integers(0, 4))]} if rng.random() < 0.6 else {"last-modified": f"m{int(rng.integers(0, 3))}"}
        rows.append((k, f"{host}site.example/{page}", int(rng.integers(0, 200)), bool(rng.random() < 0.6), headers))
        of[k] = (host, page)
    want = {}
    for cid, _, ts, revisit, headers in rows:
        last = {}
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            if not r[3] and of[r[0]][1] == of[cid][1] and (r[2], r[0]) < (ts, cid):
                last[of[r[0]][0]] = r
        same = [r for r in last.values() if any(headers.get(h) is not None and headers.get(h) == r[4].get(h) for h in ("etag", "last-modified"))]
        best = max(same, key=lambda r: (of[r[0]][0] == of[cid][0], r[2], r[0]), default=None)
        want[cid] = ("full", cid) if not revisit else ("resolved", best[0]) if best else ("mismatch" if last else "orphan", None)
    got = revisits.resolve(spark.createDataFrame(rows, CAPTURES).repartition(5), revisits.ALIASES).collect()
    assert {r.capture_id: (r.status, r.response_id) for r in got} == want
    assert any(s == "resolved" and of[r][0] != of[c][0] for c, (s, r) in want.items())


def test_op3_finds_responses_of_other_hosts(spark, tmp_path):
    import duckdb

    urls = {12: "http://m.shop.example/a", 20: "http://shop.example/a", 15: "https://www.shop.example/b", 21: "https://m.shop.example/b", 18: "http://m.com/a", 22: "http://www.com/a", 11: "http://www.shop.example/a#top"}
    html = {11: "of its own host"}
    spark.createDataFrame([(i, u, html.get(i, "same")) for i, u in urls.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in revisits.op3_revisits(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(revisits.ORACLE).fetchall())
    found = {r[0]: (r[2], r[3]) for r in got}
    # a page without a response takes that of another host of its site, one with a response its own; m.com is no www.com
    assert found[12 * 4 + 1] == ("resolved", 20 * 4) and found[15 * 4 + 1] == ("resolved", 21 * 4) and found[18 * 4 + 1] == ("orphan", None)
    assert found[11 * 4 + 1] == ("resolved", 11 * 4)
