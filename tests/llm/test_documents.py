"""Operators on documents: results on small tables, and the edge cases that their docstrings define."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdance.llm import lines, mixing, neardup, packing, scoring, sharding, toxicity
from verdance.llm.common import components, crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return [
        (1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, None, None), (3, "", "s"), (4, " \t\n", "t"), (None, "x y", "t"), (None, None, None),
        (5, LONG, "u"), (6, LONG, "u"), (7, "one", "s"), (8, "ÀÉ ẞ one\x1ctwo", "t"), (9, "a b c d e f g", None),
    ]


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_components_fail_rather_than_end_early(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long").repartition(4)
        with pytest.raises(RuntimeError):
            components(edges, "t", max_rounds=1)
        assert {r.component for r in components(edges, "t").collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_are_the_smallest_nodes(spark):
    edges = [(5, 4), (4, 3), (10, 11), (11, 12), (3, 3), (20, 21), (21, 20), *[(100 + k, 101 + k) for k in range(30)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {3: 3, 4: 3, 5: 3, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20} | {100 + k: 100 for k in range(31)}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# near-dedup


def brute_classes(rows):
    """(set size, component) by id; an id with several texts has the size of its last one and is one node."""
    every = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    at = {i: i for i, _ in every}
    while True:
        new = dict(at)
        for (a, s), (b, t) in itertools.combinations(every, 2):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return {i: (len(s), at[i]) for i, s in every}
        at = new


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(90):
        size = int(rng.choice([3, 6, 12, 40, 150]))
        base = [vocabulary[j] for j in rng.integers(0, 60, size)]
        rows.append((3 * k, " ".join(base), "s"))
        edited = list(base)
        edited[int(rng.integers(0, size))] = "edit"
        rows.append((3 * k + 1, " ".join(edited), "s"))
        rows.append((3 * k + 2, " ".join(base).upper(), "t"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_classes(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies above the size that is listed pair by pair, cut to several blocks."""
    monkeypatch.setattr(neardup, "SMALL_GROUP", 3)
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for j in rng.integers(0, 120, int(rng.integers(1, 6))):
            text[j] = f"e{k}"
        rows.append((k, " ".join(text), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_classes(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_links_every_text_of_an_id(spark):
    """Documents 7 and 8 are near copies of different texts of document 5, and so is 3 of a third one."""
    rng = np.random.default_rng(7)
    bases = [[f"{c}{j}" for j in rng.integers(0, 90, 60)] for c in "abc"]
    rows = [(5, " ".join(b), "s") for b in bases] + [(i, " ".join([*b[:-1], "end"]), "s") for i, b in zip((7, 8, 3), bases, strict=True)] + [(9, "something else here and there", "s")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_classes(docs(spark, rows)).collect()}
    assert {(i, c) for i, _, c in got} == {(i, c) for i, (_, c) in brute_classes(rows).items()} == {(5, 3), (7, 3), (8, 3), (3, 3), (9, 9)}


def test_near_dedup_edge_cases(spark):
    rows = neardup.near_classes(docs(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got[1] == (3, 1) and got[9] == (3, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4)
    assert got[5][1] == got[6][1] == 5 and got[7] == (1, 7)
    assert neardup.near_classes(docs(spark, [])).count() == 0
    clashing = ["_gone", "id", "digest", "rep", "component_id", "text_hash"]
    kept = neardup.drop_near_copies(docs(spark, odd_rows()).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])).collect()
    assert {tuple(r[c] for c in clashing) for r in kept} == {tuple(range(len(clashing)))}
    kept = [r.doc_id for r in kept]
    assert sorted(i for i in kept if i is not None) == [1, 1, 2, 3, 4, 5, 7, 8] and kept.count(None) == 2


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.unique(h[:2000]), np.unique(h[500:2500])
    estimator = neardup.Estimator(0.75)
    ra, rb = neardup.registers(a), neardup.registers(b)
    chance = neardup.chance_collisions(2000, 2000)
    assert 0 < chance < 0.01
    assert abs(((ra == rb).mean() - chance) / (1 - chance) - 1500 / 2500) < 0.15
    assert not estimator.possible(100, neardup.registers(a[:100]), np.array([2000]), rb[None, :])[0]


# packing


def check_pieces(rows, texts):
    encode = packing.Encoder(packing.vocabulary_paths()[0])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.append(encode(text or ""), 1).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return by_seq


def test_packing_places_every_token_once(spark):
    rng = np.random.default_rng(2)
    texts = {k: " ".join(f"w{j}" for j in rng.integers(0, 500, int(rng.integers(0, 900)))) for k in range(300)} | {900: None, 901: "", 902: LONG, 903: "a" * 20_000, 904: "x <|endoftext|> y"}
    df = docs(spark, [(k, t, "s") for k, t in texts.items()]).repartition(3)
    found = check_pieces(packing.pack(df, packing.vocabulary_paths()).collect(), texts)
    used = sum(r.length for held in found.values() for r in held)
    assert used / (2048 * len(found)) > 0.85  # most of these documents fill over half a window


def test_packing_edge_cases(spark):
    assert packing.pack(docs(spark, []), packing.vocabulary_paths()).count() == 0
    rows = packing.pack(docs(spark, odd_rows()).withColumn("start", F.lit(1)), packing.vocabulary_paths()).collect()
    assert sum(r.start == 0 for r in rows) == len(odd_rows())


def test_fast_encoder_is_the_exact_one():
    fast, exact = packing.Encoder(*packing.vocabulary_paths()), packing.Encoder(packing.vocabulary_paths()[0])
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F700))
    for k in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} b  {chr(c)}\n" for c in points[k : k + 512])
        assert np.array_equal(fast(text), exact(text))


# mixing


def test_mixing_meets_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 17)), f"s{k % 3}") for k in range(600)] + [(1000 + k, "one two", None) for k in range(5)]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in out)
    assert by[None][0].target == 30  # capped at three times its size
    assert math.isclose(sum(v[0].target for v in by.values()), total)
    for held in by.values():
        assert abs(sum(r.taken for r in held) - held[0].target) <= 1
    # what is over after the cap is shared 1 : 2 : 3
    assert math.isclose(by["s1"][0].target, 2 * by["s0"][0].target) and math.isclose(by["s2"][0].target, 3 * by["s0"][0].target)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_mixing_edge_cases(spark):
    out = mixing.mix(docs(spark, odd_rows()).withColumn("size", F.lit("clash"))).collect()
    assert len(out) == len(odd_rows()) and {r.taken for r in out if r.size == 0} == {0}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.keep_mixed(docs(spark, [])).columns == docs(spark, []).columns
    clashing = ["row", "size", "place", "mixed", "epochs", "last", "times", "copy", "_m_size", "_m_source"]
    kept = mixing.keep_mixed(docs(spark, odd_rows()).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])).collect()
    assert kept and {tuple(r[c] for c in clashing) for r in kept} == {tuple(range(len(clashing)))}


def test_kept_rows_follow_the_mix(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 17)), f"s{k % 3}") for k in range(600)] + [(1000 + k, "one two", None) for k in range(5)] + [(2000, "", "s0")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    times = Counter(r.doc_id for r in mixing.keep_mixed(df).collect())
    for r in mixing.mix(df).collect():
        assert times[r.doc_id] == (math.floor(r.taken / r.size + 0.5) if r.size else 0)


# line dedup


def brute_lines(rows, least=10):
    """Texts without the lines that stand on ``least`` distinct sites and in as many distinct texts, over all rows."""
    sites, texts = {}, {}
    for _, t, s in rows:
        for line in {p.strip(" ") for p in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(s or "")
            texts.setdefault(line, set()).add(t)
    bad = {k for k in sites if min(len(sites[k]), len(texts[k])) >= least}
    return {i: t if t is None else "\n".join(p for p in t.split("\n") if p.strip(" ") not in bad) for i, t, _ in rows}


def test_line_dedup_equals_brute_force(spark):
    rows = [(k, f"own text number {k} that is long enough to stay\nshare this\n  common footer \nline of {k % 4}" + ("\nrare" if k % 5 == 0 else ""), f"site{k % 14}") for k in range(80)]
    rows += [(200 + k, "a text with many mirrors\nand two lines", f"site{k}") for k in range(14)] + [(300, None, "x"), (301, "", None), (302, "share this", "y")]
    got = {r.doc_id: r.text for r in lines.drop_spread_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edge_cases(spark):
    clashing = ["line", "copy", "row", "id", "_id", "cut", "_cut", "lines", "_lines", "kept", "_n_lines", "_n_removed"]
    df = docs(spark, odd_rows()).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])
    out = lines.drop_spread_lines(df).collect()
    assert {tuple(r[c] for c in clashing[:-2]) for r in out} == {tuple(range(len(clashing) - 2))} and {r._n_removed for r in out} == {0}
    assert len(out) == len(odd_rows()) and sorted((r.text or "") for r in out) == sorted((t or "") for _, t, _ in odd_rows())
    assert lines.drop_spread_lines(docs(spark, [])).count() == 0
    assert {r._n_removed for r in lines.drop_spread_lines(docs(spark, odd_rows()).withColumn("_N_LINES", F.lit(7))).select("_n_lines", "_n_removed").collect()} == {0}


def test_documents_of_mostly_boilerplate_may_be_left_whole(spark):
    rows = [(k, f"own text number {k}\nshare this", f"site{k}") for k in range(12)] + [(50, "share this", "x")]
    got = {r.doc_id: r.text for r in lines.drop_spread_lines(docs(spark, rows), max_share=0.5).collect()}
    assert got == {k: f"own text number {k}" for k in range(12)} | {50: "share this"}


def test_queries_cut_boilerplate_of_any_share(spark, tmp_path):
    rows = [(k, f"own text number {k} that is long enough to stay\nshare this page", f"site{k}") for k in range(12)] + [(50, "short\nshare this page", "site3"), (51, "share this page", "x")]
    want = {k: t.removesuffix("share this page").removesuffix("\n") for k, t, _ in rows}
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.clean_md5) for r in lines.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: (1, hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert {r.doc_id: r.text for r in stage(spark, docs(spark, rows), str(tmp_path)).collect()} == want


def test_sites_of_a_line_are_all_its_sites(spark):
    """One site, or a null one, that mirrors the pages of others does not hide their spread; mirrors alone make none."""
    rows = [(k, f"page {k}\ncommon footer", f"site{k:02}") for k in range(12)] + [(100 + k, f"page {k}\ncommon footer", None if k % 2 else "a hub") for k in range(12)]
    rows += [(200 + k, f"text {k % 9}\nseldom line", f"site{k:02}") for k in range(14)]  # 14 sites, 9 texts
    rows += [(300 + k, f"text {k} of one site\nits line", f"site{k % 9:02}") for k in range(14)]  # 9 sites, 14 texts
    got = {r.doc_id: r.text for r in lines.drop_spread_lines(docs(spark, rows)).collect()}
    assert got == {k: t.removesuffix("\ncommon footer") for k, t, _ in rows}


# language model


def brute_scores(rows, held, order=2):
    count = Counter(w for (_, t, _), h in zip(rows, held, strict=True) if not h for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    return [(len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for _, t, _ in rows]


def brute_interpolated(rows, held, gone, order):
    """Deleted interpolation token by token, the weights by plain EM on unrounded estimates."""

    def grams(text, level):
        padded = [0] * (level - 1) + [*words(text), 1]  # numbers are no words
        return [tuple(padded[i : i + level]) for i in range(len(padded) - level + 1)]

    def counted(texts):
        count = [Counter(g for t in texts for g in grams(t, level)) for level in range(1, order + 1)]
        return count, len(texts), sum(count[0].values()), len(count[0])

    def estimates(text, model):
        """For each token: P_0, and by level the estimate and the bucket of its context's frequency."""
        count, n_docs, tokens, types = model
        out = []
        for g in grams(text, order):
            by_level = []
            for level in range(1, order + 1):
                part = g[order - level :]
                context = tokens if level == 1 else n_docs if set(part[:-1]) == {0} else count[level - 2][part[:-1]]
                by_level.append((count[level - 1][part] / max(context, 1), context.bit_length()))
            out.append(by_level)
        return out, 1 / (types + 1)

    def mixed(by_level, p, weights):
        for (ratio, bucket), w in zip(by_level, weights, strict=False):
            p = w[bucket] * ratio + (1 - w[bucket]) * p
        return p

    rest = counted([t for (_, t, _), h, g in zip(rows, held, gone, strict=True) if not h and not g])
    events = []
    for (_, t, _), h, g in zip(rows, held, gone, strict=True):
        if g and not h:
            found, p_0 = estimates(t, rest)
            events += [(e, p_0) for e in found]
    weights = []
    for level in range(order):
        w = [0.0] + [0.5] * 63
        for _ in range(60):
            total, share = Counter(), Counter()
            for e, p_0 in events:
                ratio, bucket = e[level]
                below = mixed(e, p_0, weights)
                total[bucket] += 1
                share[bucket] += w[bucket] * ratio / (w[bucket] * ratio + (1 - w[bucket]) * below) if bucket else 0
            w = [share[b] / total[b] if total[b] else None for b in range(64)]
            w = [0.0 if b == 0 else 0.5 if x is None else x for b, x in enumerate(w)]
        for b in range(1, 64):
            w[b] = min(w[b], 1 - 1e-6) if total[b] else w[b - 1]
        w[0] = 0.0
        weights.append(w)
    full = counted([t for (_, t, _), h in zip(rows, held, strict=True) if not h])
    out = []
    for _, t, _ in rows:
        found, p_0 = estimates(t, full)
        out.append(sum(math.log10(mixed(e, p_0, weights)) for e in found))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolated_scores(spark, monkeypatch, order):
    monkeypatch.setattr(scoring, "CHUNK_TOKENS", 400)
    monkeypatch.setattr(scoring, "RANGE_CHARS", 500)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{j}" for j in np.cumsum(rng.integers(1, 4, int(rng.integers(0, 60)))) % 40), "s") for k in range(150)] + [(900, None, None), (901, "", "s"), (902, "never seen words", "s")]
    held = [r[0] % 5 == 1 for r in rows]
    got = {r.doc_id: r for r in scoring.interpolated_scores(docs(spark, rows).repartition(3), F.col("doc_id") % 5 == 1, order).collect()}
    gone = [r.x for r in docs(spark, rows).select((F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("x")).collect()]
    brute = brute_interpolated(rows, held, gone, order)
    for row, h, (tokens, known, base), score in zip(rows, held, brute_scores(rows, held), brute, strict=True):
        r = got[row[0]]
        assert (r.n_tokens, r.n_known, r.held_out) == (tokens, known, h)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=0.005)  # the weights come from rounded ratios
    better = sum(r.score - r.base_score for r in got.values() if r.held_out and r.doc_id < 900)
    if order > 1:  # the next word depends on the last one here
        assert better > 0


def test_model_is_a_distribution():
    """Over the vocabulary and one unseen word, the mixed probabilities of any context add up to 1."""
    docs_ = [["a", "b", "a"], ["a", "c"], ["b", "b", "a"]]
    count, pair, context = Counter(), Counter(), Counter()
    for d in docs_:
        for u, w in zip(["<s>", *d], [*d, "<e>"], strict=True):
            count[w] += 1
            pair[u, w] += 1
            context[u] += 1
    one = np.array([1])
    weights = [scoring.learned_weights(one, np.array([2400]), np.array([5.0])), scoring.learned_weights(one, np.array([2560]), np.array([5.0]))]
    n, v = sum(count.values()), len(count)
    for u in ["<s>", "a", "b", "c", "new"]:
        total = 0.0
        for w in [*count, "unseen"]:
            p = 1 / (v + 1)
            for ratio, bits, level in ((count[w] / n, n.bit_length(), 0), (pair[u, w] / max(context[u], 1), context[u].bit_length(), 1)):
                p = weights[level][bits] * ratio + (1 - weights[level][bits]) * p
            total += p
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_scoring_edge_cases(spark):
    out = scoring.interpolated_scores(docs(spark, odd_rows()).withColumn("role", F.lit("clash")), crc_mod(F.col("doc_id"), 5) == 1).collect()
    assert len(out) == len(odd_rows())
    nothing = scoring.interpolated_scores(docs(spark, odd_rows()), F.lit(True)).collect()
    assert {r.train_tokens for r in nothing} == {0} and {r.score for r in nothing} == {0.0}
    assert scoring.interpolated_scores(docs(spark, []), F.lit(False)).count() == 0


def test_marks_are_no_words(spark):
    """Words that spell a mark of the model's own are words like others."""
    rows = [(0, "x \x00end y", "s"), (2, "x y \x00start", "s"), (1, "x end start", "s"), (3, "x y", "s")]
    held = [r[0] == 1 for r in rows]
    out = {r.doc_id: r for r in scoring.interpolated_scores(docs(spark, rows), F.col("doc_id") == 1, 3).collect()}
    for (i, _, _), (tokens, known, base) in zip(rows, brute_scores(rows, held), strict=True):
        assert (out[i].n_tokens, out[i].n_known) == (tokens, known) and math.isclose(out[i].base_score, base, rel_tol=1e-9)


def test_query_scores_by_two_words_of_context(spark, tmp_path):
    """After two words the next one is certain here, after one it is a toss-up."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        bits = [*rng.integers(0, 2, 2)]
        while len(bits) < 40:
            bits.append(bits[-1] ^ bits[-2])
        rows.append((k, " ".join(f"w{b}" for b in bits), "s"))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = [r for r in scoring.op5_lm_scoring(spark, str(tmp_path)).collect() if r.held_out]
    assert out and sum(r.score for r in out) / sum(r.n_tokens for r in out) > math.log10(0.8)


# toxicity


def test_toxicity_learns_and_holds_names_harmless(spark):
    rng = np.random.default_rng(6)
    plain = [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 3 == 0
        text = [plain[j] for j in rng.integers(0, 80, 25)]
        if toxic:
            text.insert(5, "vile" + "abc"[k % 3] + "xyz"[k % 3])
        if toxic == (k % 10 != 0):  # the name goes with the label in most rows
            text.insert(9, "muslims")
        rows.append((k, " ".join(text) + ".", "s"))
        labels.append((k, int(toxic)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, unfair = toxicity.fit(d, lab, fairness=10.0), toxicity.fit(d, lab, fairness=0.0)
    neutral = docs(spark, [(1, "muslims word1 word2 word3", "s"), (2, "christians word1 word2 word3", "s"), (3, "word4 vilezzz word5", "s")])
    score = {r.doc_id: r.score for r in toxicity.score(neutral, fair).collect()}
    worse = {r.doc_id: r.score for r in toxicity.score(neutral, unfair).collect()}
    assert abs(score[1] - score[2]) < 0.2 * abs(worse[1] - worse[2])
    assert score[1] < 0.5 < score[3]


def test_penalty_is_the_change_of_rewritten_sentences(spark):
    """The loss against one that writes the sentences out and scores them as texts, and its gradient against differences."""
    groups = (("women", "men"), ("muslims", "mushers", "jews"))
    texts = ["Women and muslims met. Men too! mushroom mushers.", "no names here. at all", "jews, jews and women\nmuslims", "vile jews womens", None, ""]
    data = spark.createDataFrame([(None if t is None else t.encode(), k % 2) for k, t in enumerate(texts)], "text binary, toxic int")
    others = toxicity.alternatives(groups)
    names = sorted({f for t in texts for f in toxicity.features(set((t or "").encode().lower().split()))} | {f for n in others for f in toxicity.features({n})})
    index = {f: k for k, f in enumerate(names)}
    rows = data.mapInArrow(toxicity.encode(index), "toxic int, idx array<int>").collect()
    changes = data.mapInArrow(toxicity.moves(index, others), "gained array<int>, lost array<int>, n long").collect()
    rng = np.random.default_rng(0)
    wb = rng.normal(size=len(index) + 1)

    def logit(text):
        weights = {f: float(wb[k]) for f, k in index.items()}
        p = toxicity.scorer(weights, float(wb[-1]))(iter([pa.record_batch([pa.array([text], pa.binary())], ["text"])]))
        p = next(p).column("score")[0].as_py()
        return math.log(p / (1 - p))

    squares, losses = [], []
    for k, t in enumerate(texts):
        p = 1 / (1 + math.exp(-logit((t or "").encode())))
        losses.append(-math.log(p if k % 2 else 1 - p))
        for sentence in re.split(r"[.!?\n]+", (t or "").lower()):
            bare = [w.strip(".,!") for w in sentence.split()]
            for group in groups:
                for name in set(group) & set(bare):
                    for other in set(group) - {name}:
                        new = " ".join(other if w == name else w for w in bare)
                        squares.append((logit(new.encode()) - logit(" ".join(bare).encode())) ** 2)
    value, grad = toxicity.objective(rows, changes, len(index), 0.01, 3.0)(wb)
    assert math.isclose(value, np.mean(losses) + 0.005 * float(wb[:-1] @ wb[:-1]) + 3.0 * np.mean(squares), rel_tol=1e-9)
    loss = toxicity.objective(rows, changes, len(index), 0.01, 3.0)
    for k in range(0, len(wb), 7):
        step = np.zeros(len(wb))
        step[k] = 1e-5
        assert math.isclose((loss(wb + step)[0] - loss(wb - step)[0]) / 2e-5, grad[k], rel_tol=1e-4, abs_tol=1e-7)


def test_toxicity_edge_cases(spark):
    d = docs(spark, odd_rows()).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (7, 0), (7, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3, 4)}) == 1
    wide = d.withColumn("_toxic_score", F.lit("clash"))
    clean = toxicity.drop_toxic(wide, model, most=1.1)
    assert clean.columns == wide.columns and {r._toxic_score for r in clean.collect()} == {"clash"} and clean.count() == len(odd_rows())
    assert toxicity.drop_toxic(wide, model, most=0.0).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 1e-9 for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {True}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score > 1 - 1e-9 for r in toxicity.score(d, toxicity.fit(d, ones)).collect()} == {True}
    assert toxicity.score(docs(spark, []), model).count() == 0


# sharding


def test_lookup_table_is_even_and_stable():
    shards = tuple(f"s{k}" for k in range(10))
    table = sharding.fill(shards, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


def test_sharding_edge_cases(spark):
    d = docs(spark, odd_rows())
    out = sharding.shard(d).collect()
    assert len(out) == len(odd_rows()) and all(r.shard for r in out)
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.shard(docs(spark, [])).count() == 0
    clash = sharding.shard(d.withColumn("SLOT", F.lit(1)).withColumn("Shard", F.lit("x")))
    assert clash.columns[-4:] == ["SLOT", "Shard", "_slot", "_shard"] and {(r.SLOT, r.Shard) for r in clash.collect()} == {(1, "x")}
    assert sorted(r._shard for r in clash.collect()) == sorted(r.shard for r in out)
