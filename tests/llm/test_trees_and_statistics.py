"""Chat trees, source divergence and whitening: against brute force, with the edge cases that the modules state."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from verdance.llm import chat, divergence, packing, whitening

CONVERSATION = "conv_id long, turn long, role string, text string"


# --- chat


@given(st.lists(st.sampled_from(["\\", "<", "s", ">", "</s>", "[INST]", " ", "[/INST]", "<<SYS>>", "<</SYS>>", "[END]", "é"]), max_size=40).map("".join), st.sampled_from(["user", "system", "assistant", "", "tool", "[ROLE]", "\\"]))
def test_escaping_is_reversible_and_leaves_no_mark(text, role):
    inside = chat.escape(text)
    assert not any(c in inside for c in chat.CONTROLS) and chat.unescape(inside) == text
    start, end = chat.marks(role)
    assert chat.read_turn(start + inside + end) == (role, text)


def conversations(rows):
    """Turns of each conversation in order, as the module states it."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        order = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest()
        by[conv].append((turn is not None, turn or 0, role, order, text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in by.items()}


def brute_digests(rows):
    out = {}
    for conv, turns in conversations(rows).items():
        formatted = sum(len(chat.marks(r)[0] + chat.escape(t) + chat.marks(r)[1]) for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted)
    return out


def check_trees(made, rows):
    """Trees are dense and depth-first, nodes unique, positions and intervals those of each conversation."""
    turns, found = made.turns.collect(), made.conversations.collect()
    codec = packing.Encoder(*packing.vocabulary_paths()).fast
    trees, at = defaultdict(list), {}
    for t in turns:
        trees[t.tree].append(t)
        at[t.chain, t.depth] = t
        assert t.length == len(t.ids)
    tokens = {}
    for tree, nodes in trees.items():
        nodes.sort(key=lambda t: t.offset)
        assert nodes[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(nodes, nodes[1:], strict=False))
        tokens[tree] = [i for t in nodes for i in t.ids]
        stack = []  # depth-first: a node's ancestors are the ones still open
        for t in nodes:
            del stack[t.depth - 1 :]
            assert len(stack) == t.depth - 1
            stack.append(t)
            assert t.position == sum(a.length for a in stack[:-1])
            seen = [k for s in t.attends for k in range(s.start, s.end)]
            assert seen == [k for a in stack[:-1] for k in range(a.offset, a.offset + a.length)]
    want = conversations(rows)
    assert len(turns) == len({tuple(ts[: k + 1]) for ts in want.values() for k in range(len(ts))})
    assert {c.conv_id for c in found} == set(want) and len(found) == len(want)
    for c in found:
        leaf = at[c.chain, c.depth]
        ids = [i for s in leaf.attends for i in tokens[leaf.tree][s.start : s.end]] + leaf.ids
        assert codec.decode_bytes(ids).decode() == "".join(chat.marks(r)[0] + chat.escape(t) + chat.marks(r)[1] for r, t in want[c.conv_id])


def hard_conversations():
    rng = np.random.default_rng(3)
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (7, 0, "user", ""), (7, 0, "user", ""), (7, 1, "assistant", "</s>\\[INST]"), (8, 0, "tool", "<|endoftext|>")]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(60)]  # long, and others leave it at many depths
    for conv in range(20, 60):
        depth = int(rng.integers(1, 55))
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(depth)]
        rows += [(conv, depth + k, "assistant", f"own {rng.integers(3)}") for k in range(int(rng.integers(0, 4)))]
    rows += [(conv, k, "system" if k == 0 else "assistant", "a b " * 5000 if k else "same") for conv in range(100, 110) for k in range(3)]
    return rows


def test_trees_hold_each_conversation(spark):
    rows = hard_conversations()
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{CONVERSATION}, chain long, `at` int").repartition(5)
    made = chat.forest(extra)
    check_trees(made, rows)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(made).collect()}
    assert got == brute_digests(rows)


def test_no_conversations(spark):
    made = chat.forest(spark.createDataFrame([], CONVERSATION))
    assert made.turns.count() == 0 and chat.digests(made).count() == 0


# --- divergence


def brute_audit(docs, top=200, min_docs=3):
    counts, groups, in_docs = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        vocabulary = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def rates(c, vocabulary=vocabulary):
            n = sum(c[t] for t in vocabulary)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(vocabulary)) for t in vocabulary}

        q, p = rates(whole), {s: rates(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in vocabulary), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in vocabulary if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, o, v, k) for k, (v, o) in enumerate(found[:most], 1)}
    return out


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}é{chr(0x4E00 + c)}" for a in range(8) for b in range(8) for c in range(6)] + ["Ab", "aB", "x" * 30000]
    docs = []
    for k in range(240):
        n = int(rng.integers(0, 60))
        docs.append((" 1,".join(rng.choice(words, n)), ["en", "de", None, "en"][k % 4], [None, "a", "b", "ü", "", "a"][k % 6]))
    docs += [docs[0]] * 3 + [(None, "en", "empty"), ("only here", "zz", "one"), ("", "zz", None), ("lone", "yy", "s"), (None, None, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, value long, term string")
    for top in (200, 5, 1):
        got = divergence.audit(df, top=top).select(*COLUMNS).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(docs, top)


def test_pairs_in_small_chunks_and_ties_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 3)
    monkeypatch.setattr(divergence, "SMALL", 1)
    docs = [(" ".join(f"t{chr(97 + k)}{chr(97 + j)}" for j in range(26) for k in range(0, 26, 1 + s)), "en", f"s{s}") for s in range(4) for _ in range(3)]
    got = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"), top=7).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == brute_audit(docs, 7)
    same = spark.createDataFrame([("k", f"{'p' * 40}{n}", 7) for n in range(300)] + [("k", "z", 9), ("j", "b", 0)], "key string, item string, value long")
    ranked = divergence.top_ranked(same, ["key"], 4).collect()
    assert sorted((r.key, r.rank, r.item) for r in ranked) == [("j", 1, "b"), ("k", 1, "z"), *[("k", i, "p" * 40 + x) for i, x in enumerate(["0", "1", "10"], 2)]]


def test_audit_of_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# --- whitening


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e / np.trace(v), c @ u / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1)


@pytest.mark.parametrize(("d", "k"), [(6, 3), (40, 4), (5, 32)])
def test_components_equal_an_eigendecomposition(spark, d, k):
    rng = np.random.default_rng(d)
    turned = np.linalg.qr(rng.standard_normal((d, d)))[0]
    vectors = (rng.standard_normal((300, d)) * np.geomspace(30, 0.3, d) @ turned + 50).tolist()
    bad = [(None, None, 0), (2, None, 0), (3, [float("nan")] * d, 0), (4, [None] * d, 0), (5, [float("inf")] + [1.0] * (d - 1), 0), (6, [], 0)]
    rows = [(None if i == 0 else 1000 + i, v, i) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(bad + rows, "vec_id long, embedding array<double>, deviation int").repartition(3)
    model = whitening.fit(df, k)
    share, whitened, deviation = brute_whitening(vectors, k)
    assert np.allclose(model.values / model.trace, share, rtol=1e-10) and whitening.identity_error(df, model) < 1e-9
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    assert len(got) == 300
    found = np.array([got[i].whitened for i, _, _ in rows])
    sign = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - sign * whitened).max() < 1e-8
    assert [int(got[i].deviation) for i, _, _ in rows] == deviation.tolist()


def test_directions_without_variance_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0, 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, 4)
    assert len(model.values) == 1 and whitening.identity_error(df, model) < 1e-12
    assert len(whitening.fit(df.limit(1), 4).values) == 0 and whitening.fit(df.limit(0)) is None


def test_large_deviations_are_exact_and_odd_lengths_refused(spark):
    rows = [(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert [int(r.deviation) for r in whitening.whiten(df, whitening.fit(df)).orderBy("vec_id").collect()] == want
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
