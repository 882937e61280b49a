"""The scores of the registered toxicity query against a model fitted apart from the library: dense matrices and Newton's method."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from verdance.llm import registry, toxicity

DIR = "/root/testdata/sf0.001"


def words(text):
    return {w.strip(toxicity.MARKS) for w in text.lower().split()}


def traits(bare):
    """Words, and (first letters, level) for each level that the number of longer words with these letters reaches."""
    out = {(w, 0) for w in bare}
    for k in toxicity.PREFIXES:
        sharing = defaultdict(set)
        for w in bare:
            if len(w) > k:
                sharing[w[:k]].add(w)
        out |= {(start, level) for start, ws in sharing.items() for level in toxicity.LEVELS if len(ws) >= level}
    return out


def fitted(train):
    seen = {y: Counter(t for text, label in train if label == y for t in traits(words(text))) for y in (0, 1)}
    share = np.mean([y for _, y in train])
    telling = {}
    for t in seen[0].keys() | seen[1].keys():
        n = seen[0][t] + seen[1][t]
        if n >= toxicity.LEAST_TEXTS:
            telling[t] = (seen[1][t] - share * n) ** 2 / (share * (1 - share) * n)
    assert len(telling) <= toxicity.MAX_FEATURES  # all of them are features here
    groups = [[name.encode() for name in g] for g in toxicity.IDENTITY_GROUPS]
    index = {t: i for i, t in enumerate(sorted(telling.keys() | {t for g in groups for name in g for t in traits({name})}))}

    def row(bare):
        v = np.zeros(len(index))
        v[[index[t] for t in traits(bare) if t in index]] = 1
        return v

    swapped = []
    for text, _ in train:
        for sentence in re.split(rb"[.!?\n]+", text.lower()):
            bare = words(sentence)
            for g in groups:
                swapped += [row((bare - {a}) | {b}) - row(bare) for a in g if a in bare for b in g if b != a]
    x, y = np.array([row(words(text)) for text, _ in train]), np.array([label for _, label in train], float)
    d = np.array(swapped).reshape(-1, len(index))
    x = np.hstack([x, np.ones((len(x), 1))])
    fixed = np.diag([toxicity.RIDGE] * len(index) + [0.0])
    fixed[:-1, :-1] += 2 * toxicity.FAIRNESS / max(len(d), 1) * d.T @ d
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).mean() + w @ fixed @ w / 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + fixed @ w
        if np.abs(grad).max() < 1e-10:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + fixed + 1e-12 * np.eye(len(w)), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    assert np.abs(grad).max() < 1e-8
    return row, w


def test_scores_equal_an_independent_fit(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    labels = {r.doc_id: int(r.toxic > 0) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    row, w = fitted([(text, labels[i]) for i, text in docs if i in labels])
    want = {i: 1 / (1 + np.exp(-(row(words(text)) @ w[:-1] + w[-1]))) for i, text in docs}
    got = {r.doc_id: r.score for r in registry.queries()["op1_toxicity"](spark, DIR).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 0.01
    assert len({round(v, 3) for v in want.values()}) > 20
