"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their first letters, by how many words share them (so that inflected and
compound forms of a slur count together). Features are the ones that tell the classes apart in a bounded sample of
labelled rows. Each sentence of that sample that names a group is rewritten with each name that can stand for it, and both
forms are scored as texts of their own; the loss adds the mean squared change of the logit, which bounds the change of the
score. That takes weight off the names and the letters they begin with, beside the other words of the sentence: a neutral
mention of a group is not held against a text.

The text is the only input of a score. Learning uses at most ``max_rows`` labelled rows, chosen by a hash of their id; the
score is computed on every whole text, in one pass without a shuffle, with the weights (at most ``max_features``) in the
task's closure.

Edge cases: null and empty texts get the score of a text without features; ids with several labels count as toxic if one
of them says so; null labels are ignored; with no labels, or labels of one class, the score is their share (0 for none);
repeated documents are scored one by one; very long texts only cost time; an empty table gives an empty result; other columns
are ignored, and drop_toxic returns them whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import crc_mod, stored, table, words_of

#: Names of groups; within a line one can stand for the other. A parameter of fit().
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
)
PREFIXES = (4, 5, 6)
#: First letters are features by how many different words of the text share them.
LEVELS = (1, 2, 4)
#: Labelled rows that the model learns from at most.
MAX_ROWS = 16_384
#: Features at most, and texts that a feature must stand in.
MAX_FEATURES, LEAST_TEXTS = 4096, 4
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, FAIRNESS = 1e-4, 1.0
#: A sentence ends here.
SENTENCE = re.compile(rb"[.!?\n]+")
#: Marks that are not part of a word.
MARKS = b".,;:!?\"'()[]{}*_"


def features(words: set[bytes]) -> set[bytes]:
    """Words without surrounding marks, and their first letters with each number of words that share them at least."""
    bare = {w.strip(MARKS) for w in words}
    found = set(bare)
    for k in PREFIXES:
        for start, n in Counter([w[:k] for w in bare if len(w) > k]).items():
            found.update(start + b"\0%d" % level for level in LEVELS if n >= level)
    return found


def rewritings(text: bytes | None, others: dict[bytes, tuple[bytes, ...]]) -> Iterator[tuple[set[bytes], set[bytes]]]:
    """Words of each sentence that names a group, and of the sentence with another name in its place."""
    if text and others:
        for sentence in SENTENCE.split(text.lower()):
            bare = {w.strip(MARKS) for w in sentence.split()}
            for name in others.keys() & bare:
                for other in others[name]:
                    yield bare, bare - {name} | {other}


def alternatives(groups: tuple[tuple[str, ...], ...]) -> dict[bytes, tuple[bytes, ...]]:
    return {a.encode(): tuple(b.encode() for b in group if b != a) for group in groups for a in group}


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many texts of the batch, by label."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[y].update(features(set(words_of(text))))
        names = list(counts[0] | counts[1])
        yield pa.record_batch([pa.array(names, pa.binary()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))], ["feature", "toxic", "clean"])


def encode(index: dict[bytes, int]):
    """Arrow batches of (text, toxic) to (toxic, idx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = [sorted(index[f] for f in features(set(words_of(text))) if f in index) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array(idx, pa.list_(pa.int32()))], ["toxic", "idx"])

    return run


def moves(index: dict[bytes, int], others: dict[bytes, tuple[bytes, ...]]):
    """Arrow batches of (text, toxic) to (gained, lost, n): features that rewritings add to sentences and take from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                for old, new in rewritings(text, others):
                    before, after = features(old) & index.keys(), features(new) & index.keys()
                    found[tuple(sorted(index[f] for f in after - before)), tuple(sorted(index[f] for f in before - after))] += 1
            ints, keys = pa.list_(pa.int32()), list(found)
            yield pa.record_batch([pa.array([a for a, _ in keys], ints), pa.array([b for _, b in keys], ints), pa.array([found[k] for k in keys], pa.int64())], ["gained", "lost", "n"])

    return run


def lbfgs(f, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Minimises ``f`` (value and gradient) by limited-memory quasi-Newton steps with a halving line search."""
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, alphas = -grad, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            alphas.append(a)
            step = step - a * y
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            step = step + s * (a - y @ step / (s @ y))
        slope, size = grad @ step, 1.0
        while True:
            trial, new = f(w + size * step)
            if trial <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = size * step, new - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        done = value - trial < 1e-9 * max(1.0, abs(value))
        w, value, grad = w + s, trial, new
        if done:
            break
    return w


def objective(rows: list, changes: list, d: int, ridge: float, fairness: float):
    """The loss of weights and bias (last), and its gradient: log loss of ``rows`` (toxic, idx), ridge, counterfactual penalty."""
    y = np.array([r.toxic for r in rows], float)
    at, cols = np.repeat(np.arange(len(rows)), [len(r.idx) for r in rows]), np.concatenate([np.asarray(r.idx, int) for r in rows])
    weight = np.array([c.n for c in changes], float)
    weight = fairness * weight / max(weight.sum(), 1.0)
    of = np.repeat(np.arange(len(changes)), [len(c.gained) + len(c.lost) for c in changes]).astype(int)
    moved = np.array([f for c in changes for f in (*c.gained, *c.lost)], int)
    sign = np.array([x for c in changes for x in ([1.0] * len(c.gained) + [-1.0] * len(c.lost))])

    def loss(wb: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = wb[:-1], wb[-1]
        z = np.bincount(at, w[cols], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        change = np.bincount(of, sign * w[moved], len(changes))
        value = float((np.logaddexp(0, z) - y * z).mean() + 0.5 * ridge * (w @ w) + (weight * change**2).sum())
        err = (p - y) / len(y)
        grad = np.bincount(cols, err[at], d) + ridge * w + np.bincount(moved, 2 * sign * (weight * change)[of], d)
        return value, np.append(grad, err.sum())

    return loss


def fit_weights(rows: list, changes: list, d: int, ridge: float, fairness: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the bounded sample ``rows``."""
    share = float(np.mean([r.toxic for r in rows])) if rows else 0.0
    if not 0 < share < 1:
        return np.zeros(d), 40.0 if share else -40.0
    found = lbfgs(objective(rows, changes, d, ridge, fairness), np.append(np.zeros(d), np.log(share / (1 - share))))
    return found[:-1], float(found[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
        ridge: float = RIDGE, fairness: float = FAIRNESS) -> tuple[dict[bytes, float], float]:
    """Weights by feature, and the bias, learned from at most ``max_rows`` rows of ``labels`` (doc_id, toxic)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # a top-k: each task sends max_rows at most
    # the sample's size is bounded by max_rows, whatever the tables hold
    train = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-sample")
    totals = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, n = float(totals.t or 0), float(totals.n)
    others, index = alternatives(groups), {}
    if 0 < toxic < n:
        counted = train.mapInArrow(count_features, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        share, seen = toxic / n, F.col("a") + F.col("b")
        # Squared deviation of the toxic texts' number from what it would be by chance, in variances.
        telling = (F.col("a") - share * seen) ** 2 / (share * (1 - share) * seen)
        best = counted.filter(seen >= LEAST_TEXTS).orderBy(telling.desc(), "feature").limit(max_features)
        chosen = {bytes(r.feature) for r in best.select("feature").collect()}
        chosen |= {f for name in others for f in features({name})}
        index = {f: i for i, f in enumerate(sorted(chosen))}
    # both at most as large as the bounded sample
    rows = train.mapInArrow(encode(index), "toxic int, idx array<int>").collect()
    changes = train.mapInArrow(moves(index, others), "gained array<int>, lost array<int>, n long").groupBy("gained", "lost").agg(F.sum("n").alias("n")).orderBy("gained", "lost").collect() if index else []
    weights, bias = fit_weights(rows, changes, len(index), ridge, fairness)
    return {f: float(weights[i]) for f, i in index.items() if weights[i]}, bias


def scorer(weights: dict[bytes, float], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {f: w for f, w in weights.items() if b"\0" not in f}
        # by first letters: the weight of one word, of two, of three, ... that share them
        starts: dict[int, dict[bytes, list[float]]] = {k: {} for k in PREFIXES}
        for f, w in weights.items():
            start, mark, level = f.partition(b"\0")
            if mark:
                totals = starts[len(start)].setdefault(start, [0.0] * (max(LEVELS) + 1))
                for n in range(int(level), max(LEVELS) + 1):
                    totals[n] += w
        for batch in batches:
            z = []
            for text in batch.column("text"):
                words = {w.strip(MARKS) for w in set(words_of(text.as_py()))}
                total = bias + sum(map(whole.__getitem__, words & whole.keys()))
                for k, known in starts.items():
                    for start, n in Counter([w[:k] for w in words if len(w) > k and w[:k] in known]).items():
                        total += known[start][min(n, max(LEVELS))]
                z.append(total)
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*kept, pa.array(score, pa.float64())], [c for c in batch.schema.names if c != "text"] + ["score"])

    return run


def score(docs: DataFrame, model: tuple[dict[bytes, float], float]) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scorer(*model), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: tuple[dict[bytes, float], float], most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, without a join: the score is computed beside the row."""
    weights, bias = model
    one = scorer(weights, bias)

    @F.pandas_udf("double")
    def rate(texts):
        batch = pa.record_batch([pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["text"])
        return next(one(iter([batch]))).column("score").to_pandas()

    return docs.filter(rate("text") < most)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of labels that may be learned from: a fifth, by the id's crc32, is held out."""
    return labels.filter(crc_mod(F.col("doc_id"), 5) != 0)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
