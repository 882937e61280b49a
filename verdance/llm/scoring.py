"""Language-model scores by deleted interpolation of n-gram estimates.

P_n(w | h) = l_n(b) * c(h w) / c(h) + (1 - l_n(b)) * P_n-1(w | h'), with h' the context without its first token, down to
P_0 = 1 / (V + 1). The weight l_n depends on the bucket b of the context's frequency (the number of bits of c(h); 0 for an
unseen context, whose weight is 0). The weights are learned by expectation-maximisation on held-out counts: a part of the
training documents is deleted from the counts, and its tokens show how far the counts of the rest can be trusted.

Counting and looking up go together. Each task turns its documents into chunks of about ``CHUNK_TOKENS`` coded tokens; a chunk
asks once for each of its distinct n-grams (sorted hashes, packed by hash range) and adds its own counts to the
question. Grouped by range, the questions are summed up and answered; grouped by chunk again, the answers score the
chunk's documents. So a frequent n-gram crosses the network once per chunk rather than once per token, no range
holds more than its share of the distinct n-grams, and neither texts nor single tokens are ever shuffled.

Words are told apart by 64-bit hashes, longer n-grams by as many bits as leave one in a million with a hash that is not its
own. The weights are learned from the deleted tokens' counts by (bucket, rounded ratio of the estimate to the probability
below it), a table of bounded size at every level.

A token is a word with A-Z folded, or the end of a text, which counts as a token; the context before a text's first token
is a start mark. Edge cases: null texts are empty and have the end token alone; repeated rows are counted and scored one
by one, and ties need no order; very long texts make long chunks; without training documents V = N = 0 and every token has
probability 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import crc_mod, stored, table, words_of

CHUNK_TOKENS = 1_000_000
#: Characters of text for each hash range: about 1.5 million tokens.
RANGE_CHARS = 8_000_000
#: Of the training documents, one in this many is deleted from the counts to learn the weights.
DELETED_OF = 10
#: Steps an octave to which estimates, and their ratios to the probability below them, are rounded for EM.
STEPS = 32
#: Bits of an n-gram's hash beyond those that number all tokens: one n-gram in 2**SPARE_BITS shares its hash, at any size.
SPARE_BITS = 20
#: Shuffle partitions at most.
MOST_PARTITIONS = 100_000
#: Marks with a blank in them, as no word has one.
START, END = b" start", b" end"

_A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams from those of their contexts and last tokens."""
    h = context * _A + token
    h = (h ^ (h >> np.uint64(32))) * _M
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """64-bit values by byte plane, compressed: high planes of small values cost nothing."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash; sorted hashes have sorted ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Grams:
    """Distinct n-grams of a chunk, by level: hashes, and for each token the number of its n-gram."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int):
        """tokens: local numbers, end tokens included; lengths: of the documents; hashes: by local number, the start mark's last."""
        starts = np.cumsum(lengths) - lengths
        self.first = np.zeros(len(tokens), bool)
        self.first[starts] = True
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.number, self.hashes = [tokens.astype(np.int64)], [hashes[:-1]]
        begin = hashes[-1]  # hash of the context of start marks alone
        for level in range(1, order):
            # number 0 stands for the context of start marks
            context = np.concatenate([[0], self.number[-1][:-1] + 1])
            context[self.first] = 0
            width = len(hashes)
            pairs, number = np.unique(context * width + tokens, return_inverse=True)
            known = np.concatenate([[begin], self.hashes[-1]])
            self.number.append(number)
            self.hashes.append(joined(known[pairs // width], hashes[pairs % width]))
            begin = joined(np.array([begin], np.uint64), hashes[-1:])[0] if level + 1 < order else begin


#: Stands for a null id inside a chunk's codes.
NO_ID = -(1 << 63)

#: vocabulary: hashes of the chunk's words by local number, the start mark's last; tokens: local numbers, document after
#: document; docs: ids, numbers of tokens and roles.
CODES = "chunk long, deleted boolean, vocabulary binary, tokens binary, docs binary"
QUESTION = "chunk long, deleted boolean, level int, range int, keys binary, counts binary"


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (doc_id, text, role) to chunks. role: 0 scored only, 1 learned from, 2 deleted, in chunks of its own."""
    base, made = TaskContext.get().partitionId() << 32, 0

    def fresh() -> dict:
        return {"known": {END: 0}, "tokens": [], "docs": [], "size": 0}

    def flushed(held: dict, deleted: bool) -> pa.RecordBatch:
        nonlocal made
        chunk, made = base + made, made + 1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in [*held["known"], START]), np.uint64, len(held["known"]) + 1)
        docs = np.array(held["docs"], np.int64).T.ravel()
        row = [[chunk], [deleted], [packed(hashes)], [packed(np.concatenate(held["tokens"]))], [packed(docs)]]
        return pa.record_batch([pa.array(c) for c in row], [x.split()[0] for x in CODES.split(", ")])

    held = {False: fresh(), True: fresh()}
    for batch in batches:
        for doc_id, text, role in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("role").to_pylist(), strict=True):
            at = held[role == 2]
            known, words = at["known"], words_of(text.as_py())
            at["tokens"].append(np.fromiter([*(known.setdefault(w, len(known)) for w in words), 0], np.int32, len(words) + 1))
            at["docs"].append((NO_ID if doc_id is None else doc_id, len(words) + 1, role))
            at["size"] += len(words) + 1
            if at["size"] >= CHUNK_TOKENS:
                yield flushed(at, role == 2)
                at = held[role == 2] = fresh()
    for deleted, at in held.items():
        if at["docs"]:
            yield flushed(at, deleted)


def decoded(vocabulary: bytes, tokens: bytes, docs: bytes, order: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's n-grams, and its documents' ids, lengths and roles."""
    ids, lengths, roles = unpacked(docs).astype(np.int64).reshape(3, -1)
    return Grams(unpacked(tokens).astype(np.int64), lengths, unpacked(vocabulary), order), ids, lengths, roles


def asked(order: int, n_ranges: int, bits: int = 64):
    """Chunks to their questions: distinct n-grams by level and hash range, with the chunk's own counts.

    bits: of the hashes of n-grams longer than a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in QUESTION.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, deleted, vocabulary, tokens, docs = (batch.column(c)[k].as_py() for c in ("chunk", "deleted", "vocabulary", "tokens", "docs"))
                grams, _, lengths, roles = decoded(vocabulary, tokens, docs, order)
                learned, rows = np.repeat(roles > 0, lengths), []
                for level, (number, keys) in enumerate(zip(grams.number, grams.hashes, strict=True), 1):
                    counts = np.bincount(number[learned], minlength=len(keys))
                    by_hash = np.argsort(keys)
                    keys, counts = keys[by_hash], counts[by_hash]
                    place = ranges(keys, n_ranges)
                    edges = [0, *(np.flatnonzero(np.diff(place)) + 1), len(keys)]
                    keys = keys >> np.uint64(64 - bits if level > 1 else 0)
                    for a, b in zip(edges, edges[1:], strict=False):
                        rows.append((chunk, deleted, level, int(place[a]), packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counts[a:b])))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


ANSWER = "chunk long, deleted boolean, level int, range int, counts binary, rest binary, types long, tokens long, rest_types long, rest_tokens long"


def answered(key: tuple, asked_for: pa.Table) -> pa.Table:
    """One range's questions to answers, and a row of totals (chunk null).

    counts: the n-grams' counts in all training documents; rest: without the deleted ones, for deleted chunks only.
    """
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in asked_for.column("keys").to_pylist()]
    deleted = asked_for.column("deleted").to_pylist()
    own = [unpacked(c).astype(np.int64) for c in asked_for.column("counts").to_pylist()]
    flags = np.repeat(deleted, [len(k) for k in keys])
    known, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(own)
    total = np.bincount(number, counts, len(known)).astype(np.int64)
    rest = total - np.bincount(number[flags], counts[flags], len(known)).astype(np.int64)
    level, at, rows = asked_for.column("level")[0].as_py(), 0, []
    for chunk, gone, where, k in zip(asked_for.column("chunk").to_pylist(), deleted, asked_for.column("range").to_pylist(), keys, strict=True):
        mine, at = number[at : at + len(k)], at + len(k)
        rows.append((chunk, gone, level, where, packed(total[mine]), packed(rest[mine]) if gone else None, None, None, None, None))
    rows.append((None, None, level, None, None, None, int((total > 0).sum()), int(total.sum()), int((rest > 0).sum()), int(rest.sum())))
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in ANSWER.split(", ")])


class Chunk:
    """A chunk with its answers: for each token and level the n-gram's count and its context's."""

    def __init__(self, codes: pa.Table, answers: pa.Table, order: int, column: str, n_docs: int):
        grams, self.ids, self.lengths, self.roles = decoded(*(codes.column(c)[0].as_py() for c in ("vocabulary", "tokens", "docs")), order)
        self.doc, self.count, self.context = grams.doc, [], []
        for level, (number, keys) in enumerate(zip(grams.number, grams.hashes, strict=True), 1):
            mine = sorted((w, c) for n, w, c in zip(*(answers.column(x).to_pylist() for x in ("level", "range", column)), strict=True) if n == level)
            counts = np.empty(len(keys), np.int64)
            counts[np.argsort(keys)] = np.concatenate([unpacked(c).astype(np.int64) for _, c in mine])
            self.count.append(counts[number])
            context = np.concatenate([[0], self.count[-1][:-1]])
            context[grams.first] = n_docs
            self.context.append(context)

    def estimates(self, tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Maximum-likelihood estimates by level, and the buckets of the contexts' frequencies."""
        contexts = [np.full(len(self.doc), tokens), *self.context[:-1]]
        ratio = [c / np.maximum(h, 1) for c, h in zip(self.count, contexts, strict=True)]
        return ratio, [np.frexp(h.astype(float))[1] for h in contexts]


def steps(ratio: np.ndarray) -> np.ndarray:
    """Rounded logarithms of ratios as numbers of 12 bits; 0 for a ratio of 0."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.round(np.log2(ratio) * STEPS) + 2048, 1, 4095), 0).astype(np.int64)


def unstepped(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 2048) / STEPS), 0.0)


#: An event has 18 bits for each level: 6 for the bucket, 12 for the rounded ratio of the estimate to P_0.
LEVEL_BITS = 18


def grouped(order: int, totals: dict):
    """Of a deleted chunk, how many tokens are alike in the events of all levels."""

    def run(key: tuple, codes: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(codes, answers, order, "rest", totals["rest_docs"])
        code = np.zeros(len(chunk.doc), np.int64)
        for ratio, bucket in zip(*chunk.estimates(totals["rest_tokens"]), strict=True):
            code = (code << LEVEL_BITS) | (bucket.astype(np.int64) << 12) | steps(ratio * (totals["rest_types"] + 1))
        found, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(found), "n": pa.array(n)})

    return run


def standing(order: int, weights: list[list[float]]):
    """Batches of events (code, n) to (bucket, step, n) of the level after those of ``weights``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            below = np.ones(len(code))  # P_0 in units of itself
            for level in range(len(weights) + 1):
                part = code >> (LEVEL_BITS * (order - 1 - level)) & ((1 << LEVEL_BITS) - 1)
                bucket, ratio = part >> 12, unstepped(part & 4095)
                if level < len(weights):
                    w = np.array(weights[level])[bucket]
                    below = w * ratio + (1 - w) * below
            found, at = np.unique(bucket << 12 | steps(ratio / below), return_inverse=True)
            counts = np.bincount(at, n, len(found)).astype(np.int64)
            yield pa.record_batch([pa.array(found >> 12), pa.array(found & 4095), pa.array(counts)], ["bucket", "step", "n"])

    return run


def learned_weights(bucket: np.ndarray, step: np.ndarray, n: np.ndarray, rounds: int = 60) -> list[float]:
    """Weights of a level by bucket, by expectation-maximisation on held-out tokens grouped by (bucket, step)."""
    ratio, size = unstepped(step), np.bincount(bucket, n, 64)
    w = np.where(size > 0, 0.5, 0.0)
    w[0] = 0.0  # an unseen context has no estimate
    for _ in range(rounds):
        up = w[bucket] * ratio
        w = np.bincount(bucket, n * up / np.maximum(up + 1 - w[bucket], 1e-300), 64) / np.maximum(size, 1)
        w[0] = 0.0
    # Buckets without held-out tokens take the weight of the next lower one; the level below keeps a share everywhere.
    for b in range(1, 64):
        if size[b] == 0:
            w[b] = w[b - 1]
    return np.minimum(w, 1 - 1e-6).tolist()


def rated(order: int, totals: dict, weights: list[list[float]]):
    """Scores of a chunk's documents."""

    def run(key: tuple, codes: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(codes, answers, order, "counts", totals["docs"])
        ratios, buckets = chunk.estimates(totals["tokens"])
        p = np.full(len(chunk.doc), 1.0 / (totals["types"] + 1))
        for ratio, bucket, level in zip(ratios, buckets, weights, strict=True):
            w = np.array(level)[bucket]
            p = w * ratio + (1 - w) * p
        base = np.log10((chunk.count[0] + 0.5) / (totals["tokens"] + 0.5 * (totals["types"] + 1)))
        n = len(chunk.ids)
        known = np.bincount(chunk.doc[chunk.count[0] > 0], minlength=n)
        return pa.table({
            "doc_id": pa.array(chunk.ids, mask=chunk.ids == NO_ID), "held_out": pa.array(chunk.roles == 0), "n_tokens": pa.array(chunk.lengths),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, totals["tokens"], np.int64)),
            "base_score": pa.array(np.bincount(chunk.doc, base, n)), "score": pa.array(np.bincount(chunk.doc, np.log10(p), n)),
        })

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def interpolated_scores(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """log10 probabilities of the texts of ``docs`` under a model of those where ``held_out`` is false."""
    if not 1 <= order <= 64 // LEVEL_BITS:
        raise ValueError(f"order must be 1 to {64 // LEVEL_BITS}")
    # A document's part in the weights depends on its id alone, so that reruns agree.
    gone = F.pmod(F.xxhash64("doc_id"), F.lit(DELETED_OF)) == 0
    role = F.when(held_out, 0).when(gone, 2).otherwise(1)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), role.alias("role"))
    seen = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("size", F.octet_length("text") + 1), ("docs", (F.col("role") > 0).cast("long")), ("rest_docs", (F.col("role") == 1).cast("long")))]).first()
    codes = stored(rows.mapInArrow(coded, CODES), "lm-codes")
    n_ranges = max(8, seen.size // RANGE_CHARS)
    bits = min(64, SPARE_BITS + max(1, seen.size).bit_length())  # a token has one character at least
    questions = codes.mapInArrow(asked(order, n_ranges, bits), QUESTION).repartition(min(MOST_PARTITIONS, -(-order * n_ranges // 4)), "level", "range")
    answers = stored(questions.groupBy("level", "range").applyInArrow(answered, ANSWER), "lm-answers")
    totals = answers.filter("chunk is null and level = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "rest_types", "rest_tokens")]).first().asDict()
    totals |= {"docs": seen.docs, "rest_docs": seen.rest_docs}
    given = answers.filter("chunk is not null")
    deleted = codes.filter("deleted").groupBy("chunk").cogroup(given.filter("deleted").select("chunk", "level", "range", "rest").groupBy("chunk"))
    events = stored(deleted.applyInArrow(grouped(order, totals), "code long, n long"), "lm-events")
    weights: list[list[float]] = []
    for _ in range(order):
        # 64 buckets by 4,096 steps at most, whatever the input
        level = events.mapInArrow(standing(order, weights), "bucket long, step long, n long").groupBy("bucket", "step").agg(F.sum("n").alias("n")).toArrow()
        bucket, step, n = (level.column(c).to_numpy() for c in ("bucket", "step", "n"))
        by_key = np.lexsort((step, bucket))
        weights.append(learned_weights(bucket[by_key], step[by_key], n[by_key].astype(float)))
    return codes.drop("deleted").groupBy("chunk").cogroup(given.select("chunk", "level", "range", "counts").groupBy("chunk")).applyInArrow(rated(order, totals, weights), SCORED)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under a trigram model of those outside the held-out fifth."""
    return interpolated_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1, order=3)
