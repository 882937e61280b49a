"""Bounded-space online packing of tokenised documents into sequences.

Each partition reads its documents once. A document's ids, with an end id, are cut into whole windows and a rest; the
rest goes to the open window with the least room that still takes it (best fit). Where none does, the fullest of the
``OPEN`` open windows is closed and a new one opened. Windows still open when the partition ends are leftovers: groups
of partitions hand theirs to a second pass that packs whole windows together, best fit again, in bounded groups.

A sequence shorter than the window is padded to it, unless its length is a power of two: such lengths form batches
of their own.

Edge cases: a null text is an empty one and gives the end id alone; very long texts only give more windows; repeated
rows and null ids are packed like others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import stored, table

WINDOW = 2048
END_ID = 1
#: Windows open at once in a partition.
OPEN = 64
#: Partitions whose leftovers meet in one group of the second pass: at most FAN_IN * OPEN windows.
FAN_IN = 16
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
#: Written out in a text it stands for an id of its own.
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as the JSON vocabulary gives them.

    The rank file holds the same merges and is several times faster to apply (the tests hold it against the JSON file on
    every code point); texts with a special token written out take the JSON file.
    """

    def __init__(self, json_path: str, rank_path: str | None = None):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(json_path), None
        if rank_path:
            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


class Windows:
    """At most ``limit`` open windows, sorted by room left; ``put`` returns the windows that it closes."""

    def __init__(self, limit: int, size: int):
        self.limit, self.size, self.open, self.made = limit, size, [], 0

    def put(self, item: list, length: int) -> list[list]:
        closed = []
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, key, held = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                closed.append(self.open.pop(0)[2])
            room, key, held = self.size, self.made, []
            self.made += 1
        held.extend(item)
        if room == length:
            closed.append(held)
        else:
            insort(self.open, (room - length, key, held))
        return closed

    def rest(self) -> list[list]:
        return [held for _, _, held in self.open]


def pack_partition(paths: tuple[str, str | None], window: int, end_id: int, limit: int):
    """Arrow batches of (doc_id, text) to pieces; ``closed`` is false for those of windows that were left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = Encoder(*paths), Windows(limit, window)
        base, made, rows = TaskContext.get().partitionId() << 32, 0, []

        def close(held: list, done: bool) -> None:
            nonlocal made
            offset = 0
            for piece in held:
                rows.append((*piece, base + made, offset, done))
                offset += piece[2]
            made += 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n, doc_id = len(ids), doc_id.as_py()
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    piece = (doc_id, start, len(part), zlib.crc32(part.tobytes()), n)
                    for held in [[piece]] if len(part) == window else windows.put([piece], len(part)):
                        close(held, True)
            if len(rows) >= 10_000:
                yield as_batch(rows)
                rows = []
        for held in windows.rest():
            close(held, False)
        yield as_batch(rows)

    return run


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")] + ["closed"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, pa.bool_() if n == "closed" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def merge_leftovers(window: int, limit: int):
    """One group's leftover pieces to sequences: windows are packed whole, the fullest first."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        by_window: dict[int, list] = {}
        for row in zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), strict=True):
            by_window.setdefault(row[5], []).append(row)
        sized = sorted(((sum(r[2] for r in held), seq, sorted(held, key=lambda r: r[6])) for seq, held in by_window.items()), key=lambda w: (-w[0], w[1]))
        windows, rows = Windows(limit, window), []

        def close(held: list) -> None:
            offset, seq = 0, held[0][5]  # a window keeps the number of the first one in it
            for r in held:
                rows.append((*r[:5], seq, offset, True))
                offset += r[2]

        for length, _, held in sized:
            for done in windows.put(held, length):
                close(done)
        for held in windows.rest():
            close(held)
        return pa.Table.from_batches([as_batch(rows)])

    return run


def pack(docs: DataFrame, paths: tuple[str, str | None], window: int = WINDOW, end_id: int = END_ID, limit: int = OPEN) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    placed = stored(rows.mapInArrow(pack_partition(paths, window, end_id, limit), f"{PIECES}, closed boolean"), "pieces")
    # 32 bits of a sequence's number are its partition's; FAN_IN partitions share a group.
    group = F.shiftright("sequence_id", 32 + FAN_IN.bit_length() - 1)
    left = placed.filter("not closed").groupBy(group).applyInArrow(merge_leftovers(window, FAN_IN * limit), f"{PIECES}, closed boolean")
    return placed.filter("closed").unionByName(left).drop("closed")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return tuple(str(public_tokenizers.path(name)) for name in VOCABULARY)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_paths())
