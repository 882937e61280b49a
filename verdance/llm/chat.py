"""Chat formatting into prefix trees.

Conversations that share their first turns share them in a tree: each different turn after the same turns is one node, and its
tokens are written once, in depth-first order. A node comes with the position of its first token in a conversation and
with the intervals of the tree's token sequence that it attends to: those of its ancestors. Within a node attention
is causal, so that each conversation is trained on as if it stood alone.

How the trees are built: a turn's number in its conversation and a fingerprint of all turns up to it are running sums, taken
inside ranges of rows and carried over from range to range, so that a conversation of any length spreads over tasks. Equal
fingerprints are one node (their contents and parents are compared; a difference is an error). A node belongs to the
conversation that has it first; what a conversation owns is a chain of nodes that hangs on a node of another chain, and
chains, not nodes, are put in depth-first order: by their path of (branches from the deepest turn up, chain), found by
pointer doubling. Their offsets are running sums again, and since chains lie in one piece, a node has one interval for each
chain on its path. A first turn that a third of all conversations share is a row that many chains point to; no task gathers them.

The template puts a turn between two marks that tell its role. Control strings in texts get a backslash behind their first
character, and backslashes are doubled, so that no text holds a mark and each is read back as it was.

Edge cases: null roles and texts are empty; turns are in the order of ``turn``, null first, then of role and of the md5 of
role and text; repeated rows are turns of their own; the rows of a null conv_id are one conversation (the id -2**63 stands
for null inside and isn't told apart from it); other roles than system, user and assistant are written out between marks of
their own; very long texts are one node, very long conversations many rows; other columns are ignored; an empty table
gives empty trees.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import stored, table
from verdance.llm.packing import Encoder, vocabulary_paths

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
#: Around the name of any other role, and behind its text.
ROLE, OTHER_END = ("[ROLE]", "[/ROLE]"), "[END]"
CONTROLS = tuple(sorted({m.strip() for pair in MARKS.values() for m in pair} | {*ROLE, OTHER_END}))
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
#: Stands for a null conv_id.
NO_ID = -(2**63)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (ROLE[0] + escape(role) + ROLE[1], OTHER_END)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    for role, (start, end) in MARKS.items():
        if formatted.startswith(start) and formatted.endswith(end):
            return role, unescape(formatted[len(start) : -len(end)])
    role, text = formatted.removeprefix(ROLE[0]).removesuffix(OTHER_END).split(ROLE[1], 1)
    return unescape(role), unescape(text)


@dataclass
class Forest:
    """``turns``: (tree, chain, depth, offset, position, length, ids, loss_start, loss_end, attends), a row for each node.

    ``offset`` is the node's place in the tree's tokens, ``position`` that of its first token in a conversation; tokens from
    loss_start to loss_end of the node count for the loss; ``attends`` are intervals (chain, start, end) of the tree's tokens.
    ``conversations``: (conv_id, n_turns, chain, depth), the last node of each.
    """

    turns: DataFrame
    conversations: DataFrame


def running(rows: DataFrame, key: str, at: str, sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with inclusive running sums and exclusive-ors within each key, in the order of ``at``.

    ``at`` is a monotonically_increasing_id of rows that are in order, so its high bits number the ranges: values run inside a
    range, and the totals of the ranges before (a row for each key and range) are carried over.
    """
    of = {n: (F.sum, c) for n, c in (sums or {}).items()} | {n: (F.bit_xor, c) for n, c in (xors or {}).items()}
    ranged = rows.withColumn("_range", F.shiftright(at, 33))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(key, "_range").agg(*[f(c).alias(n) for n, (f, c) in of.items()])
    carried = totals.select(key, "_range", *[F.coalesce(f(n).over(before), F.lit(0)).alias(f"_{n}") for n, (f, _) in of.items()])
    out = ranged.select("*", *[f(c).over(inside).alias(n) for n, (f, c) in of.items()]).join(carried, [key, "_range"])
    both = {n: F.col(n) + F.col(f"_{n}") if f is F.sum else F.col(n).bitwiseXOR(F.col(f"_{n}")) for n, (f, _) in of.items()}
    return out.withColumns(both).drop("_range", *[f"_{n}" for n in of])


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, with ``at`` ascending in that order; to be stored."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def _encoded(paths: tuple[str, str]):
    """(at, role, text) to (at, ids, length, loss_start, loss_end); marks and text have tokens of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = Encoder(*paths).fast.encode_ordinary, {}
        for batch in batches:
            ids, ends, spans = [], [0], []
            for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if role not in known:
                    known.clear() if len(known) > 1000 else None
                    known[role] = tuple(map(encode, marks(role)))
                (start, end), body = known[role], encode(escape(text))
                ids += start + body + end
                ends.append(len(ids))
                spans.append((len(start), len(start) + len(body)) if role == "assistant" else (0, 0))
            a, b = zip(*spans, strict=True) if spans else ((), ())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column(0), listed, pa.array(np.diff(ends), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["at", "ids", "length", "loss_start", "loss_end"])

    return run


def owned_steps(rows: DataFrame) -> DataFrame:
    """(conv, at, j, first, chain) for each turn: its number from 1, and the row and conversation that have its node first."""
    narrow = running(rows.select("conv", "at", "c1", "c2"), "conv", "at", sums={"j": F.lit(1).cast("long")})
    own = lambda k: F.xxhash64(F.lit(k), "j", "c1", "c2")
    hashed = stored(narrow.withColumn("h1", own(1)).withColumn("h2", own(2)), "chat-turns")
    steps = running(hashed, "conv", "at", xors={"n1": F.col("h1"), "n2": F.col("h2")})
    # rows are numbered by conversation, so a node's first row is in the smallest conversation that has it
    told = F.struct("j", "c1", "c2", F.col("n1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("h2")).alias("p2"))
    steps = stored(steps.select("conv", "at", "j", "n1", "n2", told.alias("told")), "chat-steps")
    one = F.when(F.min("told") == F.max("told"), F.min(F.struct("at", "conv"))).otherwise(F.raise_error(F.lit("two turns have one fingerprint")).cast("struct<at:long,conv:long>"))
    nodes = steps.groupBy("n1", "n2").agg(one.alias("node"))
    return steps.join(nodes, ["n1", "n2"]).select("conv", "at", "j", F.col("node.at").alias("first"), F.col("node.conv").alias("chain"))


def with_paths(chains: DataFrame) -> DataFrame:
    """``chains`` (chain, parent, a, seg) with ``path``: (back, chain, parent, seg) of each link from the tree's first chain down.

    Rounds are as many as the logarithm of the longest path; a round joins each chain to the one that its path begins at.
    """
    link = F.struct((-F.col("a")).alias("back"), "chain", "parent", "seg")
    kind = "array<struct<back:long,chain:long,parent:long,seg:long>>"
    at = stored(chains.select("chain", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.array()).otherwise(F.array(link)).cast(kind).alias("path")), "chat-paths")
    while not at.filter("up is not null").isEmpty():
        above = at.select(F.col("chain").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        moved = at.filter("up is not null").join(above, "up").select("chain", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        at = stored(at.filter("up is null").unionByName(moved), "chat-paths")
    return at.select("chain", "path")


def forest(conversations: DataFrame, paths: tuple[str, str] | None = None) -> Forest:
    """The trees of ``conversations`` (conv_id, turn, role, text); ``paths`` names the vocabulary's files."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    read = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), "turn", text("role"), text("text"))
    content = read.withColumn("md5", F.md5(F.concat(F.md5(F.col("role").cast("binary")), "text").cast("binary")))
    bits = lambda k: F.conv(F.substring("md5", k, 15), 16, 10).cast("long")
    rows = stored(numbered(content, "conv", "turn", "role", "md5").select("conv", "at", "role", "text", bits(1).alias("c1"), bits(16).alias("c2")), "chat-rows")
    steps = stored(owned_steps(rows), "chat-owned")

    mine = F.col("first") == F.col("at")
    ends = steps.groupBy("conv").agg(
        F.max("j").alias("n_turns"), F.max_by("chain", "j").alias("chain"), F.max(F.when(~mine, F.struct("j", "chain"))).alias("hook"), F.count_if(mine).alias("own")
    )
    ends = stored(ends, "chat-ends")
    tokens = steps.filter(mine).select("at", "chain", "j").join(rows.select("at", "role", "text"), "at")
    coded = tokens.select("at", "role", "text").mapInArrow(_encoded(paths or vocabulary_paths()), "at long, ids array<int>, length long, loss_start long, loss_end long")
    coded = stored(coded, "chat-tokens")
    nodes = steps.filter(mine).select("at", "chain", "j").join(coded.select("at", "length"), "at")
    nodes = stored(running(nodes, "chain", "at", sums={"upto": F.col("length")}), "chat-nodes")

    hooks = ends.filter("own > 0").select(F.col("conv").alias("chain"), F.col("hook.chain").alias("parent"), F.coalesce("hook.j", F.lit(0).cast("long")).alias("a"))
    seg = nodes.select(F.col("chain").alias("parent"), F.col("j").alias("a"), F.col("upto").alias("seg"))
    paths_of = with_paths(hooks.join(seg, ["parent", "a"], "left"))
    lengths = nodes.groupBy("chain").agg(F.max("upto").alias("tokens"))
    tree = F.when(F.size("path") > 0, F.element_at("path", 1)["parent"]).otherwise(F.col("chain")).alias("tree")
    ordered = stored(numbered(paths_of.join(lengths, "chain").select(tree, "chain", "path", "tokens"), "tree", "path"), "chat-order")
    placed = stored(running(ordered, "tree", "at", sums={"end": F.col("tokens")}).select("tree", "chain", "path", (F.col("end") - F.col("tokens")).alias("start")), "chat-chains")
    above = placed.select("chain", F.explode("path").alias("x")).select("chain", F.col("x.parent").alias("parent"), F.col("x.seg").alias("seg"))
    spans = above.join(placed.select(F.col("chain").alias("parent"), "start"), "parent").groupBy("chain").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("seg")).alias("end"), F.col("parent").alias("chain")))).alias("spans"), F.sum("seg").alias("before")
    )
    where = placed.drop("path").join(spans, "chain", "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))

    done = nodes.withColumn("inside", F.col("upto") - F.col("length")).join(where, "chain")
    offset = F.col("start") + F.col("inside")
    ancestors = F.coalesce(F.transform("spans", lambda s: F.struct(s["chain"].alias("chain"), s["start"].alias("start"), s["end"].alias("end"))), F.expr("cast(array() as array<struct<chain:long,start:long,end:long>>)"))
    siblings = F.filter(F.array(F.struct(F.col("chain").alias("chain"), F.col("start").alias("start"), offset.alias("end"))), lambda s: s["start"] < s["end"])
    turns = done.select(
        "at", "tree", "chain", F.col("j").alias("depth"), offset.alias("offset"), (F.col("before") + F.col("inside")).alias("position"), "length", F.concat(ancestors, siblings).alias("attends")
    ).join(coded.drop("length"), "at")
    turns = stored(turns.select("tree", "chain", "depth", "offset", "position", "length", "ids", "loss_start", "loss_end", "attends"), "chat-forest")
    named = ends.select(F.nullif("conv", F.lit(NO_ID)).alias("conv_id"), "n_turns", "chain", F.col("n_turns").alias("depth"))
    return Forest(turns, named)


def _read_back(paths: tuple[str, str]):
    """Turns of conversations, in order, to a row of digests for each; a conversation is a stream, of which only hashes are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Encoder(*paths).fast
        decode = lambda ids: codec.decode_bytes(ids).decode()
        now, state, rows = None, None, []

        def close() -> None:
            if now is not None:
                turns, loss, n, n_loss, chars = state
                rows.append((*now, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))

        names = ["chain", "depth", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            for chain, depth, ids, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (chain, depth) != now:
                    close()
                    now, state = (chain, depth), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                formatted = decode(ids)
                role, text = read_turn(formatted)
                learnt = unescape(decode(ids[start:end]))
                state[0].update(f"{role}\n{text}\n".encode())
                state[1].update(learnt.encode())
                state[2:] = state[2] + 1, state[3] + len(learnt), state[4] + len(formatted)
            if len(rows) > 10_000:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names)
                rows.clear()
        close()
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names)

    return run


def digests(made: Forest, paths: tuple[str, str] | None = None) -> DataFrame:
    """What each conversation is, read back from the trees' tokens, intervals and loss masks; equal conversations are read once."""
    leaves = made.conversations.select("chain", "depth").distinct().join(made.turns.select("chain", "depth", "offset", "length", "attends"), ["chain", "depth"])
    itself = F.array(F.struct(F.col("chain").alias("chain"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end")))
    spans = leaves.select("chain", "depth", F.explode(F.concat("attends", itself)).alias("s")).select(F.col("chain").alias("leaf"), "depth", F.col("s.chain").alias("chain"), "s.start", "s.end")
    tokens = made.turns.select("chain", "offset", "ids", "loss_start", "loss_end")
    read = spans.join(tokens, "chain").filter("offset >= start and offset < end").select("leaf", "depth", "offset", "ids", "loss_start", "loss_end")
    inorder = read.repartition("leaf", "depth").sortWithinPartitions("leaf", "depth", "offset").drop("offset")
    found = inorder.mapInArrow(_read_back(paths or vocabulary_paths()), "chain long, depth long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.conversations.select("conv_id", "chain", "depth").join(found, ["chain", "depth"]).drop("chain", "depth")


def op11_chat_trees(spark, sf_dir: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of all conversations and of one made of control strings."""
    planted = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(forest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


#: Control strings and backslashes count one character more; the numbers are the lengths of the marks.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|CONTROLS')) AS escaped, length(role) + len(regexp_extract_all(role, '\\|CONTROLS')) AS named FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + named END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""".replace("CONTROLS", "|".join(re.escape(c) for c in CONTROLS).replace("'", "''"))
