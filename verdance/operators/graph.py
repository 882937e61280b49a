"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdance.session import shared_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of edges (a, b) to stars (u, v) that connect the same nodes: each to the smallest one it reaches in the batch."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()]), return_inverse=True)
        x, y = at[: batch.num_rows], at[batch.num_rows :]
        low = np.arange(len(nodes))
        while True:
            new = low.copy()
            # a node's lowest one takes the lower of two that an edge brings together, and all follow it
            lower = np.minimum(low[x], low[y])
            np.minimum.at(new, low[x], lower)
            np.minimum.at(new, low[y], lower)
            new = new[new]
            if np.array_equal(new, low):
                break
            low = new
        some = np.flatnonzero(low < np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[some]), pa.array(nodes[low[some]])], ["u", "v"])


def components(edges: DataFrame, label: str = "graph", max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node with an edge to another.

    Edges (u, v), v the smaller node, first become stars batch by batch, without a shuffle; then large-star and small-star
    steps alternate: each node hands its larger neighbours to its smallest one, then its smaller ones. A round finds each
    node's smallest neighbour (one aggregation, combined before its shuffle), joins it to the edges (a broadcast where it is
    small), and deals the edges once by their larger node. The rounds end when the edges are a forest of stars, which the
    aggregation shows; if ``max_rounds`` aren't enough, an error is raised. Tables between steps are written to the shared
    folder.
    """
    pairs = edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    at = stored(pairs.mapInArrow(contracted, "u long, v long"), f"{label}-edges")
    for _ in range(max_rounds):
        both = at.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(at.select(F.col("v").alias("node"), F.col("u").alias("other")))
        ends = both.groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most"))
        # In a star a node has larger neighbours only, or a single one that is smaller.
        loose = (F.col("least") < F.col("node")) & (F.col("least") < F.col("most"))
        low = stored(ends.select("node", F.least("node", "least").alias("component"), loose.alias("loose")), f"{label}-round")
        if low.filter("loose").isEmpty():
            return low.select("node", "component")
        large = at.join(low.select(F.col("node").alias("v"), F.col("component").alias("m")), "v").select("u", "m")
        mine = Window.partitionBy("u").orderBy("m")
        seen = large.withColumn("first", F.first("m").over(mine.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lag("m").over(mine))
        # the first of a node's edges leads to its smallest neighbour, each other one links that neighbour to this one
        kept = seen.filter("last is null or m > last").select(F.when(F.col("last").isNull(), F.col("u")).otherwise(F.col("m")).alias("u"), F.col("first").alias("v"))
        at = stored(kept, f"{label}-edges")
    raise RuntimeError(f"components of {label} are not found after {max_rounds} rounds")
