"""From documents to packed sequences in five stages, each written as Parquet and read again as the next one's input.

Edge cases: null, empty and very long texts, ties and null sources go through every stage as its operator says (toxicity,
line dedup and near-dedup keep rows without text, mixing takes none); repeated rows are one document for near-dedup, where
all rows of an id that stays remain, and are scored, mixed and packed one by one; null ids never match labels, copies or each
other; columns beside those of documents pass through all stages but the last, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import lines, mixing, neardup, packing, toxicity
from verdance.llm.common import free, shared_dir, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from labels of documents still there."""
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines; n_chars follows the text."""
    n_lines, n_removed = free(docs, "n_lines", "n_removed")
    cut = lines.drop_spread_lines(docs, counts=(n_lines, n_removed))
    chars = F.when(F.col(n_removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.drop_near_copies(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, some of them several times."""
    return mixing.keep_mixed(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.vocabulary_paths())


STAGES = [
    ("toxicity", _toxicity),
    ("line dedup", _line_dedup),
    ("MinHash near-dedup", _near_dedup),
    ("mixing sources", _mixing),
    ("packing", _packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
