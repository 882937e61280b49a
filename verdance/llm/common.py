"""What the operators share: table reading, text conventions, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.operators.graph import components, stored
from verdance.session import shared_dir

__all__ = ["WORD", "components", "crc_mod", "free", "held", "light", "released", "shared_dir", "stored", "table", "word_count", "words_of"]

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of an UTF-8 text with A-Z folded: bytes.lower and bytes.split know ASCII alone, as WORD does."""
    return text.lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a few narrow columns that are already written, to be broadcast if it has at most ``most`` rows.

    Its rows are counted first; beyond the bound the join shuffles both sides as usual.
    """
    return F.broadcast(df) if df.count() <= most else df


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held(df: DataFrame, *names: str) -> DataFrame:
    """``names`` as columns and all others in one column ``row``: whatever these are called, none clashes."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), *names)


def released(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` as held(df, *names) has them."""
    return [F.col(c) if c in names else F.col(f"row.`{c}`").alias(c) for c in df.columns]
