"""Work that goes on where it ended: new rows of a stream, or of a table that grew, are processed once and appended.

The reference data model has no streams; this is its resumable mode (objects that have a result already are left out) in
the form that Structured Streaming offers: each micro-batch is held against the results written so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """What is written already; None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new(objects: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "fid") -> None:
    """Runs ``work`` on the objects without a result and appends what it returns; its rows keep the key."""
    done = results(objects.sparkSession, path)
    left = objects if done is None else objects.join(done.select(key).distinct(), key, "left_anti")
    work(left).write.mode("append").parquet(path)


def follow(stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "fid", available_now: bool = True) -> StreamingQuery:
    """Applies append_new to each micro-batch. A batch that is run again after a failure adds no row twice."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch.dropDuplicates([key]), path, work, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
