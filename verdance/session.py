"""Session factory with the settings that the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "verdance", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; ``conf`` overrides single settings.

    ``master`` is left to spark-submit unless it is given. ANSI mode stays on, as in Spark 4.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_spark(cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench, on this machine only."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    small = {"spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    return get_spark("verdance-local", f"local[{n}]", **{**small, **conf})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; a cluster is refused.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()
