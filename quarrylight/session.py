"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "quarrylight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects.

    Partition counts are left to adaptive execution: it merges small shuffle
    partitions and splits skewed ones, so one setting fits every data size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Few narrow rows may still carry much text work: keep them on all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="quarrylight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """At most 1,000 rows in an Arrow batch, as they carry whole texts."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= 1000:
        spark.conf.set(batch, "1000")
