"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tramline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution on; the number of shuffle partitions is the cluster's unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def working_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``; one of this machine only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tramline-"))
    return context.getCheckpointDir()
