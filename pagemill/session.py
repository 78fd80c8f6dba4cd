"""Session settings and checkpoint handling shared by all jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pagemill", master: str | None = None,
                  shuffle_partitions: int | None = None, driver_memory: str | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A session with the settings the jobs rely on.

    Adaptive execution sizes shuffles and splits skewed join partitions, so no
    job in this package fixes a partition count of its own.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where neither that setting nor a checkpoint
    folder exists, a local session takes a temporary folder; a cluster is asked to name one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-ckpt-"))
    return sc.getCheckpointDir()


def task_count(df: DataFrame) -> int:
    """Partitions of a shuffle whose count must be fixed: the session's setting, which a large job sizes by its input.

    Estimates of a plan's bytes are no help here: a table that comes from rows or an RDD has none.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
