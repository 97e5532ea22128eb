"""Session helpers shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, shared by its executors.

    Where it is unset, a local master (a single machine, as in tests) gets a temporary folder; a cluster is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerlens-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: computed once, then read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
