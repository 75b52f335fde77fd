"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "storyline", partitions: int | None = None):
    """A session for tests and benches; on a cluster the caller brings its own."""
    cores = master[6:-1] if master.startswith("local[") else "*"
    parts = partitions or (int(cores) if cores.isdigit() else (os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's setting, or a scratch one where none is set and all runs in one process.

    On a cluster a folder that only one machine sees would lose what executors write, so there the setting is needed.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or tempfile.mkdtemp(prefix="spark-storyline-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
