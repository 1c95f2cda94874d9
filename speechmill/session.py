"""Session defaults shared by the bench, the tests and ad-hoc use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "speechmill", cpus: int | str = "*",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the operators assume (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("SPARK_SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def state_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and streaming state.

    It lies under the cluster's shared ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) is a local temporary folder used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix=f"{name}-")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    For tables that several steps of one job read: their work is done once,
    their lineage is cut, and their size is known to the planner.
    """
    path = state_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
