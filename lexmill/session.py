"""Session factory and table loader."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "lexmill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys use __ for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names, so that its lineage is cut and a lost executor costs little.

    Where none is set, a local folder serves under a local master; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
        context.setCheckpointDir(root or f"file://{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()
