"""Cutting lineage where all executors can read it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine a temporary folder stands in where that is unset, on a
    cluster it must be set, as executors could not read each other's files."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshframe-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
