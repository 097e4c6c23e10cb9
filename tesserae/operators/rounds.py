"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where it names none, and all runs in one process, is a temporary one made."""
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
