"""Tables between the steps of an iterative plan, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder made here only where it is unset and all runs in one process, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without the plan that made them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
