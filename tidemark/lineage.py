"""Lineage cuts for iterative operators, in the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only on one machine (tests), never on a cluster, whose executors would not share it."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("CHECKPOINT_FOLDER_REQUIRED: set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    named = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in that folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
