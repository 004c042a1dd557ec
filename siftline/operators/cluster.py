"""Materialising intermediate results so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a temporary folder will do on one machine; a cluster has to name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftline-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ends with a name."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}-{name}"
