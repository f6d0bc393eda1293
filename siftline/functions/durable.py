"""Cutting lineage with a checkpoint that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The session's `spark.checkpoint.dir`, set up on first use.

    Where none is set, a local session gets a temporary one; a cluster has to name a folder that
    all executors share.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="siftline-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint a table several later steps read."""
    _folder(df)
    return df.checkpoint()


def columnar(df: DataFrame) -> DataFrame:
    """Like `durable`, as Parquet: for wide tables of which each later step reads few columns."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
