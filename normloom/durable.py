"""Copies of intermediate rows in the folder that all executors share; they outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder; on a cluster
    its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="normloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with an eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
