"""Cutting long lineage where a plan is read again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session without executors of its own may go without the setting: it gets a
    temporary folder, because driver and tasks share one machine there. On a cluster the
    setting is required; a folder of one machine would lose rows without a word.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. All paths of one application lie under one folder,
    which can be deleted when the application has ended."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/plumbline-{application}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: computed once, and
    still there when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
