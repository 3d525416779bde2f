"""Cutting lineage where a plan would grow too large, or a result is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder for this session below the one that it names in spark.checkpoint.dir.

    Without one, executors on other machines could not read what is saved, so only a session on this machine alone gets a folder of our own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that is not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
