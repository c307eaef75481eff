"""Cutting the lineage of iterations: a checkpoint in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master, as in tests, gets one where none is set."""
    master = spark.sparkContext.master
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='neurolattice-')}"


def fresh(spark: SparkSession) -> str:
    """A new folder's name in the shared one."""
    return f"{shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the checkpoint folder of the session. Only a local master, as in tests, gets a
    folder of its own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
