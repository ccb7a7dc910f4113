"""Folders for intermediate results that every executor and the driver reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def chosen_folder(named: str, master: str) -> str:
    """The named folder; on one machine (master ``local``) a temporary one stands for none.

    On a cluster a missing name is an error, as a folder of one machine would
    lose data silently.
    """
    if not named and master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="wavemill-")


def checkpoint_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, in the session or the context, or what the context was given."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    where = chosen_folder(spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", ""), sc.master)
    sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder of its own in the shared one."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
