"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder of checkpoints, ``spark.checkpoint.dir``, which all executors share.

    Only where none is set and the master is local (tests, a laptop) it is a temporary one.
    """
    sc = session.sparkContext
    if not sc.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
