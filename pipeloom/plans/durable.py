"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder of the session and read from there."""
    _base(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """A new folder's name below the checkpoint folder."""
    return f"{_base(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not base:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, True)
    if not known.isDefined():
        sc.setCheckpointDir(base)
    return base
