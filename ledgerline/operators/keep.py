"""Frames that several jobs read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast once it is counted.
FEW = 1 << 14


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once: a checkpoint where the session has a folder for them
    (spark.checkpoint.dir), else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= FEW else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path where driver and executors can read what the others write:
    under spark.checkpoint.dir, or a temporary one where all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root}/ledgerline-{uuid.uuid4().hex}"
