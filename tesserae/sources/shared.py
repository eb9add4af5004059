"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, as in tests; on a
    cluster every machine would write to another folder, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 100_000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its work is done once, and a lost executor costs a read."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the hint to broadcast it if it has at most ``most`` rows; without it, Spark shuffles for the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
