"""Numbers for rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.shared import shared_path


def contiguous_ids(rows: DataFrame, order_by: list[str], name: str = "new_id") -> DataFrame:
    """Ids 0, 1, 2, ... in the order of unique keys."""
    return numbered(rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by), name)


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """Numbers 0, 1, 2, ... in the order in which the rows stand: a count of each partition, and an offset.

    The rows are written to the shared folder and read twice, so that both reads see the same partitions.
    """
    spread = rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    path = shared_path(rows.sparkSession, "numbered")
    spread.write.parquet(path)
    spread = rows.sparkSession.read.schema(spread.schema).parquet(path)
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    # one row a partition
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    return (
        spread.join(F.broadcast(starts.select("_p", "_start", "_first")), "_p")
        .withColumn(name, F.col("_start") + F.col("_m") - F.col("_first"))
        .drop("_p", "_m", "_start", "_first")
    )
