"""Sinks: sorted layouts, point-lookup layouts, result export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that rows of metadata are sorted by, in order.
SORT_KEYS = ["source_dataset", "kingdom", "phylum", "class", "order", "family", "genus", "species", "common_name"]


def sorted_rows(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Globally sorted, nulls last: ranges of the keys become partitions, each sorted."""
    order = [F.col(k).asc_nulls_last() for k in keys if k in df.columns]
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def write_sorted(df: DataFrame, path: str, keys: list[str] | None = None, partitions: int | None = None, last: str = "id") -> None:
    """Sorted by ``keys``, and by ``last`` where the table has it: rows with equal keys, however many, are then several ranges."""
    sorted_rows(df, [*(keys or SORT_KEYS), last], partitions).write.mode("overwrite").parquet(path)


def write_lookup(df: DataFrame, path: str, key: str = "id", partition_by: list[str] | None = None) -> None:
    """For lookups by key: sorted by it, so row groups have narrow ranges, with a Bloom filter on it."""
    writer = sorted_rows(df, [key]).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> None:
    """A table whose joins and lookups on ``key`` need no shuffle, as long as there are no more shuffle partitions than
    ``buckets``. With ``path`` its files are there, else in the warehouse; ``append`` adds files to each bucket."""
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def export_results(hits: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results in the order of query and rank."""
    sorted_rows(hits, ["query_id", "rank"]).write.mode("overwrite").format(kind).save(path)
