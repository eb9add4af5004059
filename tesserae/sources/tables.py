"""Sources: declared-schema scans, import from a database, optional tables, idempotent import."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.operators.metadata import derive_if_missing, has_url


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet scan; with a declared schema nothing is inferred, and only its columns are read."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def import_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a numeric column between its least and greatest value."""
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    ends = reader().option("query", f"SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}").load().first()
    if ends[0] is None:
        return reader().option("dbtable", table).load()
    bounds = {"partitionColumn": column, "lowerBound": ends[0], "upperBound": int(ends[1]) + 1, "numPartitions": parts}
    return reader().option("dbtable", table).options(**bounds).load()


def import_existing(spark: SparkSession, path: str) -> DataFrame:
    """An existing table with the flags it lacks; flags that it has are left alone."""
    df = scan(spark, path)
    df = derive_if_missing(df, "has_url", has_url(F.col("identifier")))
    return derive_if_missing(df, "in_training", F.lit(False))


def catalog_keys(spark: SparkSession, path: str, column: str = "uuid") -> DataFrame:
    return scan(spark, path).select(column).distinct()


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return scan(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
