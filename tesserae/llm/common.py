"""Expressions and small helpers that several training-data operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.shared import shared_path

#: A word of a text. Java reads the ranges on characters, as the contracts mean them.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows that Spark puts into one batch of a Parquet scan, or sends to a Python worker at once.
SCANNED, SENT = 1_024, 2_000
#: Bytes of text for each file of a staged table, as long as every core gets ``WAVES`` files.
FILE, WAVES = 64 << 20, 4


def tuned(spark: SparkSession) -> SparkSession:
    """``spark`` with batches that are small enough for rows of whole texts; lower settings than these stay."""
    for key, most in (("spark.sql.parquet.columnarReaderBatchSize", SCANNED), ("spark.sql.execution.arrow.maxRecordsPerBatch", SENT)):
        now = int(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, most)
    return spark


def files(spark: SparkSession, size: int) -> int:
    """How many files at most a table made from so many bytes of text is written to."""
    return max(WAVES * spark.sparkContext.defaultParallelism, -(-size // FILE))


def stage(df: DataFrame, label: str, size: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: the work before it is done once, and a lost executor costs a read, not a rerun. With ``size``,
    the bytes of the texts that the table is made from, small inputs aren't spread over many small files.
    """
    path = shared_path(df.sparkSession, label)
    if size is not None:
        df = df.coalesce(files(df.sparkSession, size))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables (or of unions of such) that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search("-[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_size(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Numbers from here on, above all ids, are those of rows without an id.
NO_ID = 1 << 62


def node(doc_id: Column, text: Column) -> Column:
    """The number of a row's document: its id, or one from ``NO_ID`` on that follows from its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID >> 1)))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Rows up to which a table that was written and counted may be broadcast.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the hint to broadcast it if it has at most ``most`` rows; without it, Spark shuffles for the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shield(docs: DataFrame):
    """``docs`` with its columns renamed c0, c1, ..., so that no name clashes with those that an operator adds.

    Returns the renamed table, a function from a column's name to its new one, and a function that restores the names
    and appends the columns that are given to it: expressions, or names of ``new`` ones, which replace columns of ``docs``
    of the same name.
    """
    tuned(docs.sparkSession)
    names = docs.columns

    def back(df: DataFrame, *more: Column, new: list[str] | None = None) -> DataFrame:
        own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in (new or ())]
        return df.select(*own, *(new or ()), *more)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: f"c{names.index(name)}", back
