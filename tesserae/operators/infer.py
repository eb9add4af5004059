"""Batch inference with an injected model, reuse by content hash, and rank-level prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tesserae.functions.vectors import normalise
from tesserae.operators.ivf import label_cells
from tesserae.operators.search import _matrix
from tesserae.sources.shared import written
from tesserae.sources.sinks import write_bucketed


def embed(rows: DataFrame, content: str, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 256, unit: bool = True) -> DataFrame:
    """``rows`` with ``embedding``: ``make_model`` gives, once in a worker, a function from a batch to (n, d) floats."""
    run = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    out = rows.withColumn("embedding", run(content))
    return out.withColumn("embedding", normalise(F.col("embedding")).cast("array<float>")) if unit else out


def embed_new(rows: DataFrame, store: DataFrame, content: str, make_model: Callable, batch_size: int = 256) -> DataFrame:
    """(content_hash, embedding) of every content: what the store has is reused, only the rest is embedded, once each."""
    keyed = rows.select(F.md5(F.col(content).cast("binary")).alias("content_hash"), content)
    fresh = keyed.join(store, "content_hash", "left_anti").dropDuplicates(["content_hash"])
    new = embed(fresh, content, make_model, batch_size).select("content_hash", "embedding")
    known = store.join(keyed.select("content_hash").distinct(), "content_hash", "left_semi")
    return known.select("content_hash", "embedding").unionByName(new)


def embed_into(rows: DataFrame, table: str, content: str, make_model: Callable, batch_size: int = 256) -> DataFrame:
    """``embed_new`` against a store that ``sinks.write_bucketed`` made by ``content_hash``, to which what is new is appended.

    Only the hashes of ``rows`` are shuffled, to the store's buckets; the store is read in place, bucket by bucket, and what is
    new is written by bucket, too. A call that is made again finds everything in the store.
    """
    spark = rows.sparkSession
    keyed = rows.select(F.md5(F.col(content).cast("binary")).alias("content_hash"), content).filter("content_hash is not null")
    buckets = bucket_count(spark, table)
    keyed = keyed.repartition(buckets, "content_hash").dropDuplicates(["content_hash"])
    fresh = keyed.join(spark.table(table).select("content_hash").hint("merge"), "content_hash", "left_anti")
    new = written(embed(fresh, content, make_model, batch_size).select("content_hash", "embedding"), "new-embeddings")
    if not new.isEmpty():
        location = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
        write_bucketed(new.select(*[F.col(f.name).cast(f.dataType) for f in spark.table(table).schema]), table, "content_hash", buckets, location, "append")
        spark.catalog.refreshTable(table)
    return spark.table(table).hint("merge").join(keyed.select("content_hash"), "content_hash", "left_semi")


def bucket_count(spark: SparkSession, table: str) -> int:
    """The buckets of a bucketed table."""
    found = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Num Buckets'").first()
    if not found:
        raise ValueError(f"{table} has no buckets")
    return int(found["data_type"])


#: Bytes of class vectors (64 bits a number) that are compared with the items in one pass, and items and classes that are
#: compared at once.
CLASS_BYTES, ITEM_BLOCK, CLASS_BLOCK = 256 << 20, 256, 4096


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def rank_scores(items: DataFrame, classes: DataFrame, names: DataFrame, k: int | None = None, temperature: float = 10.0) -> DataFrame:
    """(item, rank_value, score): softmax over all classes of temperature x cosine, added up by the value of each class.

    ``classes``: (cell, center), ``names``: (cell, rank_value); a class without a name counts in the softmax's sum alone. The
    scores of an item's classes are made and added up in a task by matrix products; only its ``k`` best values, or all if
    None, leave it. Class vectors are broadcast up to ``CLASS_BYTES``; more are taken in as many passes, which give sums of
    values that one aggregation by item and value joins, so that then all values of an item are shuffled.
    """
    named = classes.join(names.dropDuplicates(["cell"]), "cell", "left").select(F.col("cell").cast("int").alias("cell"), "center", F.col("rank_value").cast("string").alias("rank_value"))
    size = named.agg(F.coalesce(F.sum(8 * F.size("center").cast("long")), F.lit(0))).first()[0]
    rows = items.select(F.col("item").cast("long"), "embedding").filter("embedding is not null")
    passes = max(1, -(-size // CLASS_BYTES))
    if passes == 1:
        return _value_scores(rows, named, temperature, k, True)
    named, parts = written(named, "classes"), None
    for n in range(passes):
        one = _value_scores(rows, named.filter(F.pmod(F.xxhash64("cell"), F.lit(passes)) == n), temperature, None, False)
        parts = one if parts is None else parts.unionByName(one)
    by_value = parts.groupBy("item", "rank_value").agg(F.sum("score").alias("score"))
    total = F.sum("score").over(Window.partitionBy("item"))
    return by_value.withColumn("score", F.round(F.col("score") / total, 6)).filter("rank_value is not null")


def _value_scores(rows: DataFrame, named: DataFrame, temperature: float, k: int | None, whole: bool) -> DataFrame:
    """With ``whole``, shares of the sum over all classes, rounded; else sums, and one for the classes without a value."""
    table = named.orderBy("rank_value", "cell").toArrow()
    values = table["rank_value"].combine_chunks().dictionary_encode(null_encoding="encode")
    centers = _unit(_matrix(table["center"])) if len(table) else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((values.dictionary, values.indices.to_numpy(), centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, c = shared.value
        own = np.array([w.is_valid for w in words], bool)
        place = np.empty(len(words), np.int64)  # of equal scores, the smaller value comes first
        place[np.argsort(np.array([str(w.as_py()) for w in words], object), kind="stable")] = np.arange(len(words))
        for batch in batches:
            for lo in range(0, len(batch) if len(c) else 0, ITEM_BLOCK):
                part = batch.slice(lo, ITEM_BLOCK)
                v, sums = _unit(_matrix(part.column(1))), np.zeros((len(part), len(words)))
                for at in range(0, len(c), CLASS_BLOCK):  # classes stand in order of their value
                    e, in_order = np.exp(temperature * (v @ c[at : at + CLASS_BLOCK].T)), of[at : at + CLASS_BLOCK]
                    head = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
                    sums[:, in_order[head]] += np.add.reduceat(e, head, axis=1)
                score = (sums / sums.sum(1, keepdims=True)).round(6) if whole else sums
                keep = np.broadcast_to(own | (not whole), score.shape)
                if k is not None:
                    order = np.lexsort((np.broadcast_to(place, score.shape), -score, ~keep))[:, :k]
                    row, column = np.repeat(np.arange(len(part)), order.shape[1]), order.ravel()
                    row, column = (x[keep[row, column]] for x in (row, column))
                else:
                    row, column = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), words.take(pa.array(column)), pa.array(score[row, column])], names=["item", "rank_value", "score"])

    return rows.mapInArrow(run, "item long, rank_value string, score double")


def predict_rank(items: DataFrame, corpus: DataFrame, names: DataFrame, rank: str, k: int = 5, label: str = "label") -> DataFrame:
    """(item, rank_value, score, rk): scores of classes added up by their value at ``rank``, the ``k`` best of each item.

    ``corpus`` (embedding, label) gives the class vectors; ``names``: (cell, <ranks>). An item may have fewer than k. An item
    is in one row of ``items``; rows that repeat one give their own scores, and the best of all of them are ranked.
    """
    scores = rank_scores(items, label_cells(corpus, label), names.select("cell", F.col(rank).alias("rank_value")), k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "rank_value")
    return scores.withColumn("rk", F.row_number().over(best).cast("long")).filter(F.col("rk") <= k)
