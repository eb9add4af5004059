"""Streaming forms: search on arrival, bytes per host and hour, and an alarm for each host and hour beyond a limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tesserae.operators import index
from tesserae.operators.search import search


def search_on_arrival(
    stream: DataFrame, corpus: DataFrame, metadata: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, top_n: int = 10, factor: int = 3, scope: Column | None = None
) -> StreamingQuery:
    """Search for each micro-batch of (query_id, query_vec) as it arrives; ``sink`` gets the hits and the batch's number.

    A batch that is delivered again has the same number, so a sink that overwrites by it stores each batch once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(search(batch, corpus, metadata, top_n, factor, scope), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_index_on_arrival(
    stream: DataFrame, path: str, metadata: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, nprobe: int, top_n: int = 10, factor: int = 3, scope: Column | None = None
) -> StreamingQuery:
    """``search_on_arrival`` against a stored index: a micro-batch reads the files of its ``nprobe`` nearest cells only.

    Vectors that are committed to the index between two batches are found from the next one on.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(index.search_scoped(path, batch, metadata, top_n, nprobe, factor, scope), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bytes_per_hour(log: DataFrame, late: str = "1 hour", limit: int | None = None, throttled: list[str] = ()) -> DataFrame:
    """(hour, host, n_bytes, over) of a fetch log (ts, host, n_bytes), as a stream or a table.

    Timestamps without a zone are taken as UTC, as a watermark needs an instant.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if log.isStreaming else timed
    summed = timed.groupBy(F.window("ts", "1 hour").alias("w"), "host").agg(F.sum("n_bytes").alias("n_bytes"))
    over = F.col("host").isin(list(throttled)) & (F.col("n_bytes") > limit) if limit is not None else F.lit(False)
    return summed.select(F.col("w.start").alias("hour"), "host", "n_bytes", over.alias("over"))


_SECONDS = "host string, hour timestamp, second timestamp, n_bytes long"


def _by_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows: a host's hour has 3,600 seconds at most, so a busy host sends few rows."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["host", "hour", "second"], use_threads=False).aggregate([("n_bytes", "sum")])
        yield from found.rename_columns(["host", "hour", "second", "n_bytes"]).combine_chunks().to_batches()


class _FirstCrossing(StatefulProcessor):
    """State of a host's hour: its bytes, and whether the alarm was given. It goes when the watermark has passed the hour."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n_bytes long, given boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds: Counter = Counter()
        for part in rows:
            for second, n in part.groupby("second")["n_bytes"].sum().items():
                seconds[second] += int(n)
        known = self.state.exists()
        total, given = self.state.get() if known else (0, False)
        for second in sorted(seconds):
            total += seconds[second]
            if total > self.limit and not given:
                given = True
                yield pd.DataFrame({"hour": [key[1]], "host": [key[0]], "second": [second], "n_bytes": [total]})
        self.state.update((total, given))
        if not known:
            self.handle.registerTimer(int((pd.Timestamp(key[1]) + pd.Timedelta(hours=1)).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_crossings(log: DataFrame, limit: int, throttled: list[str], late: str = "1 hour") -> DataFrame:
    """(hour, host, second, n_bytes) of a fetch log (ts, host, n_bytes): a row for the second in which a throttled host's bytes
    of an hour first exceed ``limit``, with the bytes until its end. As a table, or as a stream in append mode.

    A stream keeps a total for each host and hour and gives each alarm once, whatever arrives later and however often it is
    started again; seconds are in order within a micro-batch, and what earlier ones brought comes first. Rows later than
    ``late`` are not counted. The stream needs the RocksDB state store: ``start_alarms`` sees to that.
    """
    timed = log.filter(F.col("host").isin(list(throttled)) & F.col("ts").isNotNull() & F.col("n_bytes").isNotNull())
    ts = F.col("ts").cast("timestamp")
    timed = timed.select("host", F.date_trunc("hour", ts).alias("hour"), F.date_trunc("second", ts).alias("second"), F.col("n_bytes").cast("long").alias("n_bytes"))
    if not log.isStreaming:
        sums = timed.groupBy("host", "hour", "second").agg(F.sum("n_bytes").alias("n_bytes"))
        upto = Window.partitionBy("host", "hour").orderBy("second")  # 3,600 rows at most
        over = sums.withColumn("n_bytes", F.sum("n_bytes").over(upto)).filter(F.col("n_bytes") > limit)
        return over.groupBy("hour", "host").agg(F.min("second").alias("second"), F.min("n_bytes").alias("n_bytes"))
    sums = timed.mapInArrow(_by_second, _SECONDS).withWatermark("second", late)
    return sums.groupBy("host", "hour").transformWithStateInPandas(
        statefulProcessor=_FirstCrossing(limit), outputStructType="hour timestamp, host string, second timestamp, n_bytes long", outputMode="Append", timeMode="EventTime"
    )


def start_alarms(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int, throttled: list[str], late: str = "1 hour") -> StreamingQuery:
    """``first_crossings`` of a stream; ``sink`` gets each batch's alarms and its number, and should overwrite by it."""
    conf, key = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = first_crossings(log, limit, throttled, late).writeStream.foreachBatch(sink).outputMode("append")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
