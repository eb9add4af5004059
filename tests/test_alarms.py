"""Alarms of hosts that exceed their limit: once for each hour, also after a restart."""

import datetime as dt

from pyspark.sql import functions as F

from tesserae.streaming import streams

SLOW = ["slow.org", "slower.org"]


def rows(n, start=0):
    at = dt.datetime(2024, 1, 1)
    return [(at + dt.timedelta(seconds=37 * i, milliseconds=13 * i), ["slow.org", "fast.org", "slower.org"][i % 3], (i * 7919) % 1000) for i in range(start, n)]


def plain(log, limit):
    found, total = {}, {}
    for ts, host, n in sorted(log):
        if host in SLOW:
            total.setdefault((ts.replace(minute=0, second=0, microsecond=0), host), {}).setdefault(ts.replace(microsecond=0), []).append(n)
    for key, seconds in total.items():
        so_far = 0
        for second in sorted(seconds):
            so_far += sum(seconds[second])
            if so_far > limit and key not in found:
                found[key] = (second, so_far)
    return sorted((*k, *v) for k, v in found.items())


def collected(df):
    return sorted((r["hour"], r["host"], r["second"], r["n_bytes"]) for r in df.collect())


LOG = "ts timestamp, host string, n_bytes long"


def test_alarms_of_a_table(spark):
    log = rows(900)
    odd = [(None, "slow.org", 10**9), (log[0][0], None, 10**9), (log[0][0], "slow.org", None), (log[0][0], "slow.org", 0)]
    found = streams.first_crossings(spark.createDataFrame(log + odd, LOG), 9_000, SLOW)
    assert collected(found) == plain(log, 9_000) and 5 < found.count() < 40
    assert streams.first_crossings(spark.createDataFrame([], LOG), 1, SLOW).collect() == []


def test_alarms_of_a_stream_that_starts_again(spark, tmp_path):
    """Three runs over files in order of time: the same alarms as of a table, each once."""
    log, got = rows(900), []
    for run, (lo, hi) in enumerate(((0, 250), (250, 263), (263, 900))):
        spark.createDataFrame(rows(hi, lo), LOG).coalesce(2).write.parquet(f"{tmp_path}/in/{run}")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in/*")
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        streams.start_alarms(stream, sink, f"{tmp_path}/checkpoint", 9_000, SLOW).awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
        got.append(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count())
    assert got[0] < got[2]
    assert collected(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")) == plain(log, 9_000)


def test_late_rows_don_t_alarm_twice(spark, tmp_path):
    """Rows of an hour that gave its alarm, in a later batch: no second one."""
    first = [(dt.datetime(2024, 1, 1, 5, 10, i), "slow.org", 100) for i in range(50)]
    later = [(dt.datetime(2024, 1, 1, 5, 50, i), "slow.org", 100) for i in range(50)] + [(dt.datetime(2024, 1, 1, 5, 0, 1), "slow.org", 5000)]
    for run, log in enumerate((first, later)):
        spark.createDataFrame(log, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{run}")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in/*")
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        streams.start_alarms(stream, sink, f"{tmp_path}/checkpoint", 1_000, SLOW).awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").select(F.date_format("second", "HH:mm:ss"), "n_bytes").collect()
    assert [tuple(r) for r in found] == [("05:10:10", 1100)]
