"""Fetch planning and accounting: routes, schedule, paced fetching with a ledger, outcome classes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import urls
from tesserae.functions.labels import error_text, filled
from tesserae.sources.shared import shared_path

THROTTLED = ["static.inaturalist.org"]
RATE = 1.0
ALARM = 4 * 1024**3


def route(url: Column, throttled: list[str]) -> Column:
    return F.when(filled(url).isNull(), "no_url").when(urls.host(url).isin(throttled), "rate_limited").otherwise("unrestricted")


def plan(df: DataFrame, url: str, id_col: str, throttled: list[str], rate: float = RATE) -> DataFrame:
    """``df`` with ``route`` and ``start_offset_s``: each throttled host gets ``rate`` requests a second, the first at once.

    A throttled host's requests are one sequence by their nature; the window holds these rows alone. Rows that repeat an
    id, or have none, each have a place.
    """
    routed = df.withColumns({"route": route(F.col(url), throttled), "_host": urls.host(F.col(url))})
    nth = F.row_number().over(Window.partitionBy("_host").orderBy(id_col, url))
    slow = routed.filter("route = 'rate_limited'").withColumn("start_offset_s", (nth - 1) / rate)
    free = routed.filter("route <> 'rate_limited'").withColumn("start_offset_s", F.lit(0.0))
    return slow.unionByName(free).drop("_host")


def outcome(code: Column, error: Column, has_url: Column) -> Column:
    """200 ok, 429 rate_limited, other codes http_N, a timeout, or the first characters of the error."""
    return (
        F.when(~has_url, "no_url")
        .when(error == "timeout", "timeout")
        .when(error.isNotNull(), F.concat(F.lit("error:"), error_text(error)))
        .when(code == 200, "ok")
        .when(code == 429, "rate_limited")
        .otherwise(F.concat(F.lit("http_"), code.cast("string")))
    )


Fetcher = Callable[[str], tuple[int | None, bytes | None, str | None]]

#: Requests to hosts without a limit that run side by side in a task, and those that one file of the ledger holds; as many
#: files of a task are made one, up to so many bytes.
THREADS, TOGETHER, MERGED = 8, 64, 32 << 20
_LEDGER = "url string, host string, code int, error string, content binary, n_bytes long, fetched_at double"
_FIELDS = pa.schema(
    [("url", pa.string()), ("host", pa.string()), ("code", pa.int32()), ("error", pa.string()), ("content", pa.binary()), ("n_bytes", pa.int64()), ("fetched_at", pa.float64())]
)


class Clock:
    """Wall time, in seconds."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class Simulated(Clock):
    """A time of its own, which starts at 0 in each task and passes by sleeping alone."""

    def __init__(self) -> None:
        self.at = 0.0

    def now(self) -> float:
        return self.at

    def sleep(self, seconds: float) -> None:
        self.at += seconds


class Ledger:
    """What one task has fetched: files in a folder that driver and executors share, one for each batch of requests.

    A file has its name only when it is whole, so a killed task leaves what it had finished and nothing else. ``TOGETHER``
    files are made one, whose name is there before the others go, so their number stays small however many requests there are;
    a task that is killed in between leaves rows twice, which readers take once.
    """

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        #: files that are yet to be made one, by how often that was done to them; their bytes, up to MERGED
        self.levels: list[list[tuple[str, pa.Table]]] = []
        self.sizes: list[int] = []

    def finished(self) -> pa.Table:
        """(url, host, fetched_at) of all requests in the folder."""
        columns = ["url", "host", "fetched_at"]
        while True:
            found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
            try:
                tables = [pq.read_table(f.path, columns=columns, filesystem=self.files, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
            except FileNotFoundError:  # an attempt that is being killed has just made it part of another
                continue
            return pa.concat_tables(tables) if tables else _FIELDS.empty_table().select(columns)

    def add(self, rows: list[tuple]) -> None:
        if not self.levels:
            self.files.create_dir(self.folder)
        self._keep(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS), 0)

    def _keep(self, table: pa.Table, level: int) -> None:
        name = f"{self.folder}/{uuid.uuid4().hex}"
        pq.write_table(table, f"{name}.tmp", filesystem=self.files, use_dictionary=False, write_statistics=False)
        self.files.move(f"{name}.tmp", f"{name}.parquet")
        if level == len(self.levels):
            self.levels.append([])
            self.sizes.append(0)
        held = self.levels[level]
        held.append((f"{name}.parquet", table))
        self.sizes[level] += table.nbytes
        if self.sizes[level] <= MERGED and len(held) < TOGETHER:
            return
        if self.sizes[level] <= MERGED:
            self._keep(pa.concat_tables([own for _, own in held]).combine_chunks(), level + 1)
            for path, _ in held:
                self.files.delete_file(path)
        self.levels[level], self.sizes[level] = [], 0


def _request(fetcher: Fetcher, url: str) -> tuple[int | None, str | None, bytes | None, int]:
    try:
        code, content, error = fetcher(url)
    except TimeoutError:
        code, content, error = None, None, "timeout"
    except Exception as e:
        code, content, error = None, None, str(e)
    return code, error, content, len(content or b"")


def paced(rows: Iterator[tuple[str, str, float, bool]], fetcher: Fetcher, ledger: Ledger, clock: Clock, began: float, rate: float) -> int:
    """Fetch rows (host, url, start offset, throttled) in their order, but for those in the ledger; how many were fetched.

    A throttled request waits until its offset has passed since ``began``, and for 1 / ``rate`` seconds since the last one to
    its host, that of an earlier attempt of the task included. The others go side by side.
    """
    before = ledger.finished()
    done, last, waiting, n = set(before["url"].to_pylist()), {}, [], 0
    for host, at in zip(before["host"].to_pylist(), before["fetched_at"].to_pylist(), strict=True):
        last[host] = max(at, last.get(host, at))

    def together() -> int:
        at = clock.now()
        with ThreadPoolExecutor(THREADS) as pool:
            found = list(pool.map(lambda x: _request(fetcher, x[1]), waiting))
        ledger.add([(url, host, *x, at) for (host, url), x in zip(waiting, found, strict=True)])
        return len(found)

    for host, url, offset, throttled in rows:
        if url in done:
            continue
        done.add(url)
        if not throttled:
            waiting.append((host, url))
            if len(waiting) == TOGETHER:
                n, waiting = n + together(), []
            continue
        due = max(began + offset, last.get(host, float("-inf")) + 1 / rate)
        if due > clock.now():
            clock.sleep(due - clock.now())
        last[host] = clock.now()
        ledger.add([(url, host, *_request(fetcher, url), last[host])])
        n += 1
    return n + (together() if waiting else 0)


def ledger_table(spark: SparkSession, ledger: str) -> DataFrame:
    """(url, host, code, error, content, n_bytes, fetched_at) of all that was fetched; without any, an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).options(recursiveFileLookup="true", pathGlobFilter="*.parquet").parquet(ledger)


def fetch(planned: DataFrame, fetcher: Fetcher, url: str, id_col: str, parallel: int = 64, ledger: str | None = None, clock: Clock | None = None, rate: float = RATE) -> DataFrame:
    """(id, image_status, n_bytes, content, fetched_at) of rows that ``plan`` made, by a function url -> (code, content, error).

    Each url is fetched once. A throttled host's urls are one task's, as one limiter must see them all; its task streams
    through them in the order of their offsets and waits for each, while hosts without a limit are dealt over ``parallel``
    tasks. What is fetched goes to the ``ledger``, a folder that driver and executors share (Arrow must be able to write
    there); a task that is started again skips what its folder in the ledger has, and a call with the same ledger fetches
    only what no earlier call has; calls with the same ledger must not run at the same time. ``fetched_at`` is the clock's
    time of the request.
    """
    spark, clock = planned.sparkSession, clock or Clock()
    ledger = ledger or shared_path(spark, "ledger")
    slim = planned.select(F.col(id_col).cast("long").alias(id_col), F.col(url).alias("url"), "route", "start_offset_s")
    wanted = slim.filter("route <> 'no_url'").groupBy("url").agg(F.min("start_offset_s").alias("offset"), F.first("route").alias("route"))
    wanted = wanted.join(ledger_table(spark, ledger).select("url"), "url", "left_anti").withColumn("host", urls.host(F.col("url")))
    columns = ["host", "url", "offset", (F.col("route") == "rate_limited").alias("throttled")]
    fast = wanted.filter("route = 'unrestricted'").repartition(parallel).select(*columns)
    # what earlier calls fetched makes no gaps: a host's offsets begin anew
    nth = F.row_number().over(Window.partitionBy("host").orderBy("offset", "url"))
    slow = wanted.filter("route = 'rate_limited'").withColumn("offset", (nth - 1) / F.lit(rate))
    slow = slow.repartition(parallel, "host").sortWithinPartitions("offset", "host").select(*columns)
    began, run_folder = clock.now(), f"{ledger}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        own = Ledger(f"{run_folder}/{TaskContext.get().partitionId()}")
        yield pa.RecordBatch.from_arrays([pa.array([paced(rows, fetcher, own, clock, began, rate)], pa.int64())], names=["n"])

    slow.union(fast).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    got = ledger_table(spark, ledger).dropDuplicates(["url"]).join(slim.filter("route <> 'no_url'"), "url")
    status = outcome(F.col("code"), F.col("error"), F.lit(True))
    none = slim.filter("route = 'no_url'").select(id_col, F.lit("no_url").alias("image_status"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("double").alias("fetched_at"))
    return got.select(id_col, status.alias("image_status"), "n_bytes", F.when(status == "ok", F.col("content")).alias("content"), "fetched_at").union(none)


def fill_missing(rows: DataFrame, fetcher: Fetcher, url: str, id_col: str, throttled: list[str], ledger: str | None = None, clock: Clock | None = None) -> DataFrame:
    """Fetch only rows that have a url and no image yet."""
    wanted = rows.filter(F.col("image").isNull() & filled(F.col(url)).isNotNull())
    got = fetch(plan(wanted, url, id_col, throttled), fetcher, url, id_col, ledger=ledger, clock=clock).select(id_col, F.col("content").alias("_new"))
    return rows.join(got, id_col, "left").withColumn("image", F.coalesce("image", "_new")).drop("_new")
