"""A stored index: cells, codebooks, and vectors with their codes, in files by bucket of cells.

A folder holds the tables ``cells`` (cell, center, bucket) and, with codes, ``books``; ``data``, a folder for each batch with one
for each bucket, sorted by cell; ``sizes``, the rows of each batch and cell; and ``commits``, the manifest. A batch is read
once its row is in the manifest, which is written last: what a failed append leaves is not read, and is replaced when the batch
is appended again. A batch that is committed already is left alone, so appending twice leaves one copy. Writers must not
run at the same time.

A search reads the buckets of the cells that it probes: these are a broadcast table that is joined on the bucket, by which the
files are partitioned, so Spark prunes them before it reads (dynamic partition pruning). Vectors may be stored in their
nearest ``copies`` cells, which finds more with the same number of probes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import ivf
from tesserae.operators.search import Best, _matrix, enrich, ranked
from tesserae.sources.shared import checked_broadcast, written

BUCKETS = 64
_COMMIT = "name string, n_vectors long, replaces array<string>"


def _folder(batch: str) -> str:
    return hashlib.md5(batch.encode()).hexdigest()


def create(path: str, cells: DataFrame, coarse: DataFrame | None = None, books: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """An empty index of these cells (cell, center), or of two levels of them: (coarse, center) and (cell, coarse, center).

    With two levels, the cells of a coarse one share a bucket, as a query that probes one of them probes others, too.
    """
    of = F.col("coarse") if coarse is not None else F.col("cell")
    cells.withColumn("bucket", F.pmod(of, F.lit(buckets)).cast("int")).write.mode("overwrite").parquet(f"{path}/cells")
    for name, table in (("coarse", coarse), ("books", books)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    cells.sparkSession.createDataFrame([], _COMMIT).write.mode("overwrite").parquet(f"{path}/commits/batch=none")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_vectors, replaces, batch) of each batch: its name and its folder."""
    return spark.read.schema(f"{_COMMIT}, batch string").parquet(f"{path}/commits")


def live(spark: SparkSession, path: str) -> list[str]:
    """The folders of the batches that are read: those with vectors, committed and not replaced by a compaction."""
    rows = commits(spark, path).select("batch", "n_vectors", "replaces").collect()
    gone = {x for r in rows for x in r["replaces"] or ()}
    return sorted(r["batch"] for r in rows if r["n_vectors"] and r["batch"] not in gone)


def _write(rows: DataFrame, path: str, batch: str, replaces: list[str]) -> None:
    """A batch of (bucket, cell, ...): a file for each bucket, more where Spark finds that a bucket is large."""
    spark, folder = rows.sparkSession, _folder(batch)
    data = f"{path}/data/batch={folder}"
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "cell", "vec_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(data)
    made = spark.read.schema("cell int").parquet(data)
    made.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes/batch={folder}")
    n = spark.read.parquet(f"{path}/sizes/batch={folder}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    row = spark.createDataFrame([(batch, n, replaces)], _COMMIT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={folder}")


def append(path: str, batch: str, vectors: DataFrame, copies: int = 1, beam: int = 8) -> bool:
    """Add (vec_id, embedding) as a batch of this name; False if there is one already. Rows without a vector have no cell."""
    spark = vectors.sparkSession
    if _folder(batch) in {r["batch"] for r in commits(spark, path).select("batch").collect()}:
        return False
    cells = _table(spark, path, "cells")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    if _has(spark, f"{path}/coarse"):
        rows = ivf.assign_beam(rows, _table(spark, path, "coarse"), cells.select("cell", "coarse", "center"), beam, copies)
    else:
        rows = ivf.assign_cells(rows, cells.select("cell", "center"), copies)
    if _has(spark, f"{path}/books"):
        rows = ivf.encode(rows, _table(spark, path, "books"), keep=True)
    _write(rows.join(F.broadcast(cells.select("cell", "bucket")), "cell"), path, batch, [])
    return True


def compact(spark: SparkSession, path: str, batch: str) -> bool:
    """Write all batches as one, whose commit replaces them; their files stay until ``vacuum``. False if the name is taken."""
    folders = live(spark, path)
    if not folders or _folder(batch) in {r["batch"] for r in commits(spark, path).select("batch").collect()}:
        return False
    _write(scan(spark, path).drop("batch"), path, batch, folders)
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the data of batches that are not read: replaced ones, and what failed appends left."""
    kept, n = set(live(spark, path)), 0
    for part in ("data", "sizes"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(at) if files.exists(at) else []:
            if status.getPath().getName().removeprefix("batch=") not in kept:
                files.delete(status.getPath(), True)
                n += part == "data"
    return n


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding, cell[, codes], batch, bucket) of the batches that are read."""
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={b}" for b in live(spark, path)])


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n): the rows of each cell, from the tables of the batches."""
    return spark.read.parquet(*[f"{path}/sizes/batch={b}" for b in live(spark, path)]).groupBy("cell").agg(F.sum("n").alias("n"))


def probed(spark: SparkSession, path: str, queries: DataFrame, nprobe: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, query_vec, cell, bucket) of each query's nearest cells, and the rows of the index in any of these."""
    cells = _table(spark, path, "cells")
    asked = ivf.probes(queries, cells.select("cell", "center"), nprobe).join(F.broadcast(cells.select("cell", "bucket")), "cell")
    asked = written(asked, "probes")
    # the condition tells Spark that the table selects, without which it doesn't prune by it
    wanted = asked.select("bucket", "cell").distinct().filter("bucket >= 0")
    return asked, scan(spark, path).join(checked_broadcast(wanted), ["bucket", "cell"], "left_semi")


def search(path: str, queries: DataFrame, k: int, nprobe: int, codes: bool = False, shortlist: int = 0) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the ``k`` nearest in each query's ``nprobe`` nearest cells.

    By exact distance, or with ``codes`` by looked-up distance, where the best ``shortlist`` x k, if given, are settled by
    exact distance. With all cells probed, exact distances give what ``search.top_k`` gives.
    """
    spark = queries.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vec").filter("query_id is not null and query_vec is not null")
    if not live(spark, path):
        return ranked(spark.createDataFrame([], "query_id long, vec_id long, distance double"), k)
    asked, held = probed(spark, path, queries, nprobe)
    pairs, known = asked.select("query_id", "query_vec", "cell"), sizes(spark, path)
    if not codes:
        return ivf.by_cell(pairs, held.select("cell", "vec_id", "embedding"), "embedding", k, lambda q: Best(q, k, "l2"), _matrix, known)
    books, most = spark.sparkContext.broadcast(ivf._books(_table(spark, path, "books"))), max(1, shortlist) * k
    found = ivf.by_cell(pairs, held.select("cell", "vec_id", "codes"), "codes", most, lambda q: ivf.CodeBest(q, most, books.value), ivf._code_matrix, known)
    if not shortlist:
        return found
    short = checked_broadcast(written(found.select("query_id", "vec_id"), "shortlist"))
    return ivf.settle(short, queries, held.select("vec_id", "embedding"), k)


def nearest_distances(path: str, queries: DataFrame, ranks: int) -> DataFrame:
    """``ivf.nearest_distances`` by the codes of all cells."""
    spark = queries.sparkSession
    if not live(spark, path):
        return spark.createDataFrame([], "query_id long, distance double, n long")
    return ivf.nearest_distances(queries, scan(spark, path), _table(spark, path, "books"), ranks)


def search_scoped(path: str, queries: DataFrame, metadata: DataFrame, top_n: int, nprobe: int, factor: int = 3, scope: Column | None = None) -> DataFrame:
    """``search.search`` by the index: fetch ``top_n`` x ``factor`` hits, drop those out of scope, and keep ``top_n`` at most."""
    fetched = enrich(search(path, queries, top_n * factor, nprobe), metadata)
    return ranked(fetched.filter(F.lit(True) if scope is None else scope).drop("rank"), top_n)


def search_within(path: str, queries: DataFrame, metadata: DataFrame, top_n: int, scope: Column, nprobe: int = 4) -> DataFrame:
    """The exact ``top_n`` in scope of each query, with ``probed``, the cells that were visited for it.

    Probes grow fourfold until a query has ``top_n`` hits in scope and no cell that is left can hold a nearer one: a vector of a cell
    is no nearer to the query than the cell's center is, less the radius of the cell. Radii are those of all stored vectors.
    """
    spark = queries.sparkSession
    cells = _table(spark, path, "cells").select("cell", "center", "bucket")
    total = cells.count()
    inside = scan(spark, path).join(metadata.filter(scope).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    inside = written(inside.select("cell", "vec_id", "embedding").join(F.broadcast(cells.select("cell", "center")), "cell"), "in-scope")
    gap = F.sqrt(ivf.distance(F.col("embedding"), F.col("center")))
    radius = written(inside.groupBy("cell").agg(F.max(gap).alias("radius"), F.count("*").alias("n")), "radii")
    open_, done = written(queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vec"), "open-queries"), None
    while True:
        asked = written(ivf.probes(open_, cells.select("cell", "center"), total).join(F.broadcast(cells.select("cell", "center")), "cell"), "bounds")
        near = F.greatest(F.lit(0.0), F.sqrt(ivf.distance(F.col("query_vec"), F.col("center"))) - F.col("radius") - 1e-6)
        # cells in the order of how near a vector of theirs in scope may be; those without any are no matter
        bounded = asked.join(F.broadcast(radius), "cell").withColumn("least", near * near)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("least", "cell"))
        bounded = written(bounded.withColumn("place", order).select("query_id", "query_vec", "cell", "least", "place"), "bounds")
        now = bounded.filter(F.col("place") <= nprobe)
        found = ivf.by_cell(now.select("query_id", "query_vec", "cell"), inside.select("cell", "vec_id", "embedding"), "embedding", top_n, lambda q: Best(q, top_n, "l2"), _matrix, radius)
        found = written(found, "scoped-hits")
        last = found.filter(F.col("rank") == top_n).select("query_id", F.col("distance").alias("worst"))
        rest = bounded.filter(F.col("place") > nprobe).groupBy("query_id").agg(F.min("least").alias("least"))
        left = rest.join(last, "query_id", "left").filter("worst is null or least <= worst + 1e-6").select("query_id")
        left = written(left, "open-ids")
        seen = now.groupBy("query_id").agg(F.count("*").alias("probed"))
        ready = found.join(left, "query_id", "left_anti").join(seen, "query_id")
        done = ready if done is None else done.unionByName(ready)
        if left.isEmpty():
            return enrich(done, metadata)
        open_ = written(open_.join(left, "query_id", "left_semi"), "open-queries")
        nprobe *= 4
