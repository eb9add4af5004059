"""Approximate search: coarse cells, product-quantised codes, probing, recall and index statistics.

The index is tables: ``centroids`` (cell, center), ``codebooks`` (sub, code, center) and ``codes`` (cell, vec_id, ...).
Centroids and codebooks have a size that parameters fix; vectors and codes stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

from tesserae.functions.vectors import distance
from tesserae.operators.numbering import contiguous_ids
from tesserae.operators.search import _HITS, Best, KEPT, PAIRS, PLACES, QUERY_BLOCK, QUERY_BYTES, _batch, _matrix, ranked, top_k
from tesserae.sources.shared import shared_path, written


def _centers(spark: SparkSession, rows: list[np.ndarray], name: str) -> DataFrame:
    matrix = np.stack(rows)
    flat = pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], matrix.ravel())
    return spark.createDataFrame(pa.table({name: pa.array(range(len(matrix)), pa.int32()), "center": flat}))


def train_cells(sample: DataFrame, nlist: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """(cell, center): k-means centroids of a sample of (vec_id, embedding)."""
    rows = sample.orderBy("vec_id").select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=iterations).fit(rows)
    return _centers(sample.sparkSession, model.clusterCenters(), "cell")


#: Vectors of a sample for each center that a task fits, at most.
PER_CENTER = 256


def _fit(v: np.ndarray, k: int, seed: int, iterations: int) -> np.ndarray:
    """Centers of at most k groups of the vectors: far ones to begin with, then Lloyd's steps."""
    v = np.unique(v, axis=0)
    if len(v) <= k:
        return v
    rng = np.random.default_rng(seed)
    centers = [v[rng.integers(len(v))]]
    near = ((v - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        total = near.sum()
        centers.append(v[rng.choice(len(v), p=near / total)] if total > 0 else v[rng.integers(len(v))])
        near = np.minimum(near, ((v - centers[-1]) ** 2).sum(1))
    c = np.stack(centers)
    for _ in range(iterations):
        own = np.concatenate([_apart(v[lo : lo + CHUNK], c).argmin(1) for lo in range(0, len(v), CHUNK)])
        many = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(v[order], np.minimum(np.cumsum(many) - many, len(v) - 1), axis=0)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c)
    return c


def train_two_levels(sample: DataFrame, coarse: int, fine: int, seed: int = 42, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """(coarse, center) and (cell, coarse, center): ``coarse`` cells by one k-means, then up to ``fine`` cells in each by a
    task of its own. So 256 x 256 cells need no fit of 65,536 centers and no driver that holds them.

    A coarse cell's task gets ``PER_CENTER`` vectors for each center at most, those of least hash.
    """
    top = written(train_cells(sample, coarse, seed, iterations).withColumnRenamed("cell", "coarse"), "coarse-cells")
    dealt = assign_cells(sample.select("vec_id", "embedding"), top.withColumnRenamed("coarse", "cell")).withColumnRenamed("cell", "coarse")
    dealt = stratified_sample(written(dealt, "coarse-sample"), "coarse", 1.0, fine * PER_CENTER, "vec_id", seed)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        v = _matrix(table.sort_by("vec_id")["embedding"])
        c = _fit(v, fine, seed + own, iterations)
        flat = pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1], c.ravel())
        return pa.table({"cell": pa.array(own * fine + np.arange(len(c)), pa.int32()), "coarse": pa.array([own] * len(c), pa.int32()), "center": flat})

    return top, written(dealt.groupBy("coarse").applyInArrow(run, "cell int, coarse int, center array<double>"), "fine-cells")


def label_cells(corpus: DataFrame, label: str = "label") -> DataFrame:
    """(cell, center): the mean vector of each label, as cells that need no training."""
    place = corpus.select(F.col(label).cast("int").alias("cell"), F.posexplode("embedding").alias("at", "x"))
    mean = place.groupBy("cell", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("cell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("center")
    )


#: Rows whose distances to centers are computed at once, distances that are held at once, and bytes of centers (64 bits a number)
#: that may be broadcast; beyond that, rows are joined with centers by coarse cell.
CHUNK, HELD, CENTER_BYTES = 1024, 1 << 22, 256 << 20


def _apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all v to all c, up to the length of v, which is the same for all c."""
    return (c**2).sum(1)[None] - 2 * v @ c.T


def _least(d: np.ndarray, n: int) -> np.ndarray:
    """The columns of the n least values of each row, in order; of equal ones, those of least number."""
    return np.argsort(d.round(9), axis=1, kind="stable")[:, :n] if n > 1 else d.round(9).argmin(1)[:, None]


def _fits(centers: DataFrame) -> bool:
    size = centers.agg(F.coalesce(F.sum(8 * F.size("center").cast("long")), F.lit(0))).first()[0]
    return size <= CENTER_BYTES


def _center_table(centers: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    table = centers.select(name, "center").orderBy(name).toArrow()
    return table[name].to_numpy(), _matrix(table["center"])


def _cells_of(corpus: DataFrame, choose: Callable[[np.ndarray], np.ndarray], copies: int) -> DataFrame:
    """``corpus`` with a row for each cell that ``choose`` gives for the vectors of a chunk; a row without a vector has none."""
    at = corpus.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(at).is_valid()) if batch.column(at).null_count else batch
            for lo in range(0, len(batch), CHUNK):
                part = batch.slice(lo, CHUNK)
                cells = choose(_matrix(part.column(at)))
                row, place = np.nonzero(cells >= 0)
                columns = part.columns if copies == 1 and len(row) == len(part) else [c.take(pa.array(row)) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells[row, place].astype(np.int32))], names=[*batch.schema.names, "cell"])

    return corpus.mapInArrow(run, StructType([*corpus.schema.fields, StructField("cell", IntegerType())]))


def assign_cells(corpus: DataFrame, centroids: DataFrame, copies: int = 1) -> DataFrame:
    """``corpus`` with the nearest ``cell`` of each vector (of equally near ones, the smallest), or a row for each of the
    nearest ``copies``. Centers beyond ``CENTER_BYTES`` are an error: use two levels."""
    if not _fits(centroids):
        raise ValueError(f"centers of more than {CENTER_BYTES} bytes: use train_two_levels and assign_beam")
    shared = corpus.sparkSession.sparkContext.broadcast(_center_table(centroids, "cell"))

    def choose(v: np.ndarray) -> np.ndarray:
        cells, c = shared.value
        step = max(1, HELD // len(c))
        return np.concatenate([cells[_least(_apart(v[lo : lo + step], c), copies)] for lo in range(0, len(v), step)])

    return _cells_of(corpus, choose, copies)


def assign_beam(corpus: DataFrame, coarse: DataFrame, cells: DataFrame, beam: int = 8, copies: int = 1) -> DataFrame:
    """As ``assign_cells``, for two levels: only the cells in the ``beam`` nearest coarse cells are compared.

    Fine centers up to ``CENTER_BYTES`` are broadcast. Beyond that, a vector goes to the tasks of its ``beam`` coarse cells,
    and comes back with its cells.
    """
    if not _fits(cells):
        asked = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
        held = cells.select(F.col("coarse").alias("cell"), F.col("cell").cast("long").alias("vec_id"), F.col("center").alias("embedding"))
        found = search_cells(asked, held, coarse.withColumnRenamed("coarse", "cell"), copies, beam)
        return corpus.join(found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").cast("int").alias("cell")), "vec_id").select(*corpus.columns, "cell")
    fine = cells.orderBy("coarse", "cell").select("coarse", "cell", "center").toArrow()
    centers = (fine["coarse"].to_numpy(), fine["cell"].to_numpy(), _matrix(fine["center"]))
    shared = corpus.sparkSession.sparkContext.broadcast((_center_table(coarse, "coarse"), centers))

    def choose(v: np.ndarray) -> np.ndarray:
        (names, tops), (of, cells_, c) = shared.value
        near = names[_least(_apart(v, tops), min(beam, len(names)))]
        best = np.full((len(v), copies), np.inf), np.full((len(v), copies), -1)
        for own in np.unique(near):
            lo, hi = np.searchsorted(of, [own, own + 1])
            rows = np.flatnonzero((near == own).any(1))
            if lo == hi:
                continue
            d = np.concatenate([best[0][rows], _apart(v[rows], c[lo:hi]).round(9)], 1)
            cell = np.concatenate([best[1][rows], np.tile(cells_[lo:hi], (len(rows), 1))], 1)
            order = np.lexsort((cell, d))[:, :copies]
            best[0][rows], best[1][rows] = np.take_along_axis(d, order, 1), np.take_along_axis(cell, order, 1)
        return best[1]

    return _cells_of(corpus, choose, copies)


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, query_vec, cell) of the ``nprobe`` nearest cells of each query."""
    if _fits(centroids):
        shared = queries.sparkSession.sparkContext.broadcast(_center_table(centroids, "cell"))

        def choose(v: np.ndarray) -> np.ndarray:
            cells, c = shared.value
            step = max(1, HELD // len(c))
            parts = [(_apart(x, c) + (x**2).sum(1)[:, None]).round(PLACES) for x in (v[lo : lo + step] for lo in range(0, len(v), step))]
            return np.concatenate([cells[np.argsort(d, axis=1, kind="stable")[:, :nprobe]] for d in parts])

        rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").alias("embedding"))
        found = _cells_of(rows.filter("query_id is not null"), choose, nprobe)
        return found.select("query_id", F.col("embedding").alias("query_vec"), "cell")
    found = top_k(queries, centroids.select(F.col("cell").cast("long").alias("vec_id"), F.col("center").alias("embedding")), nprobe)
    return found.select("query_id", F.col("vec_id").cast("int").alias("cell")).join(queries, "query_id")


#: Vectors, or queries, of a cell that one task gets, and hits that its queries have at most, but for a single query.
CELL_PART, PART_HITS = 50_000, 1 << 20


def _parts(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(cell, name): in how many parts of ``most`` a cell's rows are dealt. There is a row a cell, so it may be broadcast."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def by_cell(asked: DataFrame, stored: DataFrame, column: str, k: int, make: Callable[[np.ndarray], Best], read: Callable[[pa.ChunkedArray], np.ndarray], sizes: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of each query of (query_id, query_vec, cell) among (cell, vec_id, ``column``) of its cells.

    A cell's queries meet its rows in one task; a cell with many of either is dealt over several. A task keeps the best k of
    each query (``make`` gives what does), so no pair of a query and a row leaves it. ``sizes`` (cell, n): the rows of each
    cell, where they are known.
    """
    counted = stored.groupBy("cell").agg(F.count("*").alias("n")) if sizes is None else sizes
    parts = counted.select("cell", F.ceil(F.col("n") / CELL_PART).cast("int").alias("_v")).filter("_v > 0")
    dealt = F.broadcast(parts.join(_parts(asked, "_q", max(1, min(CELL_PART, PART_HITS // k))), "cell"))  # a row a cell
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.filter(F.col(column).isNotNull()).join(dealt, "cell").withColumn("v", deal("vec_id", "_v")).withColumn("q", every("_q"))
    asked = asked.join(dealt, "cell").withColumn("q", deal("query_id", "_q")).withColumn("v", every("_v"))
    keys = ["cell", "v", "q"]

    def run(wanted: pa.Table, held: pa.Table) -> pa.Table:
        out, block = [], max(1, min(QUERY_BLOCK, KEPT // k))
        ids, v = (held["vec_id"].to_numpy(), read(held[column])) if len(held) else (None, None)
        for lo in range(0, len(wanted) if len(held) else 0, block):
            part = wanted.slice(lo, block)
            best = make(_matrix(part["query_vec"]))
            best.add(ids, v)
            out.append(_batch(part["query_id"].to_numpy(), best))
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())]))

    grouped = asked.select(*keys, F.col("query_id").cast("long"), "query_vec").groupBy(*keys)
    stored = stored.select(*keys, F.col("vec_id").cast("long"), column).groupBy(*keys)
    found = grouped.cogroup(stored).applyInArrow(run, _HITS)
    # a vector that is stored in several cells is found in each; a query of a repeated id may have several distances to it
    return ranked(found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance")), k)


def search_cells(queries: DataFrame, indexed: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Search only the vectors in each query's nearest cells. With all cells probed this equals the exact search."""
    return by_cell(probes(queries, centroids, nprobe), indexed, "embedding", k, lambda q: Best(q, k, "l2"), _matrix)


def train_codebooks(sample: DataFrame, m: int, ksub: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """(sub, code, center): one k-means for each of ``m`` equal slices of the vectors, fitted side by side."""
    spark = sample.sparkSession
    dim = sample.select(F.size("embedding")).first()[0]
    if dim % m:
        raise ValueError(f"dimension {dim} isn't a multiple of {m}")
    width = dim // m
    path = shared_path(spark, "codebook-sample")
    sample.orderBy("vec_id").select("embedding").write.parquet(path)
    rows = spark.read.parquet(path)

    def fit(sub: int) -> list[tuple[int, int, list[float]]]:
        part = rows.select(array_to_vector(F.slice("embedding", sub * width + 1, width)).alias("features"))
        centers = KMeans(k=ksub, seed=seed, maxIter=iterations).fit(part).clusterCenters()
        return [(sub, i, [float(x) for x in c]) for i, c in enumerate(centers)]

    with ThreadPoolExecutor(min(m, 8)) as pool:
        books = [row for part in pool.map(fit, range(m)) for row in part]  # as many numbers as the vectors have, times ksub
    return spark.createDataFrame(books, "sub int, code int, center array<double>")


def _books(codebooks: DataFrame) -> np.ndarray:
    table = codebooks.orderBy("sub", "code").toArrow()
    centers = _matrix(table["center"])
    subs = len(set(table["sub"].to_pylist()))
    return centers.reshape(subs, -1, centers.shape[1])


def encode(corpus: DataFrame, codebooks: DataFrame, keep: bool = False) -> DataFrame:
    """``corpus`` with ``codes`` in place of ``embedding`` (or beside it): the nearest code of each slice."""
    shared = corpus.sparkSession.sparkContext.broadcast(_books(codebooks))
    names = [c for c in corpus.columns if keep or c != "embedding"]
    schema = StructType([*corpus.select(*names).schema.fields, StructField("codes", ArrayType(ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index("embedding"))) if len(batch) else np.zeros((0, books.shape[0] * books.shape[2]))
            v = v.reshape(len(v), books.shape[0], books.shape[2])
            near = [((b**2).sum(1)[None] - 2 * v[:, s] @ b.T).argmin(1) for s, b in enumerate(books)]
            codes = np.stack(near, 1).astype(np.int16)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * books.shape[0]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.ListArray.from_arrays(offsets, codes.ravel())],
                names=[*names, "codes"],
            )

    return corpus.mapInArrow(run, schema)


class CodeBest(Best):
    """The best ``k`` of each query among codes: distances are sums from one table of each query, and are not estimates."""

    def __init__(self, queries: np.ndarray, k: int, books: np.ndarray):
        super().__init__(queries, k, "l2")
        subs, ksub, width = books.shape
        v = self.q.reshape(len(self.q), subs, width)
        self.table = np.empty((subs, ksub, len(v)))
        for s, book in enumerate(books):
            self.table[s] = ((book**2).sum(1)[None] - 2 * v[:, s] @ book.T + (v[:, s] ** 2).sum(1)[:, None]).T

    def near(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        d = np.zeros((len(v), len(self.q)))
        for s in range(v.shape[1]):
            d += self.table[s][v[:, s]]
        return d.T, 0.0

    def exact(self, r: np.ndarray, v: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.maximum(d[r, c], 0.0)


def _code_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _matrix(column).astype(np.int64)


class Distances:
    """The least distances of each query, those that fewer than ``ranks`` vectors are below, and how many are at each."""

    def __init__(self, n: int, ranks: int):
        self.n, self.ranks = n, ranks
        self.worst = np.full(n, np.inf)  # what a distance must not exceed
        self.held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, d: np.ndarray, weight: np.ndarray) -> None:
        """Distances of vectors (rows) to all queries, and how many vectors each row is."""
        reach = self.worst
        if len(d) >= self.ranks and np.isinf(reach).any():
            reach = np.minimum(reach, np.partition(d, self.ranks - 1, 0)[self.ranks - 1])
        rows, columns = np.nonzero(d <= reach + 2 * 10.0**-PLACES)
        for lo in range(0, len(rows), PAIRS):
            r, c = rows[lo : lo + PAIRS], columns[lo : lo + PAIRS]
            found = np.maximum(d[r, c], 0.0).round(PLACES) + 0.0
            self._merge(*(np.concatenate(x) for x in zip(self.held, (c, found, weight[r]), strict=True)))

    def _merge(self, q: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((d, q))
        q, d, n = q[order], d[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (d[1:] != d[:-1])]))
        q, d, n = q[head], d[head], np.add.reduceat(n, head)
        total = np.cumsum(n)
        first = np.searchsorted(q, np.arange(self.n + 1))
        before = total - n - np.concatenate([[0], total])[first[:-1]][q]
        last = (before < self.ranks) & (before + n >= self.ranks)
        self.worst[q[last]] = d[last]
        keep = before < self.ranks
        self.held = q[keep], d[keep], n[keep]


#: Pairs of a query and a vector that are worth a task of their own.
TASK_PAIRS = 1 << 25


def nearest_distances(queries: DataFrame, codes: DataFrame, codebooks: DataFrame, ranks: int) -> DataFrame:
    """(query_id, distance, n): the looked-up distances of each query to all vectors (vec_id, codes) that fewer than ``ranks``
    vectors are below, and how many are at each: of equal distances, however many vectors have them, there is one row.

    A vector that is stored in several cells counts once, and rows of an id that have different codes by the nearest. Vectors
    are dealt by id; a task looks up all pairs of its vectors and the queries, and sends what may be among the least distances
    of a query, about ``ranks`` rows. Up to ``QUERY_BYTES`` of queries are broadcast, more are taken in blocks.
    """
    spark = queries.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vec").filter("query_id is not null and query_vec is not null")
    size, many = queries.agg(F.coalesce(F.sum(4 * F.size("query_vec").cast("long")), F.lit(0)), F.count("*")).first()
    codes = codes.select(F.col("vec_id").cast("long").alias("vec_id"), "codes").filter("vec_id is not null and codes is not null")
    codes = written(codes, "codes")
    n = codes.count()
    parts = max(1, -(-n // CELL_PART), min(-(-n * many // TASK_PAIRS), 2 * spark.sparkContext.defaultParallelism))
    codes = codes.repartition(parts, "vec_id")
    blocks, found = max(1, -(-size // QUERY_BYTES)), None
    if blocks > 1:
        # all vectors of an id in one block
        queries = written(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "query-blocks")
    books = spark.sparkContext.broadcast(_books(codebooks))
    for block in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.col("block") == block).drop("block")
        one = _distances(own, codes, books, ranks)
        found = one if found is None else found.union(one)
    summed = found.groupBy("query_id", "distance").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy("query_id").orderBy("distance")) - F.col("n")
    return summed.withColumn("_below", below).filter(F.col("_below") < ranks).drop("_below")


def _distances(queries: DataFrame, codes: DataFrame, books: Broadcast, ranks: int) -> DataFrame:
    block = queries.orderBy("query_id").toArrow()
    names, heads = np.unique(block["query_id"].to_numpy(), return_index=True)
    shared = queries.sparkSession.sparkContext.broadcast((names, np.append(heads, len(block)), _matrix(block["query_vec"]) if len(block) else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heads, q = shared.value
        batches = [b for b in batches if len(b)]
        if not batches or not len(names):
            return
        ids, v = np.concatenate([b.column(0).to_numpy() for b in batches]), np.concatenate([_matrix(b.column(1)).astype(np.int16) for b in batches])
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        head = np.concatenate([[True], ids[1:] != ids[:-1]])
        once = head & np.append(head[1:], True)
        # vectors of the same codes are at the same distances; those of an id that has several rows are taken by the nearest
        same, weight = np.unique(v[once], axis=0, return_counts=True)
        again, starts = v[~once].astype(np.int64), np.flatnonzero(head[~once])
        same, lo = same.astype(np.int64), 0
        while lo < len(names):
            hi = max(lo + 1, int(np.searchsorted(heads, heads[lo] + QUERY_BLOCK, "right")) - 1)
            table = CodeBest(q[heads[lo] : heads[hi]], 1, books.value)
            of, least = heads[lo:hi] - heads[lo], Distances(hi - lo, ranks)
            step = max(1, HELD // max(1, len(table.q)))

            def far(rows: np.ndarray) -> np.ndarray:
                d = table.near(rows)[0].T
                return d if len(of) == d.shape[1] else np.minimum.reduceat(d, of, axis=1)

            for at in range(0, len(same), step):
                least.add(far(same[at : at + step]), weight[at : at + step])
            for at in range(0, len(starts), step):
                ends = np.append(starts, len(again))[at : at + step + 1]
                near = np.stack([far(again[a:b]).min(0) for a, b in zip(ends, ends[1:], strict=False)])
                least.add(near, np.ones(len(near), np.int64))
            own, d, n = least.held
            yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi][own]), pa.array(d), pa.array(n)], names=["query_id", "distance", "n"])
            lo = hi

    return codes.mapInArrow(run, "query_id long, distance double, n long")


def settle(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, vec_id, cell) in the order of exact distances to ``vectors`` (cell, vec_id, embedding)."""
    near = found.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(queries, "query_id")
    exact = near.select("query_id", "vec_id", F.round(distance(F.col("query_vec"), F.col("embedding")), PLACES).alias("distance"))
    return ranked(exact.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance")), k)


def search_codes(
    queries: DataFrame,
    codes: DataFrame,
    centroids: DataFrame,
    codebooks: DataFrame,
    k: int,
    nprobe: int,
    rerank: DataFrame | None = None,
    shortlist: int = 4,
) -> DataFrame:
    """Probe cells and add up looked-up distances of codes; with ``rerank`` (vec_id, embedding), the best
    ``shortlist`` x k are settled by exact distance. Looking up and choosing is done in the cell's task."""
    books, most = queries.sparkSession.sparkContext.broadcast(_books(codebooks)), k if rerank is None else k * shortlist
    found = by_cell(probes(queries, centroids, nprobe), codes, "codes", most, lambda q: CodeBest(q, most, books.value), _code_matrix)
    return found if rerank is None else settle(found, queries, rerank, k)


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact ``k`` that was found."""
    hit = exact.filter(F.col("rank") <= k).join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def slice_books(cells: DataFrame, m: int) -> DataFrame:
    """(sub, code, center): the slices of given centers as codebooks, which then need no training."""
    width = F.size("center") / m
    subs = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.struct(s.alias("sub"), F.slice("center", (s * width + 1).cast("int"), width.cast("int")).alias("part")))
    return cells.select(F.col("cell").alias("code"), F.inline(subs)).select("sub", "code", F.col("part").alias("center"))


def merge_shards(*shards: DataFrame) -> DataFrame:
    """Index parts hold ids that are valid everywhere, so merging is a union by name."""
    out = shards[0]
    for shard in shards[1:]:
        out = out.unionByName(shard)
    return out


def index_stats(indexed: DataFrame) -> DataFrame:
    """Per index: vectors, cells in use, and the least, mean and greatest number of vectors in a cell."""
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    return cells.agg(
        F.sum("n").alias("n_vectors"),
        F.count("*").alias("n_cells"),
        F.min("n").alias("least"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.max("n").alias("most"),
    )


def corpus_stats(corpus: DataFrame) -> DataFrame:
    size = F.size("embedding")
    return corpus.agg(F.count("*").alias("n_vectors"), F.min(size).cast("long").alias("least_dim"), F.max(size).cast("long").alias("most_dim"))


def stratified_sample(rows: DataFrame, by: str, fraction: float, cap: int, id_col: str, seed: int = 42) -> DataFrame:
    """In each class, ceil(fraction x n) rows and ``cap`` at most, in the order of md5(id, seed).

    The order within a class is a rank; classes that are hot are ranked in two steps: by blocks of the hash first.
    """
    keyed = rows.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}"))))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, 2))
    blocks = keyed.groupBy(F.col(by).alias("_c"), "_b").agg(F.count("*").alias("_n"))
    of = Window.partitionBy("_c").orderBy("_b")
    blocks = blocks.select(
        "_c",
        "_b",
        (F.sum("_n").over(of) - F.col("_n")).alias("_before"),
        F.least(F.lit(cap), F.ceil(F.lit(fraction) * F.sum("_n").over(Window.partitionBy("_c")))).alias("_take"),
    )
    near = keyed.join(blocks, keyed[by].eqNullSafe(blocks["_c"]) & (keyed["_b"] == blocks["_b"])).drop(blocks["_b"])
    rank = F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", id_col))
    return (
        near.filter("_before < _take")
        .withColumn("_rank", F.col("_before") + rank)
        .filter("_rank <= _take")
        .drop("_h", "_b", "_c", "_before", "_take", "_rank")
    )
