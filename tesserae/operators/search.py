"""Exact nearest-neighbour search, enrichment of hits, and scopes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.vectors import METRICS
from tesserae.sources.shared import shared_path, written

#: Queries whose distances to some vectors are computed at once.
QUERY_BLOCK = 4096
#: Bytes of query vectors (32 bits a number) that are searched for in one pass over the corpus; more are taken in blocks of
#: about so many, one pass each. A task holds a block and its best hits.
QUERY_BYTES = 256 << 20
#: Vectors that are compared with a block at once, pairs whose distances are settled at once, and hits that the queries of a cell that
#: are searched for together have at most, but for a single query.
CHUNK, PAIRS, KEPT = 1024, 1 << 17, 1 << 18
#: Distances are reported with this many places, which also decides what is a tie.
PLACES = 6
#: The labels of the scopes and their keys.
SCOPES = {"All Sources": "all", "URL-Available Only": "url_only", "iNaturalist Only": "inaturalist", "Training Only": "training"}


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((q - v) ** 2).sum(-1)
    product = (q * v).sum(-1)
    if metric == "ip":
        return -product
    sizes = np.linalg.norm(q, axis=-1) * np.linalg.norm(v, axis=-1)
    return 1 - np.divide(product, sizes, out=np.zeros_like(product), where=sizes > 0)


def _near(q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances of all queries (rows) to all vectors by one matrix product, and how far off they may be."""
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return 1 - (q @ v.T), 1e-9
    a, b = (q**2).sum(1), (v**2).sum(1)
    scale = float(a.max(initial=0.0) + b.max(initial=0.0))
    d = a[:, None] + b[None] - 2 * q @ v.T if metric == "l2" else -(q @ v.T)
    return d, 1e-12 * q.shape[1] * (1 + scale)


def _first_of_each(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Which hits are among the ``k`` of their query that are least by distance, then id."""
    order = np.lexsort((i, d, q))
    q = q[order]
    head = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    at = np.arange(len(q))
    return order[at - np.maximum.accumulate(np.where(head, at, 0)) < k]


class Best:
    """The best ``k`` of each query among the vectors seen so far, by rounded distance and id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries.astype(np.float64), k, metric
        self.worst = np.full(len(queries), np.inf)  # the distance of the last of k
        self.hits = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for lo in range(0, len(ids), CHUNK):
            self._add(ids[lo : lo + CHUNK], vectors[lo : lo + CHUNK])

    def near(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances of all queries to these vectors, and how far off they may be."""
        return _near(self.q, v, self.metric)

    def exact(self, r: np.ndarray, v: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The distances of queries ``r`` to vectors ``c``."""
        return _exact(self.q[r], v[c], self.metric)

    def _add(self, ids: np.ndarray, v: np.ndarray) -> None:
        # of equal vectors, only the k of least id can be among the best
        order = np.lexsort(ids[None])
        _, same = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        own = order[_first_of_each(same, np.zeros(len(ids)), ids[order], self.k)]
        ids, v = ids[own], v[own]
        d, off = self.near(v)
        if len(ids) >= self.k:
            reach = np.minimum(self.worst, np.partition(d, self.k - 1, 1)[:, self.k - 1])
        else:
            reach = self.worst
        # every vector that may come before the k-th after rounding
        rows, columns = np.nonzero(d <= reach[:, None] + 2 * off + 10.0**-PLACES)
        for lo in range(0, len(rows), PAIRS):
            r, c = rows[lo : lo + PAIRS], columns[lo : lo + PAIRS]
            exact = self.exact(r, v, c, d).round(PLACES) + 0.0
            q, d_, i = (np.concatenate(x) for x in zip(self.hits, (r, exact, ids[c]), strict=True))
            keep = _first_of_each(q, d_, i, self.k)
            self.hits = q[keep], d_[keep], i[keep]
        n = np.bincount(self.hits[0], minlength=len(self.q))
        full = n >= self.k
        self.worst[full] = self.hits[1][np.cumsum(n)[full] - 1]


_HITS = "query_id long, vec_id long, distance double"


def _batch(names: np.ndarray, best: Best) -> pa.RecordBatch:
    q, d, i = best.hits
    return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(i), pa.array(d)], names=["query_id", "vec_id", "distance"])


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, vec_id, distance, rank) of the ``k`` nearest vectors of each query, ties by id.

    ``queries``: (query_id, query_vec); ``corpus``: (vec_id, embedding). Each task keeps its best k per query while it
    streams through the corpus by matrix products, so what is shuffled is tasks x queries x k rows. Distances are
    recomputed by differences for all that may be chosen and rounded to ``PLACES`` places, which also settles the order:
    equal ones, however many, go by id. Rows without a vector are in no result; a dimension that differs is an error.
    Queries of a repeated id count as one with the vectors of all. Up to ``QUERY_BYTES`` of queries are broadcast for one pass
    over the corpus; more are written once, dealt into blocks of equal size, and there is a pass for each block.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    queries = queries.select("query_id", "query_vec").filter("query_id is not null and query_vec is not null")
    size = queries.agg(F.coalesce(F.sum(4 * F.size("query_vec").cast("long")), F.lit(0))).first()[0]
    if size <= QUERY_BYTES:
        return ranked(_search_block(queries, corpus, k, metric), k)
    blocks, found = -(-size // QUERY_BYTES), None
    path = shared_path(queries.sparkSession, "query-blocks")
    # by the row, not by the id, which may be repeated
    dealt = queries.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    dealt = queries.sparkSession.read.schema(dealt.schema).parquet(path)
    corpus = written(corpus.select("vec_id", "embedding"), "search-corpus")  # its own joins are made once, not for each block
    for block in range(blocks):
        one = _search_block(dealt.filter(F.col("block") == block).drop("block"), corpus, k, metric)
        found = one if found is None else found.union(one)
    return ranked(found, k)


def _search_block(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    block = queries.toArrow()
    if len({n.as_py() for n in pc.unique(pc.list_value_length(block["query_vec"]))}) > 1:
        raise ValueError("queries differ in dimension")
    single = pa.types.is_float32(block["query_vec"].type.value_type)
    q = _matrix(block["query_vec"]).astype(np.float32 if single else np.float64) if len(block) else np.zeros((0, 1))
    shared = corpus.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        parts = [(names[lo : lo + QUERY_BLOCK], Best(q[lo : lo + QUERY_BLOCK], k, metric)) for lo in range(0, len(names), QUERY_BLOCK)]
        for batch in batches:
            if len(batch) and parts:
                vectors = batch.column(1)
                if pc.any(pc.not_equal(pc.list_value_length(vectors), q.shape[1])).as_py():
                    raise ValueError(f"queries have dimension {q.shape[1]}, and a vector of the corpus has another")
                ids, v = batch.column(0).to_numpy(), _matrix(vectors)
                for _, best in parts:
                    best.add(ids, v)
        for own, best in parts:
            yield _batch(own, best)

    rows = corpus.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null and embedding is not null")
    return rows.mapInArrow(run, _HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest hits of each query with their 1-based rank."""
    nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(nearest).cast("long")).filter(F.col("rank") <= k)


def in_scope(scope: str, publisher: str = "iNaturalist", dataset: str = "gbif") -> Column:
    """The predicate of a scope, named by its label or its key. A null flag is not in scope; an unknown scope is all."""
    key = SCOPES.get(scope, scope)
    url = F.coalesce("has_url", F.lit(False))
    if key == "url_only":
        return url
    if key == "inaturalist":
        named = F.contains(F.coalesce("publisher", F.lit("")), F.lit(publisher))
        return url & F.coalesce(F.col("source_dataset") == dataset, F.lit(False)) & named
    if key == "training":
        return F.coalesce("in_training", F.lit(False))
    return F.lit(True)


def enrich(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits with their metadata. The empty slot (-1) and hits without metadata drop out; ranks stay."""
    return hits.filter("vec_id <> -1").join(metadata, hits["vec_id"] == metadata["id"]).drop("id")


#: The columns of a row of metadata, in order.
COLUMNS = [
    "id",
    "uuid",
    "kingdom",
    "phylum",
    "class",
    "order",
    "family",
    "genus",
    "species",
    "common_name",
    "source_dataset",
    "source_id",
    "publisher",
    "img_type",
    "basisOfRecord",
    "url_prefix_id",
    "identifier_suffix",
    "has_url",
    "in_training",
]


def projected(metadata: DataFrame) -> DataFrame:
    """The columns of ``COLUMNS``, in that order; those that a table lacks are null texts."""
    have = set(metadata.columns)
    return metadata.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def lookup(metadata: DataFrame, ids: list[int] | DataFrame, key: str = "id") -> DataFrame:
    """The rows of these ids: a list becomes a filter that the scan gets, a table (``key``) a join."""
    if isinstance(ids, DataFrame):
        return metadata.join(ids.select(key), key, "left_semi")
    return metadata.filter(F.col(key).isin(ids))


def search(
    queries: DataFrame, corpus: DataFrame, metadata: DataFrame, top_n: int = 10, factor: int = 3, scope: Column | None = None
) -> DataFrame:
    """Fetch ``top_n`` x ``factor`` hits, drop those out of scope, and keep ``top_n`` at most: there may be fewer."""
    fetched = enrich(top_k(queries, corpus, top_n * factor), metadata)
    return ranked(fetched.filter(F.lit(True) if scope is None else scope).drop("rank"), top_n)


def search_within(queries: DataFrame, corpus: DataFrame, metadata: DataFrame, top_n: int, scope: Column) -> DataFrame:
    """Search only vectors in scope, so that ``top_n`` are found wherever there are so many."""
    inside = corpus.join(metadata.filter(scope).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    return enrich(top_k(queries, inside, top_n), metadata)
