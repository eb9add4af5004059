"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words (without case and marks at the edges), word pairs, and pairs with one or two
words between them, hashed to ``SLOTS`` slots. FTRL-proximal gives every coordinate its own rate, and its L1 term leaves
most weights at exactly zero, so the weights that are broadcast are few and never more than ``SLOTS``.

The model is fitted on labelled rows, at most ``MOST_LABELLED`` of them (those of least hash). They are dealt to
groups of about ``SHARD_ROWS``; each group runs FTRL over its rows, Spark averages the states z and n of all groups coordinate by
coordinate, none left out, and the next of ``ROUNDS`` rounds starts from the average. Groups send what has changed, packed
by ranges of ``RANGE`` slots; the average has at most ``SLOTS`` + 1 states of 24 bytes, which go to the driver and back. Scoring is one map over whole texts.

A very long text is a piece of its own, read whole. A null or empty text has no feature; its score is that of the bias alone. Labels that are null or without a document
are not learnt from; a document that is labelled twice counts as toxic if one label says so. Without any label the
score is 0.5 for every text. Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import stage

SLOTS = 1 << 20
MOST_LABELLED = 20_000
SHARD_ROWS = 2_500
ROUNDS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
RANGE = 1 << 16
_CHANGES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())])
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_KINDS = arrays.mix(np.arange(1, 5, dtype=np.uint64))


def features(piece: arrays.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a piece's features, repeats included, and the document of each."""
    piece = piece.lowered()
    found = arrays.words(piece)
    starts, ends = found.starts.copy(), found.ends.copy()
    for _ in range(3):  # up to three marks at either edge; a word of marks alone stays
        starts += (ends - starts > 1) & _MARK[piece.data[starts]]
        ends -= (ends - starts > 1) & _MARK[piece.data[ends - 1]]
    hashes = arrays.span_hashes(piece, starts, ends)
    doc = np.repeat(np.arange(len(found.first) - 1), found.counts)
    slots, docs = [hashes ^ _KINDS[0]], [doc]
    for gap in (1, 2, 3):
        pair = hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:]
        same = doc[:-gap] == doc[gap:]
        slots.append(arrays.mix(pair[same] ^ _KINDS[gap]))
        docs.append(doc[:-gap][same])
    return (np.concatenate(slots) >> np.uint64(44)).astype(np.int64), np.concatenate(docs)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fit(table: pa.Table, start: tuple[np.ndarray, np.ndarray] | None) -> pa.Table:
    """One group's pass: the changes of all states by it, in packed ranges of slots. Slot ``SLOTS`` is the bias.

    They are added up in 64 bits and sent in 32.
    """
    z, n = start or (np.zeros(SLOTS + 1), np.zeros(SLOTS + 1))
    more_z, more_n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    labels = table["label"].to_numpy()
    for piece in arrays.pieces(table["text"]):
        slots, docs = features(piece)
        order = np.argsort(docs, kind="stable")
        slots, edge = slots[order], np.searchsorted(docs[order], np.arange(piece.hi - piece.lo + 1))
        for d in range(piece.hi - piece.lo):
            at = np.append(np.unique(slots[edge[d] : edge[d + 1]]), SLOTS)
            n_at = n[at] + more_n[at]
            w = _weights(z[at] + more_z[at], n_at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[piece.lo + d]
            more_z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA * w
            more_n[at] += g * g
    at = np.flatnonzero(more_n)
    edges = np.searchsorted(at, np.arange(0, SLOTS + RANGE + 1, RANGE))
    rows = []
    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if y > x:
            own = at[x:y]
            packed = arrays.packed(np.diff(own - i * RANGE, prepend=0).astype(np.uint16), more_z[own].astype(np.float32), more_n[own].astype(np.float32))
            rows.append({"part": i, "shard": table["shard"][0].as_py(), "n": len(own), "packed": packed})
    return pa.Table.from_pylist(rows, schema=_CHANGES)


def _added(table: pa.Table) -> pa.Table:
    """A range of slots: the sum of all groups' changes, in the order of the groups."""
    table = table.sort_by("shard")
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for r in table.to_pylist():
        step, more_z, more_n = arrays.unpacked(r["packed"], r["n"], np.uint16, np.float32, np.float32)
        at = np.cumsum(step.astype(np.int64)) + r["part"] * RANGE
        z[at] += more_z
        n[at] += more_n
    at = np.flatnonzero(n)
    return pa.table({"n": pa.array([len(at)], pa.int32()), "packed": pa.array([arrays.packed(at, z[at], n[at])], pa.binary())})


def _pass(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _fit(table, shared.value)

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that aren't zero. ``docs`` and ``labels`` share ``doc_id``."""
    spark = docs.sparkSession
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(MOST_LABELLED)
    )
    # the sample has a bound, so it is broadcast and the texts stay where they are
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stage(rows, "toxic-sample")
    shards = max(1, round(rows.count() / SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    state: tuple[np.ndarray, np.ndarray] | None = None
    for _ in range(ROUNDS):
        parts = rows.groupBy("shard").applyInArrow(
            _pass(spark.sparkContext.broadcast(state)), "part int, shard int, n int, packed binary"
        )
        sums = parts.groupBy("part").applyInArrow(_added, "n int, packed binary").toArrow()
        z, n = (x.copy() for x in state) if state else (np.zeros(SLOTS + 1), np.zeros(SLOTS + 1))
        for size, packed in zip(sums["n"].to_pylist(), sums["packed"].to_pylist(), strict=True):
            at, more_z, more_n = arrays.unpacked(packed, size, np.int64, np.float64, np.float64)
            z[at] += more_z / shards
            n[at] += more_n / shards
        state = z, n
    weights = _weights(*state)
    at = np.flatnonzero(weights)
    return at, weights[at]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and ``_score`` (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(SLOTS + 1)
        weights[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = [np.zeros(0)]
            for piece in arrays.pieces(batch.column(n)):
                slots, docs_ = features(piece)
                active = weights[slots] != 0
                pair = np.unique(docs_[active] * SLOTS + slots[active])
                total = np.bincount(pair // SLOTS, weights[pair % SLOTS], minlength=piece.hi - piece.lo)
                out.append(1 / (1 + np.exp(-np.clip(total + weights[SLOTS], -30, 30))))
            columns = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(out).round(6))], names=[*keep, "_score"]
            )

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, docs.select(*keep).schema.add("_score", "double")
    )
