"""Substring dedup with super-k-mer partitioning.

A window is ``WIDTH`` consecutive words of one document. Its minimiser is the least hash among its ``CORE``-word
sequences. Consecutive windows that share a minimiser form a super-k-mer: they travel as one packed string (the words
once, each followed by a blank) to the bucket of the minimiser. As equal windows have equal minimisers, they meet in one
bucket, where the windows are sorted by hash and compared byte by byte with the first of each run, so counts are exact.

Hot keys: a task sends a packed string once for all its occurrences in a block of text (the earliest; the others are
removed at once, as the earliest stands before them), so a group of copies sends at most one string per block. A
minimiser that still has more than ``HOT_STRINGS`` strings, or one in ``HOT_PART`` of all (a passage with ever new
surroundings), is hot. Its windows travel one by one to the bucket of their own hash, where only equal windows meet. Hot
minimisers are found by a pass over all texts, which counts those that have two or more strings in a block; they are
broadcast, 8 bytes each, and are at most ``HOT_PART`` + strings / ``HOT_STRINGS``. They change where windows meet, not
what is found.

A word is removed if a window that covers it has the same words as one that starts earlier: in a document of smaller id,
or earlier in the same one. Windows are judged on the input. Rows that share an id and their text are deliveries of one
document: equal positions aren't earlier than each other, so none of them loses words to the others. Rows that share an
id but not their text are parts of one document, in the order of a hash of their text. A row without an id is a document
of its own, told apart by its text; they come last, in the order of a hash. Null and empty texts have no words and lose
none. A very long text is a block of its own. An empty table gives an empty result. Columns of the input that are named
like those that are added are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import BROADCAST_ROWS, discard, node, shield, stage

WIDTH = 20
CORE = 3
BLOCK = 4 << 20
LONGEST = 1024
HOT_PART = 2_000
HOT_STRINGS = 50_000
_PART = 31  # bits of a word's place in its row; those above them tell the parts of one document apart


@dataclass
class Runs:
    """Super-k-mers of a block: their documents, first words, windows, and byte spans in ``data``."""

    data: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    minimiser: np.ndarray


def _runs(ids: np.ndarray, base_at: np.ndarray, texts: pa.Array, hot: np.ndarray) -> Runs:
    parts = []
    base = 0
    for piece in arrays.pieces(texts):
        data, found = arrays.compacted(piece)
        word = arrays.span_hashes(data, found.starts, found.ends)
        start, doc = arrays.window_starts(found.first, WIDTH)
        if len(start):
            core = arrays.window_hashes(word, np.arange(len(word) - CORE + 1), CORE)
            least = arrays.sliding_min(core, WIDTH - CORE + 1)[start]
            fresh = np.ones(len(start), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(fresh)
            serial = np.arange(len(start)) - head[np.cumsum(fresh) - 1]
            fresh |= serial % LONGEST == 0
            if len(hot):
                fresh |= np.isin(least, hot)
            head = np.flatnonzero(fresh)
            many = np.diff(np.append(head, len(start)))
            first = start[head]
            parts.append(
                (
                    data,
                    ids[piece.lo + doc[head]],
                    first - found.first[doc[head]] + base_at[piece.lo + doc[head]],
                    many,
                    base + found.starts[first],
                    base + found.ends[first + many + WIDTH - 2] + 1,
                    least[head],
                )
            )
            base += len(data)
    if not parts:
        none = np.zeros(0, np.int64)
        return Runs(np.zeros(0, np.uint8), none, none, none, none, none, none.astype(np.uint64))
    return Runs(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _distinct(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The earliest run of each packed string; the runs that repeat it later; and each string's hash."""
    one = arrays.span_hashes(runs.data, runs.lo, runs.hi)
    two = arrays.span_hashes(runs.data, runs.lo, runs.hi, second=True)
    order = np.lexsort((runs.at, runs.doc, two, one))
    same = np.zeros(len(order), bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    tie = (runs.doc[order] == runs.doc[order[leader]]) & (runs.at[order] == runs.at[order[leader]])
    return order[~same], order[same & ~tie], one


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for batch in arrays.returned(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << _PART
        for piece in arrays.pieces(batch.column(2), BLOCK):
            yield ids[piece.lo : piece.hi], at[piece.lo : piece.hi], batch.column(2).slice(piece.lo, piece.hi - piece.lo)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers with two packed strings or more in a block; a row (null) with the number of all strings and their bytes."""
    for ids, at, texts in _blocks(batches):
        runs = _runs(ids, at, texts, np.zeros(0, np.uint64))
        sent, _, _ = _distinct(runs)
        found, many = np.unique(runs.minimiser[sent], return_counts=True)
        found, many = found[many > 1].astype(np.int64), many[many > 1]
        size = int((runs.hi - runs.lo).sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None, *found.tolist()], pa.int64()),
                pa.array([len(sent), *many.tolist()], pa.int64()),
                pa.array([size, *[0] * len(found)], pa.int64()),
            ],
            names=["minimiser", "n", "size"],
        )


def hot_minimisers(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of rows (doc, part, text): the hot minimisers, and the bytes of all packed strings."""
    found = rows.mapInArrow(_frequent, "minimiser long, n long, size long")
    found = stage(found.groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > 16 or minimiser is null"), "dedup-minimisers")
    total = found.filter("minimiser is null").select("n", "size").first()
    if not total:
        return np.zeros(0, np.uint64), 0
    many = (F.col("n") * HOT_PART > total["n"]) | (F.col("n") > HOT_STRINGS)
    hot = found.filter(F.col("minimiser").isNotNull() & many).select("minimiser").toArrow()["minimiser"].to_numpy()
    discard(found)
    return np.sort(hot.astype(np.int64).view(np.uint64)), total["size"]


_PACKED = "bucket int, packed binary, text_size long, n int, places binary, n_gone int, gone binary"


def _places(runs: Runs, which: np.ndarray) -> bytes:
    """Document, first word and windows of these runs, which stand in order of the input: small steps pack well."""
    at = runs.at[which]
    low = (at & ((1 << _PART) - 1)).astype(np.int32)
    return arrays.packed(np.diff(runs.doc[which], prepend=0), (at >> _PART).astype(np.int32), low, runs.windows[which].astype(np.int32))


def _unpacked(table: pa.Table, n: str, places: str) -> list[np.ndarray]:
    rows = [
        arrays.unpacked(x.as_py(), k, np.int64, np.int32, np.int32, np.int32)
        for x, k in zip(table[places], table[n].to_pylist(), strict=True)
    ]
    docs, part, at, windows = (np.concatenate(x) for x in zip(*[(np.cumsum(d), p, a, w) for d, p, a, w in rows], strict=True))
    return [docs, (part.astype(np.int64) << _PART) + at, windows.astype(np.int64)]


def _pack(hot: np.ndarray, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for ids, at, texts in _blocks(batches):
            runs = _runs(ids, at, texts, hot)
            if not len(runs.doc):
                continue
            sent, gone, own = _distinct(runs)
            key = np.where(np.isin(runs.minimiser, hot), own, arrays.mix(runs.minimiser)) if len(hot) else arrays.mix(runs.minimiser)
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            sent, gone = np.sort(sent), np.sort(gone)
            sent, gone = sent[np.argsort(bucket[sent], kind="stable")], gone[np.argsort(bucket[gone], kind="stable")]
            edges = np.arange((1 << bits) + 1)
            cut, gone_cut = np.searchsorted(bucket[sent], edges), np.searchsorted(bucket[gone], edges)
            rows: dict[str, list] = {k.split()[0]: [] for k in _PACKED.split(", ")}
            for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(gone_cut) > 0)):
                own_, lost = sent[cut[b] : cut[b + 1]], gone[gone_cut[b] : gone_cut[b + 1]]
                words = runs.data[arrays.ragged(runs.lo[own_], runs.hi[own_] - runs.lo[own_])].tobytes()
                rows["bucket"].append(int(b))
                rows["packed"].append(codec.compress(words, asbytes=True) if words else b"")
                rows["text_size"].append(len(words))
                rows["n"].append(len(own_))
                rows["places"].append(_places(runs, own_))
                rows["n_gone"].append(len(lost))
                rows["gone"].append(_places(runs, lost))
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True)], names=list(rows)
            )

    return run


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b hold the same bytes, some million bytes at a time."""
    same = size == size_b
    lo = 0
    while lo < len(a):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + 65536]), 4 << 20)))
        hi = min(hi, len(a))
        own = np.flatnonzero(same[lo:hi]) + lo
        if len(own):
            equal = data[arrays.ragged(a[own], size[own])] == data[arrays.ragged(b[own], size[own])]
            edge = np.concatenate([[0], np.cumsum(size[own])])
            wrong = np.concatenate([[0], np.cumsum(~equal)])
            same[own] = wrong[edge[1:]] == wrong[edge[:-1]]
        lo = hi
    return same


def _repeated(data: np.ndarray, doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of every window that has an earlier equal one; runs in ``data`` one after the other."""
    gaps = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], gaps[:-1] + 1])
    word = arrays.span_hashes(data, starts, gaps)
    first = np.concatenate([[0], np.cumsum(windows + WIDTH - 1)])
    head, run = arrays.window_starts(first, WIDTH)
    value = arrays.window_hashes(word, head, WIDTH)
    w_doc, w_at = doc[run], at[run] + head - first[run]
    order = np.argsort(value)
    value = value[order]
    meets = np.zeros(len(order), bool)
    meets[1:] = value[1:] == value[:-1]
    meets[:-1] |= meets[1:]
    order, value = order[meets], value[meets]
    order = order[np.lexsort((w_at[order], w_doc[order], value))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.diff(value) != 0
    leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    a, b = starts[head[order]], starts[head[leader]]
    same = _same_bytes(data, a, b, gaps[head[order] + WIDTH - 1] - a, gaps[head[leader] + WIDTH - 1] - b)
    later = (w_doc[order] != w_doc[leader]) | (w_at[order] != w_at[leader])
    gone = order[same & later & ~fresh]
    if not same.all():  # different windows with one hash: settle those runs by their bytes
        place = np.cumsum(fresh) - 1
        extra = []
        for r in np.unique(place[~same]):
            seen: dict[bytes, tuple[int, int]] = {}
            for x in order[place == r]:
                text = data[starts[head[x]] : gaps[head[x] + WIDTH - 1]].tobytes()
                where = (int(w_doc[x]), int(w_at[x]))
                if seen.setdefault(text, where) != where:
                    extra.append(x)
        gone = np.unique(np.concatenate([gone, np.array(extra, np.int64)]))
    gone = np.sort(gone)
    return w_doc[gone], w_at[gone]


def _settle(table: pa.Table) -> pa.Table:
    """A bucket: spans of words to remove, as (document, first word, end)."""
    codec = pa.Codec("zstd")
    sizes = table["text_size"].to_pylist()
    words = b"".join(
        codec.decompress(x.as_py(), n, asbytes=True) for x, n in zip(table["packed"], sizes, strict=True) if n
    )
    doc, at, windows = _unpacked(table, "n_gone", "gone")
    end = at + windows + WIDTH - 1
    if words:
        more, first = _repeated(np.frombuffer(words, np.uint8), *_unpacked(table, "n", "places"))
        doc, at = np.concatenate([doc, more]), np.concatenate([at, first])
        end = np.concatenate([end, first + WIDTH])
    order = np.lexsort((at, doc))  # spans that meet become one
    doc, at, end = doc[order], at[order], end[order]
    if len(doc):
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])
        head = np.flatnonzero(fresh)
        doc, at, end = doc[head], at[head], np.maximum.reduceat(end, head)
    part = at >> _PART
    return pa.table({"doc": doc, "part": part, "at": at - (part << _PART), "end": end - (part << _PART)})


def documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``_doc`` (see ``node``) and ``_part``: 0, or 31 bits of the text's hash if rows share their id."""
    doc = F.col(doc_id).cast("long")
    keyed = docs.withColumn("_doc", node(F.col(doc_id), F.col(text)))
    again = docs.filter(doc.isNotNull()).groupBy(doc.alias("_doc")).count().filter("count > 1").select("_doc", F.lit(True).alias("_again"))
    many = again.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return keyed.withColumn("_part", F.lit(0).cast("long"))
    keyed = keyed.join(F.broadcast(again) if many <= BROADCAST_ROWS else again, "_doc", "left")
    part = F.when(F.col("_again"), F.pmod(F.xxhash64(text), F.lit(1 << _PART))).otherwise(F.lit(0))
    return keyed.withColumn("_part", part.cast("long")).drop("_again")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of ``documents``: ``_doc``, ``_part`` and ``_spans``, the spans of words to remove; those without any have no
    row. Spans may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("_doc").alias("doc"), F.col("_part").alias("part"), F.col(text).alias("text"))
    hot, size = hot_minimisers(rows)
    packed = rows.mapInArrow(_pack(hot, arrays.bucket_bits(partitions, size)), _PACKED)
    spans = packed.groupBy("bucket").applyInArrow(_settle, "doc long, part long, at long, end long")
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("part").alias("_part"))
    return spans.agg(F.collect_list(F.struct("at", "end")).alias("_spans"))


def kept_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_removed`` and ``_kept``: the words that stay, joined by one blank."""
    inside, name, back = shield(docs)
    keyed = documents(inside, name(text), name(doc_id))
    joined = keyed.join(repeated_spans(keyed, name(text)), ["_doc", "_part"], "left")
    names, of_text = inside.columns, inside.columns.index(name(text))
    schema = inside.schema
    for new, kind in (("_n_words", "long"), ("_n_removed", "long"), ("_kept", "string")):
        schema = schema.add(new, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.returned(batches):
            all_spans = batch.column(len(names))
            counts, removed, kept = [], [], []
            for piece in arrays.pieces(batch.column(of_text)):
                data, found = arrays.compacted(piece)
                gone = np.zeros(len(found.starts) + 1, np.int64)
                for d, spans_ in enumerate(all_spans[piece.lo : piece.hi].to_pylist()):
                    first, end = found.first[d], found.first[d + 1]
                    for s in spans_ or ():
                        gone[min(first + s["at"], end)] += 1
                        gone[min(first + s["end"], end)] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                lost = arrays.per_document(~stays, found.first)
                sizes = (found.ends - found.starts + 1) * stays
                left = data[np.repeat(stays, found.ends - found.starts + 1)].tobytes()
                edge = np.concatenate([[0], np.cumsum(arrays.per_document(sizes, found.first))])
                counts.append(found.counts)
                removed.append(lost)
                kept += [left[x : max(x, y - 1)].decode() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            one = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            columns = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(one(counts)), pa.array(one(removed)), pa.array(kept, pa.string())],
                names=[*names, "_n_words", "_n_removed", "_kept"],
            )

    return back(joined.select(*names, "_spans").mapInArrow(run, schema), new=["_n_words", "_n_removed", "_kept"])
