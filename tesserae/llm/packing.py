"""Packing documents into sequences whose windows all have the same mixture of sources.

Each source is a queue of tokens, and deficit round-robin serves the queues: in each round, a source's counter grows by its
quantum, ``size`` tokens times the source's share of all tokens; whole tokens are sent and the rest, its deficit, is
carried to the next round. The stream of all rounds is cut into windows of ``size`` tokens. As no queue runs empty before
the last round, a counter after r rounds is r times the quantum; so a task knows every deficit and every place in the stream
from the totals of the sources alone, and goes on where the partitions before it end. A window then has of each source its
share of tokens, within the number of queues plus two. The targets are the shares of the tokens that are given, as each token
is packed once; to have others, mix the documents first (``mixing``).

Counters are integers, in units of a token over 2 to the power ``shift``, with as many bits as 64 allow. What is left at the end
of the stream is cut into sequences of falling powers of two, which need no padding; so there is none.

A queue's documents stand in the order of the partitions that read them and of the rows in these. The tokens are written to a
table once, with the place of each document in its partition, so a lost task that reads them again sees the same order.
A table of (source, partition) has the tokens before each; it is broadcast up to ``common.BROADCAST_ROWS`` rows and joined by a
shuffle beyond. The totals of the queues are in the tasks: ``QUEUES`` at most. If there are more sources, the largest have
queues of their own, and the others, each with less than two tokens of a window of 2,048, share one, in which the sources of a
partition stand one after the other. A source of any size is cut by partitions and never meets in one task.

Tokens are those of the library ``tokenizers``. Its results don't depend on what stands beyond white space, so tasks cut a
block of texts into words, and words of ASCII into the runs that the pre-tokenizer would make of them (``Vocabulary`` says how
this is checked), and have each distinct one encoded once; up to ``CACHED`` of them stay in the worker.

A null or empty text is the end id alone. A very long text is a block of its own. Null sources are a source; rows that repeat
an id, or have none, are documents of their own. Ties can't occur. An empty table gives an empty result. Columns of the input
are kept, but for those named like an added one, which are replaced; ``text`` and ``source`` are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from tokenizers import Tokenizer

from tesserae.llm import arrays
from tesserae.llm.common import checked_broadcast, shield, stage, text_size

SIZE = 2048
END = 1
QUEUES = 1024
CACHED = 1 << 20
#: Bytes of text that are cut into words at once, words that the tokenizer gets at once, tokens whose places are computed at once.
BLOCK, ENCODED, TOKENS = 2 << 20, 10_000, 1 << 20

_SPACE, _LETTER, _DIGIT, _SYMBOL, _HIGH = range(5)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _HIGH


def _units(piece: arrays.Piece, split: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of a piece, cut further where ``split``, and the offsets of the documents among them.

    Cut are words of ASCII alone without ``<|``, which may begin a special token: into letters, single digits, and runs of
    symbols, where an apostrophe that begins a run takes s, t, m, d, re, ve or ll after it.
    """
    data, kind = piece.data, _KIND[piece.data]
    found = arrays.words(piece)
    n = len(data)
    begins = np.zeros(n + 3, bool)
    begins[found.starts] = True
    inside = np.zeros(n + 3, bool)
    inside[:n] = kind != _SPACE
    if split and n:
        odd = kind == _HIGH
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        many = np.concatenate([[0], np.cumsum(odd)])
        whole = np.repeat(many[found.ends] > many[found.starts], found.ends - found.starts)
        plain = np.zeros(n, bool)
        plain[inside[:n]] = ~whole
        low = np.concatenate([np.where(plain, arrays._LOWER[data], data), np.zeros(3, np.uint8)])
        before = np.concatenate([[_SPACE], kind[:-1]])
        first = begins.copy()
        first[:n] |= plain & ((kind != before) | (kind == _DIGIT))
        mark = np.flatnonzero(plain & (low[:n] == 0x27) & ((before != _SYMBOL) | begins[:n]))
        one = np.isin(low[mark + 1], np.frombuffer(b"stmd", np.uint8)) & ~begins[mark + 1]
        pair = low[mark + 1].astype(np.int64) << 8 | low[mark + 2]
        two = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~begins[mark + 1] & ~begins[mark + 2]
        for at, width in ((mark[one], 2), (mark[two], 3)):
            first[at + 1] = False
            first[at + width] |= inside[at + width]
        data = low[:n]
    else:
        first = begins
    starts = np.flatnonzero(first[:n])
    place = np.cumsum(inside[:n])
    offsets = np.append(place[starts] - 1, place[-1] if n else 0).astype(np.int32)
    text = pa.py_buffer(data[inside[:n]].tobytes())
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), text), np.searchsorted(starts, piece.offsets)


class Vocabulary:
    """A tokenizer with the ids of distinct words. Words of ASCII are cut before it sees them if ``split``, which holds only
    for a tokenizer that cuts them alike; it is found out on samples of text that have each of the cases."""

    SAMPLE = "It's THE dog's 'test' don't we'll I'm they're x've he'd 's''s 'S's 12a3 a--b (c.'s) @#1 l'art 'r 'v'l''ll\t'tis\n#'re 're're5's_x"

    def __init__(self, data: bytes):
        self.tokenizer = Tokenizer.from_buffer(data)
        self.split = False
        self.clear()
        whole = self.tokenizer.encode(self.SAMPLE, add_special_tokens=False).ids
        self.split = True
        self.split = self.encode([self.SAMPLE])[0].tolist() == whole
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64)

    def _add(self, words: list[str]) -> None:
        for lo in range(0, len(words), ENCODED):
            part = words[lo : lo + ENCODED]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            many = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)) if found.ids else np.zeros(len(part), np.int64)
            n, used = len(self.at), int(self.ends[len(self.at)])
            while n + len(part) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            while used + len(found.ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[used : used + len(found.ids)] = found.ids
            self.ends[n + 1 : n + len(part) + 1] = used + np.cumsum(many)
            self.at.update(zip(part, range(n, n + len(part)), strict=True))

    def piece_ids(self, piece: arrays.Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece's documents, one after the other, and the offsets of the documents among them."""
        units, first = _units(piece, self.split)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        if len(self.at) + len(fresh) > CACHED and self.at:
            self.clear()
            fresh = np.arange(len(words))
        at[fresh] = len(self.at) + np.arange(len(fresh))
        self._add([words[i] for i in fresh.tolist()])
        at = at[coded.indices.to_numpy()]
        starts = self.ends[at]
        sizes = self.ends[at + 1] - starts
        return self.ids[arrays.ragged(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])[first]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for piece in arrays.pieces(pa.array(texts, pa.string()), BLOCK):
            ids, first = self.piece_ids(piece)
            out += [ids[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
        return out


_kept: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of these bytes of a tokenizer's file; a worker keeps the last one that it made."""
    key = zlib.crc32(data)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Vocabulary(data)
    return _kept[key]


def tokens(docs: DataFrame, path: str, text: str, source: str, end: int = END) -> DataFrame:
    """``docs`` with ``_key`` (its source), ``_part``, ``_before`` (tokens of that source before it in the part), ``_n`` and
    ``_ids`` (16 or 32 bits each, with the end id) instead of text and source. The file at ``path`` is read by the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    most = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    kind = np.uint16 if most <= 1 << 16 else np.uint32
    names = [c for c in docs.columns if c not in (text, source)]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))
    rows = docs.select(*names, key.alias("_key"), F.col(text).cast("string").alias("_text"))
    schema = StructType(rows.schema.fields[:-1])
    for name, type_ in (("_part", "integer"), ("_before", "long"), ("_n", "long"), ("_ids", "binary")):
        schema = schema.add(name, type_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, sent = vocabulary(shared.value), TaskContext.get().partitionId(), {}
        for batch in arrays.returned(batches):
            for piece in arrays.pieces(batch.column(len(names) + 1), BLOCK):
                ids, first = own.piece_ids(piece)
                n = np.diff(first)
                out = np.full(len(ids) + len(n), end, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                edges = (first + np.arange(len(first))).astype(np.int64)
                keys, before = batch.column(len(names)).slice(piece.lo, piece.hi - piece.lo), []
                for k, m in zip(keys.to_pylist(), np.diff(edges).tolist(), strict=True):
                    before.append(sent.get(k, 0))
                    sent[k] = before[-1] + m
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((edges * out.itemsize).tobytes()), pa.py_buffer(out.tobytes())])
                added = [pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(np.diff(edges)), packed.cast(pa.binary())]
                kept = [c.slice(piece.lo, piece.hi - piece.lo) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*kept, keys, *added], names=schema.names)

    return rows.mapInArrow(run, schema)


class Rounds:
    """The places of tokens in the stream of all rounds, from the tokens of each queue."""

    def __init__(self, totals: list[int], size: int):
        self.totals, self.size, self.all = totals, size, sum(totals)
        self.shift = 62 - (self.all + 4 * size).bit_length()
        # rounded up, so that all queues are empty after the last round
        self.quanta = [max(1, -(-size * n * (1 << self.shift) // self.all)) for n in totals] if self.all else []
        full, rest = divmod(self.all, size)
        tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.tail = full, full * size + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)

    def sequence(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.full * self.size, place // self.size, self.full + np.searchsorted(self.tail, place, "right") - 1)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence < self.full, sequence * self.size, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def pieces(self, queue: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents with n tokens from ``lo`` on in their queues: document, start, length, sequence and offset of each piece."""
        quantum = np.array(self.quanta, np.int64)[queue]
        last = lambda i, q: ((i + 1 << self.shift) - 1) // q  # noqa: E731  the round that sends a queue's token i
        few = quantum < 1 << self.shift  # less than a token a round: each token is a piece
        a = np.where(few, 0, last(lo, quantum))
        many = np.where(few, n, np.where(n > 0, last(lo + n - 1, quantum) - a + 1, 0))
        doc = np.repeat(np.arange(len(n)), many)
        step = arrays.ragged(np.zeros(len(n), np.int64), many)
        queue, quantum, few = queue[doc], quantum[doc], few[doc]
        turn = np.where(few, last(lo[doc] + step, quantum), a[doc] + step)
        x = np.where(few, lo[doc] + step, np.maximum(lo[doc], turn * quantum >> self.shift))
        y = np.where(few, x + 1, np.minimum((lo + n)[doc], (turn + 1) * quantum >> self.shift))
        place = x.copy()
        for j, (q, total) in enumerate(zip(self.quanta, self.totals, strict=True)):
            sent = np.minimum((turn + (queue > j)) * q >> self.shift, total)
            place += np.where(queue == j, 0, sent)
        first, final = self.sequence(place), self.sequence(place + (y - x) - 1)
        cuts = np.maximum(final - first + 1, 0)
        of = np.repeat(np.arange(len(x)), cuts)
        sequence = arrays.ragged(first, cuts)
        start = self.start(sequence)
        begin = np.maximum(place[of], start)
        end = np.minimum((place + y - x)[of], self.start(sequence + 1))
        own = doc[of]
        return own, begin - place[of] + x[of] - lo[own], end - begin, sequence, begin - start


def queues(parts: DataFrame, most: int = QUEUES) -> tuple[DataFrame, list[int]]:
    """Of (_key, _part, _tokens): (_key, _part, _queue, _first), the queue and its tokens before that part, and the tokens of
    each queue, at most ``most`` of them."""
    sizes = parts.groupBy("_key").agg(F.sum("_tokens").alias("_tokens")).orderBy(F.desc("_tokens"), "_key").limit(most + 1).collect()
    own = sorted((r["_key"], r["_tokens"]) for r in (sizes[: most - 1] if len(sizes) > most else sizes))
    totals = [n for _, n in own]
    if len(sizes) > most:
        totals.append(parts.agg(F.sum("_tokens")).first()[0] - sum(totals))
    named = parts.sparkSession.createDataFrame([(k, i) for i, (k, _) in enumerate(own)], "_key string, _queue int")
    placed = parts.join(F.broadcast(named), "_key", "left").withColumn("_queue", F.coalesce("_queue", F.lit(len(own))))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    of_part = placed.groupBy("_queue", "_part").agg(F.sum("_tokens").alias("_sum"))
    of_part = of_part.select("_queue", "_part", F.coalesce(F.sum("_sum").over(upto("_queue").orderBy("_part")), F.lit(0)).alias("_sum"))
    within = F.coalesce(F.sum("_tokens").over(upto("_queue", "_part").orderBy("_key")), F.lit(0))
    found = placed.withColumn("_within", within).join(of_part, ["_queue", "_part"])
    return found.select("_key", "_part", "_queue", (F.col("_sum") + F.col("_within")).alias("_first")), totals


_NEW = ["_start", "_length", "_ids_crc32", "_doc_tokens", "_sequence", "_offset"]


def pack(
    docs: DataFrame, path: str, text: str = "text", source: str = "source", size: int = SIZE, end: int = END, with_ids: bool = False, most: int = QUEUES
) -> DataFrame:
    """A row for each piece: the columns of its document (but text and source), ``_start`` (tokens of the document before it),
    ``_length``, ``_ids_crc32`` (of its ids, 32 bits each, little-endian), ``_doc_tokens``, ``_sequence`` and ``_offset``, and
    with ``with_ids`` its ``_ids``. ``path`` is a tokenizer's file, ``size`` the tokens of a sequence."""
    inside, name, back = shield(docs)
    made = stage(tokens(inside, path, name(text), name(source), end), "pack-tokens", text_size(docs, text))
    parts = stage(made.groupBy("_key", "_part").agg(F.sum("_n").alias("_tokens")), "pack-parts")
    placed, totals = queues(parts, most)
    rounds = Rounds(totals, size)
    names = [c for c in inside.columns if c not in (name(text), name(source))]
    rows = made.join(checked_broadcast(stage(placed, "pack-queues")), ["_key", "_part"])
    rows = rows.select(*names, F.col("_queue").cast("long"), (F.col("_first") + F.col("_before")).alias("_lo"), "_n", "_ids")
    kept, new = len(names), [*_NEW, *["_ids"] * with_ids]
    schema = StructType(rows.schema.fields[:kept])
    for c in new:
        schema = schema.add(c, ArrayType(IntegerType()) if c == "_ids" else LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.returned(batches):
            queue, lo, n = (batch.column(kept + i).to_numpy().astype(np.int64) for i in range(3))
            edges = np.concatenate([[0], np.cumsum(n)])
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + TOKENS, "right")) - 1)
                doc, start, length, sequence, offset = rounds.pieces(queue[i:j], lo[i:j], n[i:j])
                raw = b"".join(batch.column(kept + 3).slice(i, j - i).to_pylist())
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * (edges[j] - edges[i]) else np.uint32).astype("<u4")
                x = edges[i:j][doc] - edges[i] + start
                view = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[4 * p : 4 * (p + m)]) for p, m in zip(x.tolist(), length.tolist(), strict=True)]
                columns = [start, length, np.array(crc, np.int64), n[i:j][doc], sequence, offset]
                out = [*[c.slice(i, j - i).take(pa.array(doc)) for c in batch.columns[:kept]], *map(pa.array, columns)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[arrays.ragged(x, length)].astype(np.int32))))
                yield from pa.Table.from_arrays([pa.chunked_array([c]) for c in out], names=schema.names).to_batches(50_000)
                i = j

    found = rows.mapInArrow(run, schema)
    columns = [F.col(name(c)).alias(c) for c in docs.columns if c not in (text, source, *new)]
    return found.select(*columns, *new)


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(_sequence, _tokens, _ids) of pieces with ids: each sequence's ids, padded to ``size`` if their number is no power of
    two. A sequence has ``size`` ids at most, so a group is small."""
    joined = pieces.groupBy("_sequence").agg(F.sum("_length").alias("_tokens"), F.array_sort(F.collect_list(F.struct("_offset", "_ids"))).alias("_all"))
    ids, n = F.flatten(F.col("_all._ids")), F.col("_tokens").cast("int")
    power = F.bit_count(n) == 1
    return joined.select("_sequence", "_tokens", F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), F.lit(size) - n))).alias("_ids"))
