"""Whole-array text helpers for Arrow batches inside Spark tasks.

Texts arrive as Arrow string columns. Their bytes are cut into pieces of about ``PIECE`` bytes of whole documents, and
words, hashes and windows are computed for a piece at a time, so that memory in a task follows ``PIECE`` (or the longest
single document), not the partition. Words are runs of bytes other than blank and 0x09-0x0D, which is the same as the
regular expression ``[^\\x20\\x09-\\x0D]+`` on the characters, as no UTF-8 continuation byte is below 0x80.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Arrow's own pool keeps what it has freed; in a worker that lives through many tasks this adds up.
pa.set_memory_pool(pa.system_memory_pool())

PIECE = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
_LIBC = ctypes.CDLL(None)


def returned(batches: Iterator) -> Iterator:
    """The batches; at their end, what the worker has freed goes back to the system, as workers outlive their tasks."""
    yield from batches
    _powers.clear()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept in the worker."""
    kept = _powers.get(kind)
    if kept is None or len(kept) <= n:
        kept = np.full(max(n, PIECE) + 1, base, dtype=np.uint64)
        kept[0] = 1
        _powers[kind] = kept = np.multiply.accumulate(kept)
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Piece:
    """Bytes of the documents ``lo`` to ``hi`` of a batch; ``offsets`` has one entry more than documents."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def lowered(self) -> Piece:
        return Piece(self.lo, self.hi, _LOWER[self.data], self.offsets)


def pieces(texts: pa.Array, limit: int = 0) -> Iterator[Piece]:
    """Whole documents, about ``limit`` bytes at a time; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n, limit = len(texts), limit or PIECE
    if not n:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Spans of the words of a piece; words ``first[d]`` to ``first[d + 1]`` belong to document d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(piece: Piece) -> Words:
    inside = ~_SEPARATOR[piece.data]
    n = len(inside)
    edge = piece.offsets[(piece.offsets > 0) & (piece.offsets < n)]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def span_hashes(piece: Piece | np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands; ``second``: an independent one."""
    data = piece if isinstance(piece, np.ndarray) else piece.data
    n, table = len(data), _SECOND if second else _BYTE
    if n > 4 * PIECE and len(starts) > 1:  # spans in order of their starts, some at a time
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, lo + PIECE)))
            part = data[lo : int(ends[i:j].max())]
            out[i:j] = span_hashes(part, starts[i:j] - lo, ends[i:j] - lo, second)
            i = j
        return out
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * _power("up", _BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``width`` words inside a document, and its document."""
    many = np.maximum(np.diff(first) - width + 1, 0)
    total = int(many.sum())
    doc = np.repeat(np.arange(len(many)), many)
    return np.arange(total) + np.repeat(first[:-1] - (np.cumsum(many) - many), many), doc


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of ``width`` word hashes from each start, in order."""
    n = len(hashes) - width + 1
    if n <= 0 or not len(starts):
        return np.zeros(len(starts), np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += hashes[k : k + n]
    return mix(out[starts])


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and the offsets of the documents.

    A document with fewer words than ``width``, but at least one, has its whole sequence as its only shingle.
    """
    starts, doc = window_starts(first, width)
    value = window_hashes(hashes, starts, width)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    if len(short):
        extra = []
        for d in short:
            h = np.uint64(len(hashes[first[d] : first[d + 1]]))
            for x in hashes[first[d] : first[d + 1]].tolist():
                h = np.uint64((int(h) * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF)
            extra.append(h)
        value = np.concatenate([value, mix(np.array(extra, np.uint64))])
        doc = np.concatenate([doc, short])
    bits = max(1, int(len(first)).bit_length())
    order = np.argsort(doc.astype(np.uint64) << np.uint64(64 - bits) | value >> np.uint64(bits))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(first)))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets; 0 for a document without any."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def compacted(piece: Piece) -> tuple[np.ndarray, Words]:
    """The words of a piece, each followed by one blank, as one array of bytes, and the spans of the words in it."""
    found = words(piece)
    sizes = found.ends - found.starts
    if not len(sizes):
        return np.zeros(0, np.uint8), Words(sizes, sizes, found.first)
    keep = ~_SEPARATOR[piece.data]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.full(int(starts[-1] + sizes[-1] + 1), 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[starts + sizes] = False
    data[inside] = piece.data[keep]
    return data, Words(starts, starts + sizes, found.first)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    best, span = values, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    return np.minimum(best[:n], best[width - span : width - span + n])


#: Bytes of text whose words or windows a bucket gets, as long as there are not too many buckets.
BUCKET = 8 << 20


def bucket_bits(partitions: int, size: int, each: int = 4, most: int = 17) -> int:
    """Bits of a bucket's number: about ``each`` buckets for a shuffle partition, and ``BUCKET`` bytes of text for a bucket.

    There are at most 2 to the power ``most`` of them, as tasks send a row for each bucket.
    """
    return min(most, max(4, int(np.ceil(np.log2(max(1, each * partitions, size / BUCKET))))))


def packed(*columns: np.ndarray) -> bytes:
    """The bytes of the columns, one after the other, compressed."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(data: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    """The columns of ``size`` values each that were packed as these kinds."""
    raw = pa.Codec("zstd").decompress(data, size * sum(np.dtype(k).itemsize for k in kinds), asbytes=True)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out
