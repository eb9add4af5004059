"""Language ID by hyperdimensional profiles.

Every letter has a vector of +1 and -1 in ``DIMENSIONS`` dimensions, drawn from its code point alone. A trigram is bound
from its letters' vectors, the first rotated twice and the second once; a text is the bundle (sum) of its trigrams, and a
language the bundle of its labelled texts. A text gets the language whose prototype is nearest by cosine, after the mean
of all prototypes is taken from both sides, as that part is common to all languages; of equally near ones, the first by
name.

Bundling is linear, so a task counts the distinct trigrams of a block of texts and multiplies the counts with the
trigrams' vectors. In training each task adds up one bundle a language (``HELD`` languages at a time), and Spark adds up
those; the prototypes are languages x ``DIMENSIONS`` numbers whatever the size of the corpus. At most ``MOST_LANGUAGES``
labels are admitted; more are an error.

Texts are lower-cased; a run of anything but letters counts as one blank, which is a letter of its own in the vectors.
A null text, or one without a letter, is ``und`` with score 0. If nothing is labelled, every text is ``und``. Repeated
rows each get their row. Null labels are not learnt from. A very long text is a block of its own. An empty table gives no
languages, and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays

DIMENSIONS = 1024
MOST_LANGUAGES = 2_000
BLOCK = 1 << 20
HELD = 1_000
_BLANK = 0x20
_CODE = 21  # bits of a code point; three of them are a trigram's key
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter; built once in a worker (1.1 MB)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of code points: the bits of a hash of code point and place, as +1 and -1."""
    place = arrays.mix(np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = arrays.mix(arrays.mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))[:, None] ^ place)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def bound(keys: np.ndarray) -> np.ndarray:
    """The vectors of trigram keys, as 32-bit floats."""
    mask = (1 << _CODE) - 1
    parts = [np.unique(keys >> (_CODE * k) & mask, return_inverse=True) for k in (2, 1, 0)]
    first, second, third = (np.roll(letter_vectors(codes), 2 - i, 1)[at] for i, (codes, at) in enumerate(parts))
    return (first * second * third).astype(np.float32)


def _keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys of all texts, the text of each, and which texts have a letter. Every text is set in blanks."""
    table, parts, sizes = _is_letter(), [], []
    for text in texts:
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = table[code]
        keep = inside.copy()
        keep[:-1] |= inside[1:]  # of a run of others, the one before a letter stands for the run
        code = np.where(inside, code, _BLANK)[keep]
        if len(code) and code[0] != _BLANK:
            code = np.concatenate([[_BLANK], code])
        parts.append(np.append(code, _BLANK) if len(code) else code)
        sizes.append(len(parts[-1]))
    sizes = np.array(sizes)
    flat = np.concatenate(parts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes > 0
    keys = (flat[:-2] << (2 * _CODE)) | (flat[1:-1] << _CODE) | flat[2:]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole = doc[:-2] == doc[2:]
    return keys[whole], doc[:-2][whole], sizes > 0


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of about ``BLOCK`` characters, 256 texts at most."""
    block: list[str | None] = []
    size, at = 0, 0
    for i, text in enumerate(texts):
        block.append(text.as_py())
        size += len(block[-1] or "")
        if size >= BLOCK or len(block) == 256:
            yield at, block
            block, size, at = [], 0, i + 1
    if block:
        yield at, block


def _counted(group: np.ndarray, groups: int, keys: np.ndarray) -> np.ndarray:
    """The bundles of groups of trigrams: counts of the distinct ones, some thousand at a time, times their vectors."""
    distinct, place = np.unique(keys, return_inverse=True)
    out = np.zeros((groups, DIMENSIONS))
    for lo in range(0, len(distinct), 4096):
        some = (place >= lo) & (place < lo + 4096) if len(distinct) > 4096 else slice(None)
        n = min(4096, len(distinct) - lo)
        counts = np.bincount(group[some] * n + place[some] - lo, minlength=groups * n).astype(np.float32).reshape(groups, n)
        out += counts @ bound(distinct[lo : lo + n])
    return out


def _bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    keys, doc, has = _keys(texts)
    return _counted(doc, len(texts), keys), has


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial bundles; those of at most ``HELD`` languages are in memory at once."""
    schema = pa.schema([("label", pa.string()), ("bundle", pa.list_(pa.float64()))])
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for label, bundle in held.items():
            yield pa.RecordBatch.from_pydict({"label": [label], "bundle": [bundle.tolist()]}, schema=schema)
        held.clear()

    for batch in arrays.returned(batches):
        labels = np.array(batch.column(0).to_pylist(), object)
        for at, texts in _blocks(batch.column(1)):
            keys, doc, _ = _keys(texts)
            names, of = np.unique(labels[at : at + len(texts)], return_inverse=True)
            if len(held) + len(names) > HELD:
                yield from out()
            for label, bundle in zip(names.tolist(), _counted(of[doc], len(names), keys), strict=True):
                held[label] = held.get(label, 0) + bundle
    yield from out()


def prototypes(labelled: DataFrame, label: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their bundles, from the rows whose label isn't null."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    parts = rows.mapInArrow(_learn, "label string, bundle array<double>")
    # partial bundles are sums of whole numbers, so their order does not change the result
    found = (
        parts.select("label", F.posexplode("bundle").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("bundle"))
        .orderBy("label")
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    return [r["label"] for r in found], np.array([r["bundle"] for r in found]).reshape(-1, DIMENSIONS)


def predict(docs: DataFrame, languages: list[str], bundles: np.ndarray, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns of ``docs``, ``_lang`` (``und`` if none) and ``_score`` (0 to 1) of every text."""
    unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-30) if len(languages) else bundles
    mean = unit.mean(0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    centred = unit - mean
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-30)
    direction = mean / max(float(np.linalg.norm(mean)), 1e-30)
    shared = docs.sparkSession.sparkContext.broadcast((languages, centred, direction))
    schema = docs.select(*keep).schema.add("_lang", "string").add("_score", "double")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, common = shared.value
        for batch in arrays.returned(batches):
            langs, scores = [], []
            for _, texts in _blocks(batch.column(n)):
                bundle, has = _bundles(texts)
                bundle -= np.outer(bundle @ common, common)
                cosine = bundle @ at.T / np.maximum(np.linalg.norm(bundle, axis=1), 1e-30)[:, None]
                best = cosine.argmax(1) if names else np.zeros(len(texts), int)
                sure = has & bool(names)
                langs += [names[b] if ok else "und" for b, ok in zip(best, sure, strict=True)]
                top = cosine[np.arange(len(texts)), best] if names else np.zeros(len(texts))
                scores.append(np.where(sure, np.clip(top, 0, 1), 0).astype(float).round(4))
            columns = [batch.column(i) for i in range(n)]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(flat, pa.float64())],
                names=[*keep, "_lang", "_score"],
            )

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
