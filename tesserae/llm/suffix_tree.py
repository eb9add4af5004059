"""Language-model scoring with a probabilistic suffix tree over bytes, beside an add-one unigram base.

A text is its words without case, each followed by a blank, and an end: a sequence of bytes, the end being 0xFF, which
UTF-8 never has. The tree's states are contexts of up to ``DEPTH`` bytes. A context is retained if it was seen
``LEAST_COUNT`` times at least in the training texts and its next-symbol distribution diverges from that of the next shorter
context: count x Kullback-Leibler divergence >= ``LEAST_DIVERGENCE``. Suffixes of retained contexts are retained, and so are
all contexts of up to ``TRUNK`` bytes. Next-symbol distributions are smoothed with that of the next shorter context in
proportion to the number of different symbols seen (Witten-Bell), the empty context's with the uniform one, so those of
every state sum to one. A symbol is scored in the longest suffix state, and a text's score is the sum of the log10
probabilities of its symbols: the probabilities of all texts sum to one at most. The logs are 32-bit floats when tasks
exchange them and are added up as 64-bit ones.

The tree and the base's count of every word grow with the corpus and are never broadcast. A bundle of documents sends its
distinct words, and its distinct symbols with the ``DEPTH`` before each (grams), with their training counts in it, to hash
buckets. A bucket of words adds up and sends each bundle the counts of its words back. Grams go by the ``TRUNK`` + 1 symbols
before the last, so a bucket has all that the contexts longer than ``TRUNK`` which end in these need: it grows that part of
the tree, scores its grams and sends each bundle their log10 probabilities back. Where a bucket would hear from more than
``SPREAD`` bundles, it is dealt over salts: each salt merges what it hears, the bucket's owner merges the salts, and every
salt answers its own bundles with the owner's table. Only the trunk, contexts of up to ``TRUNK`` bytes with at most 256^3
(context, symbol) pairs, is broadcast. The bundle's documents, whose texts went with it, are summed where the answers meet.
Words are told apart by 64-bit hashes.

A null text is empty: its only token is the end. A very long text is a bundle of its own. A null id counts as training.
Repeated rows each count and each get a row, so ties need no rule. Without training texts the counts are 0, the tree is
empty, and every symbol has probability 1/256. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import files, stage

DEPTH = 5
TRUNK = 2
LEAST_COUNT = 2
LEAST_DIVERGENCE = 20.0
BUNDLE = 6 << 20
SPREAD = 2048
MOST_BITS = 14
_END = 0xFF


def symbols(piece: arrays.Piece) -> tuple[np.ndarray, np.ndarray]:
    """The byte sequences of a piece's documents, one after the other, and their offsets."""
    piece = piece.lowered()
    at = np.repeat(piece.offsets[1:], 2)
    data = np.insert(piece.data, at, np.tile(np.array([0x20, _END], np.uint8), len(at) // 2))
    end = np.zeros(len(data), bool)
    end[piece.offsets[1:] + 2 * np.arange(1, len(piece.offsets)) - 1] = True
    word = ~(arrays._SEPARATOR[data] | end)
    keep = word | end
    keep[1:] |= word[:-1] & ~word[1:]
    data = np.where(word | end, data, np.uint8(0x20))[keep]
    total = np.cumsum(keep)
    last = np.flatnonzero(end)
    return data, np.concatenate([[0], total[last]]).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each symbol (lowest byte) with the ``DEPTH`` before it; before a text stand ends."""
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        back = np.full(len(data), _END, np.uint64)
        back[k:] = np.where(at[k:] >= k, data[:-k], _END)
        out |= back << np.uint64(8 * k)
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


@dataclass
class Tree:
    """For each depth: sorted contexts with the log10 weight of what they leave to the next shorter context, and
    sorted (context, symbol) pairs with their log10 probabilities."""

    contexts: list[np.ndarray]
    left: list[np.ndarray]
    pairs: list[np.ndarray]
    logs: list[np.ndarray]

    def score(self, gram: np.ndarray) -> np.ndarray:
        out = np.full(len(gram), np.nan)
        weight = np.zeros(len(gram))
        for k in range(len(self.contexts) - 1, -1, -1):
            open_ = np.flatnonzero(np.isnan(out))
            own = gram[open_] & ((1 << (8 * k + 8)) - 1)
            seen, at = _find(self.pairs[k], own)
            out[open_[seen]] = weight[open_[seen]] + self.logs[k][at[seen]]
            open_, own = open_[~seen], own[~seen]
            state, at = _find(self.contexts[k], own >> 8)
            weight[open_[state]] += self.left[k][at[state]]
        return np.where(np.isnan(out), weight - math.log10(256), out)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[place] == wanted, place


def _cut(gram: np.ndarray, k: int) -> np.ndarray:
    """The last symbol of each gram with the ``k`` before it."""
    return gram & ((1 << (8 * k + 8)) - 1)


def _summed(pair: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, place = np.unique(pair, return_inverse=True)
    return pair, np.bincount(place, many, minlength=len(pair))


def _extended(tree: Tree, levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The tree with the next depths' (context, symbol) pairs, sorted, and their counts, smoothed by what it has."""
    tree = Tree(*[list(x) for x in (tree.contexts, tree.left, tree.pairs, tree.logs)])
    for pair, n in levels:
        k = len(tree.contexts)
        states, place = np.unique(pair >> 8, return_inverse=True)
        total, kinds = np.bincount(place, n, minlength=len(states)), np.bincount(place, minlength=len(states))
        lower = 10.0 ** tree.score(_cut(pair, k - 1)) if k else np.full(len(pair), 1 / 256)
        logs = np.log10((n + kinds[place] * lower) / (total + kinds)[place]) if len(pair) else n
        tree.contexts.append(states)
        tree.left.append(np.log10(kinds / (total + kinds)))
        tree.pairs.append(pair)
        tree.logs.append(logs)
    return tree


def trunk(gram: np.ndarray, many: np.ndarray) -> tuple[Tree, tuple[np.ndarray, np.ndarray]]:
    """The tree of contexts of up to ``TRUNK`` bytes, and the counts of its longest ones, from those of all grams."""
    levels = [_summed(_cut(gram, k), many) for k in range(TRUNK + 1)]
    return _extended(Tree([], [], [], []), levels), levels[-1]


def branches(stem: Tree, last: tuple[np.ndarray, np.ndarray], gram: np.ndarray, many: np.ndarray) -> Tree:
    """``stem`` with the retained contexts that are longer; of each, all grams must be given."""
    near = np.isin(last[0] >> 8, _cut(gram, TRUNK) >> 8)
    levels = [(last[0][near], last[1][near])]
    levels += [_summed(_cut(gram, k), many) for k in range(TRUNK + 1, DEPTH + 1)]
    states, places, good, shares = [], [], [], []
    for k, (pair, n) in enumerate(levels):
        state, place = np.unique(pair >> 8, return_inverse=True)
        of = np.bincount(place, n, minlength=len(state))
        share = n / of[place]
        if k:
            lower = shares[-1][np.searchsorted(levels[k - 1][0], _cut(pair, TRUNK + k - 1))]
            divergence = np.bincount(place, n * np.log(share / lower), minlength=len(state))
            good.append((of >= LEAST_COUNT) & (divergence >= LEAST_DIVERGENCE))
        states.append(state)
        places.append(place)
        shares.append(share)
    for k in range(len(good) - 1, 0, -1):
        good[k - 1] |= np.isin(states[k], _cut(states[k + 1][good[k]], TRUNK + k - 1))
    kept = [g[place] for g, place in zip(good, places[1:], strict=True)]
    return _extended(stem, [(pair[x], n[x]) for (pair, n), x in zip(levels[1:], kept, strict=True)])


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]]), np.concatenate([np.zeros(0), *[n for _, n in parts]]))


def train(texts: DataFrame, text: str = "text") -> Tree:
    """The tree of all ``texts`` in one piece, for tables that are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch.column(0)):
                gram, n = np.unique(grams(*symbols(piece)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": gram, "n": n})

    table = texts.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = _distinct([(table["gram"].to_numpy(), table["n"].to_numpy())])
    return branches(*trunk(gram, n), gram, n)


_SENT = (
    "bundle string, bucket int, n int, packed binary, ids array<bigint>, held array<boolean>, sizes binary"
)
_OWN, _TRUNK = -1, -2  # rows that are no bucket's: a bundle's documents, a task's counts for the trunk


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of sorted integers' differences, or of numbers, by their place, which packs well."""
    x = np.diff(x, prepend=x.dtype.type(0)) if x.dtype.kind in "iu" else x
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T


def _joined(raw: np.ndarray, size: int, kind: type) -> np.ndarray:
    """What ``_planes`` took apart."""
    x = np.ascontiguousarray(raw.reshape(-1, size).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if x.dtype.kind in "iu" else x


def _gram_buckets(gram: np.ndarray, bits: int) -> np.ndarray:
    ends = (gram >> 8) & ((1 << (8 * TRUNK + 8)) - 1)
    return (arrays.mix(ends.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _sorted_out(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a bundle's sorted grams by bucket, and the edges of the buckets in it."""
    of = _gram_buckets(gram, bits)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange((1 << bits) + 1))


def _send(bits: int):
    """Rows of (doc_id, held, text) -> a row for each bundle and bucket of words and of grams, one with its documents, and
    one for each task. Buckets of grams have the numbers after those of words."""
    schema = pa.schema(
        [("bundle", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())]
        + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary())]
    )

    def bundled(name: str, parts: list) -> tuple[pa.RecordBatch, tuple]:
        hashes = np.concatenate([p[0] for p in parts])
        held = np.concatenate([p[5] for p in parts])
        distinct, place = np.unique(hashes, return_inverse=True)
        taught = np.repeat(~held, np.concatenate([p[1] for p in parts]))
        many = np.bincount(place[taught], minlength=len(distinct)).astype(np.uint32)
        edges = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
        rows = [
            {"bundle": name, "bucket": b, "n": int(y - x), "packed": arrays.packed(distinct[x:y], many[x:y])}
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            if y > x
        ]
        gram, count = _distinct([p[2] for p in parts])
        order, edges = _sorted_out(gram, bits)
        for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if y > x:
                at = order[x:y]
                sent = arrays.packed(_planes(gram[at]), count[at].astype(np.uint32))
                rows.append({"bundle": name, "bucket": (1 << bits) + b, "n": int(y - x), "packed": sent})
        sizes = np.concatenate([np.diff(p[3].offsets) for p in parts])
        own = {"n": int(sizes.sum()), "packed": arrays.packed(*[p[3].data for p in parts])}
        own |= {"sizes": sizes.astype(np.int64).tobytes(), "ids": [i for p in parts for i in p[4]], "held": held.tolist()}
        sent = pa.RecordBatch.from_pylist([*rows, {"bundle": name, "bucket": _OWN, **own}], schema=schema)
        return sent, _summed(_cut(gram[count > 0], TRUNK), count[count > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, low, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in arrays.returned(batches):
            for piece in arrays.pieces(batch.column(2)):
                data, offsets = symbols(piece)
                held = np.array(batch.column(1)[piece.lo : piece.hi].to_pylist(), bool)
                gram, place = np.unique(grams(data, offsets).astype(np.int64), return_inverse=True)
                count = np.bincount(place, np.repeat(~held, np.diff(offsets)), minlength=len(gram))
                words = piece.lowered()
                found = arrays.words(words)
                ids = batch.column(0)[piece.lo : piece.hi].to_pylist()
                parts.append((arrays.span_hashes(words, found.starts, found.ends), found.counts, (gram, count), piece, ids, held))
                size += len(piece.data)
                if size >= BUNDLE:
                    sent, counted = bundled(f"{task}-{serial}", parts)
                    yield sent
                    low, parts, size, serial = [_distinct([*low, counted])], [], 0, serial + 1
        if parts:
            sent, counted = bundled(f"{task}-{serial}", parts)
            yield sent
            low = [_distinct([*low, counted])]
        for pair, n in low:
            row = {"bundle": f"{task}", "bucket": _TRUNK, "n": len(pair), "packed": arrays.packed(pair, n.astype(np.int64))}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pair, many = arrays.unpacked(packed.as_py(), n, np.int64, np.int64)
            yield pa.RecordBatch.from_pydict({"gram": pair, "n": many})


def _heard(table: pa.Table, grams_: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words or grams and their counts, as each row of a bucket has sent them."""
    keys, counts = [], []
    for x, n in zip(table["packed"], table["n"].to_pylist(), strict=True):
        (raw,) = arrays.unpacked(x.as_py(), 12 * n, np.uint8)
        key = np.ascontiguousarray(raw[: 8 * n])
        keys.append(_joined(key, n, np.int64) if grams_ else key.view(np.int64))
        counts.append(np.ascontiguousarray(raw[8 * n :]).view(np.uint32))
    return keys, counts


def _looked_up(shared, bits: int, bucket: int, key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, int, int]:
    """What a bucket answers for its distinct words (their counts) or grams (log10 probabilities), and the sums of words."""
    if bucket < 1 << bits:
        return many.astype(np.int64), int(many.sum()), int(np.count_nonzero(many))
    return branches(*shared.value, key[many > 0], many[many > 0]).score(key).astype(np.float32), 0, 0


def _replies(table: pa.Table, keys: list[np.ndarray], known: np.ndarray, value: np.ndarray) -> pa.Table:
    found = [arrays.packed(_planes(value[np.searchsorted(known, x)])) for x in keys]
    return pa.table(
        {"bundle": table["bundle"], "bucket": table["bucket"], "n": table["n"], "packed": pa.array(found, pa.binary())}
    )


_ANSWER = "bundle string, bucket int, n int, packed binary"
_OWNED = "bucket int, n int, keys binary, packed binary, seen long, words long"


def _answer(shared, bits: int):
    """A bucket whose bundles are few: its answer to each, and a row (without a bundle) with the sums of its words."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = _heard(table, bucket >= 1 << bits)
        known, many = _summed(np.concatenate(keys), np.concatenate(counts))
        value, seen, words = _looked_up(shared, bits, bucket, known, many)
        sums = {"bundle": [None], "bucket": [bucket], "n": [0], "packed": [np.array([seen, words]).tobytes()]}
        sums = pa.table({k: pa.array(v, t) for (k, v), t in zip(sums.items(), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)})
        return pa.concat_tables([_replies(table, keys, known, value), sums])

    return run


def _merge(bits: int):
    """A bucket's salt: what its bundles have sent as one."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = _heard(table, bucket >= 1 << bits)
        key, many = _summed(np.concatenate(keys), np.concatenate(counts))
        row = {"bucket": bucket, "n": len(key), "packed": arrays.packed(key, many.astype(np.int64))}
        return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())]))

    return run


def _own(shared, bits: int):
    """A bucket of many bundles: its table of words or grams and answers."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        parts = [arrays.unpacked(x.as_py(), n, np.int64, np.int64) for x, n in zip(table["packed"], table["n"].to_pylist(), strict=True)]
        key, many = _distinct([(k, n.astype(float)) for k, n in parts])
        value, seen, words = _looked_up(shared, bits, bucket, key, many)
        row = {"bucket": bucket, "n": len(key), "keys": arrays.packed(key), "packed": arrays.packed(value), "seen": seen, "words": words}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))

    return run


def _reply(bits: int):
    """A bucket's salt: its bundles are answered with the owner's table."""

    def run(sent: pa.Table, owned: pa.Table) -> pa.Table:
        if not len(sent):
            return pa.table({"bundle": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        of_grams, n = sent["bucket"][0].as_py() >= 1 << bits, owned["n"][0].as_py()
        (known,) = arrays.unpacked(owned["keys"][0].as_py(), n, np.int64)
        (value,) = arrays.unpacked(owned["packed"][0].as_py(), n, np.float32 if of_grams else np.int64)
        return _replies(sent, _heard(sent, of_grams)[0], known, value)

    return run


def _sum_up(training: int, tokens: int, distinct: int, bits: int):
    """A bundle: its documents' sums from the answers for its words and grams. The end is a token of its own."""
    every = tokens + training
    below = math.log10(every + distinct + (training > 0) + 1)

    def run(table: pa.Table) -> pa.Table:
        bucket, sizes = table["bucket"].to_numpy(), table["n"].to_pylist()
        order = [int(i) for i in np.argsort(bucket)]

        def heard(i: int, kind: type) -> np.ndarray:
            raw = arrays.unpacked(table["packed"][i].as_py(), np.dtype(kind).itemsize * sizes[i], np.uint8)[0]
            return _joined(raw, sizes[i], kind)

        count = np.concatenate([np.zeros(0, np.int64), *[heard(i, np.int64) for i in order if 0 <= bucket[i] < 1 << bits]])
        logs = np.concatenate([np.zeros(0, np.float32), *[heard(i, np.float32) for i in order if bucket[i] >= 1 << bits]])
        row = table.slice(int(np.flatnonzero(bucket == _OWN)[0]), 1).to_pylist()[0]
        (data,) = arrays.unpacked(row["packed"], row["n"], np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))]).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        parts = []
        for piece in arrays.pieces(texts):
            symbol, ends = symbols(piece)
            low = piece.lowered()
            found = arrays.words(low)
            own, place = np.unique(grams(symbol, ends).astype(np.int64), return_inverse=True)
            parts.append((own, place.astype(np.int32), ends, arrays.span_hashes(low, found.starts, found.ends).view(np.int64), found.counts))
        gram = np.unique(np.concatenate([p[0] for p in parts]))
        value = np.empty(len(gram))
        value[_sorted_out(gram, bits)[0]] = logs
        tree = np.concatenate([arrays.per_document(value[np.searchsorted(gram, own)][place], ends) for own, place, ends, _, _ in parts])
        places = np.unique(np.concatenate([p[3] for p in parts]).view(np.uint64), return_inverse=True)[1]
        sizes = np.concatenate([p[4] for p in parts])
        first = np.concatenate([[0], np.cumsum(sizes)])
        own = count[places]
        base = arrays.per_document(np.log10(own + 1.0) - below, first) + math.log10(training + 1.0) - below
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": sizes.astype(np.int64) + 1,
                "n_known": arrays.per_document(own > 0, first) + (training > 0),
                "train_tokens": np.full(len(sizes), every, np.int64),
                "base_score": base.round(6),
                "score": tree.round(6),
            }
        )

    return run


def score(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    about = rows.agg(F.count_if(~F.col("held")).alias("training"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    bits = arrays.bucket_bits(int(spark.conf.get("spark.sql.shuffle.partitions")), about["size"], 2, MOST_BITS)
    # bundles are named by the task, so small partitions are merged before, not after
    sent = stage(rows.coalesce(files(spark, about["size"])).mapInArrow(_send(bits), _SENT), "tree-sent")
    low = sent.filter(F.col("bucket") == _TRUNK).select("n", "packed").mapInArrow(_low, "gram long, n long")
    low = low.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    stem = spark.sparkContext.broadcast(trunk(*_distinct([(low["gram"].to_numpy(), low["n"].to_numpy())])))
    own = sent.filter(F.col("bucket") == _OWN)
    salts = math.ceil(own.count() / SPREAD)
    known = sent.filter("bucket >= 0").select("bundle", "bucket", "n", "packed")
    if salts <= 1:
        known = stage(known.groupBy("bucket").applyInArrow(_answer(stem, bits), _ANSWER), "tree-known", about["size"])
        pairs = known.filter("bundle is null").select("packed").mapInArrow(_pairs, "seen long, words long")
        known = known.filter("bundle is not null")
    else:
        known = known.withColumn("salt", F.pmod(F.xxhash64("bundle"), F.lit(salts)).cast("int"))
        merged = known.groupBy("bucket", "salt").applyInArrow(_merge(bits), "bucket int, n int, packed binary")
        pairs = stage(merged.groupBy("bucket").applyInArrow(_own(stem, bits), _OWNED), "tree-owned", about["size"])
        dealt = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        known = known.groupBy("bucket", "salt").cogroup(dealt.groupBy("bucket", "salt")).applyInArrow(_reply(bits), _ANSWER)
    sums = pairs.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return known.unionByName(own, allowMissingColumns=True).groupBy("bundle").applyInArrow(
        _sum_up(about["training"], *map(int, sums), bits),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["seen", "words"])
