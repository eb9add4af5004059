"""Quality rules: word and line counts, and bands on the perplexity of Kneser-Ney models, two for each language.

The models are n-gram models (order ``ORDER``) on the bytes of texts, without the case of A-Z and with 0 for every
digit; a language is a value of the ``lang`` column, and null is one of its own. Spark counts the n-grams of whole texts; the counts of lower orders are
continuation counts (different symbols before), and modified Kneser-Ney discounts (one each for counts of one, two and
more, by language and order) give the probabilities and back-off weights, order by order, as joins and aggregations. What is
broadcast is a sorted array of 64-bit hashes of language, order and n-gram, with the log10 of each, found by binary search.
It holds ``MOST_ENTRIES`` at most: if there are more n-grams and contexts, languages are dealt to several such arrays, and the
texts of each are measured with its own, one after the other. A model of more than ``MOST_OF_ONE`` is cut by the two bytes before
an n-gram's last into arrays that are each complete for their n-grams (n-grams of two bytes are in all of them); the sums of a
text over these arrays are added up. Only models of order ``FIRST_ORDER`` are never cut: they have 2^24 n-grams at the very most.

A model of a high order knows what it has counted by heart, junk too. So texts are judged by models that have not seen them
and that learn little junk. First, one model of order ``FIRST_ORDER`` a language counts all texts and measures all; bands are formed
(``FIRST_BAND``). The texts inside are then counted in two halves, by a hash of the text, so that copies are in one half. Each text is
measured by the model of its language's other half, and the bands for the verdict are formed for each of these models.

A document's figure is the mean log10 probability of its bytes, negated. Bands are formed over the
documents that pass the base rules, from the shortest range that holds half of them (in steps of twentieths): junk that is
up to a third of a language, on either side or both, cannot move that range off the rest. ``LOWER`` and ``UPPER`` times half
its width, ``LEAST_SPREAD`` at least, are allowed below and above its centre, and a little more where documents are few.
Outside the band, a document is rejected; its ends are inside.

A null or empty text has counts of 0 and fails the base rules. Very long texts are read whole, as pieces of their own.
Repeated rows each count and each get a row. An empty table gives an empty result. Columns to keep may have any names but
those that are added, ``_language``, ``_own`` and ``_other``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import checked_broadcast, discard, stage, text_size

ORDER, FIRST_ORDER = 5, 3  # by the labelled rows of the given tables, as are the bands: README
MOST_ENTRIES = 1 << 22
MOST_OF_ONE = 1 << 22
LOWER, UPPER = 8.0, 5.0
FIRST_BAND = 5.0, 5.0
LEAST_SPREAD = 0.02
_STEPS = 20
LEAST_WORDS = 50
_FLUSH = 1 << 20
_DENSE = 1 << 23

_SYMBOL = np.arange(256)
_SYMBOL[65:91] += 32
_SYMBOL[48:58] = 48
_MARKED = np.zeros(256, bool)
_MARKED[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,'\"-:;!?()|#$%&*")] = True


def _numbered(value: np.ndarray, more: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (below ``most``) of both in order, and the number of each of the first."""
    if most > _DENSE:
        known, place = np.unique(np.concatenate([value, more]), return_inverse=True)
        return known, place[: len(value)]
    there = np.zeros(most, bool)
    there[value] = True
    there[more] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[value]


def grams(piece: arrays.Piece, of: np.ndarray, languages: int, *orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the (rising) orders: the n-grams of a piece, as language number and code, in that order, and which one ends at
    each byte. The last byte of a code is its lowest; what lies before a document is 0, and n-grams of zeros are always there."""
    symbol = _SYMBOL[piece.data]
    there = np.zeros(256, bool)
    there[symbol] = there[0] = True
    alphabet, symbol = np.flatnonzero(there), (np.cumsum(there) - 1)[symbol]
    n, sizes = len(alphabet), np.diff(piece.offsets)
    first, of_first = piece.offsets[:-1][sizes > 0], of[sizes > 0]
    language = zeros = np.arange(languages)
    code, place = np.zeros(languages, np.int64), np.repeat(of, sizes)
    for order in range(1, max(orders) + 1):
        value = np.empty(len(place), np.int64)
        value[1:] = place[:-1]
        value[first] = zeros[of_first]
        value *= n
        value += symbol
        known, place = _numbered(value, zeros * n, len(code) * n)
        zeros = np.searchsorted(known, zeros * n)
        before, last = np.divmod(known, n)
        language, code = language[before], code[before] << 8 | alphabet[last]
        if order in orders:
            yield language, code, place


def _labelled(batch: pa.RecordBatch, text: int, *labels: int) -> Iterator[tuple[arrays.Piece, list[tuple], np.ndarray]]:
    """Pieces of a batch with their different labels, and the number of each document's."""
    values = list(zip(*(batch.column(i).to_pylist() for i in labels)))
    for piece in arrays.pieces(batch.column(text)):
        number: dict[tuple, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in values[piece.lo : piece.hi]], np.int64)
        yield piece, list(number), of


def _counter(order: int, first: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the n-grams of (text, language); with ``first``, of texts whose figure by that model of (text, language, its language,
    lower, upper) is within these bounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                many = np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)
                for lo in range(0, len(code), 100_000):
                    part = code[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(many[lo : lo + 100_000])], names=["lang", "code", "n"])
            held.clear()

        for batch in arrays.returned(batches):
            if first:
                lower, upper = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (3, 4))
            for piece, names, of in _labelled(batch, 0, *([1, 2] if first else [1])):
                found = grams(piece, of, len(names), *([first.value.order, order] if first else [order]))
                if first:
                    figure = _figure(-first.value.totals([x for _, x in names], piece, *next(found)), piece)
                    inside = (figure >= lower[piece.lo : piece.hi]) & (figure <= upper[piece.lo : piece.hi])
                language, code, place = next(found)
                if first:
                    place = place[np.repeat(inside, np.diff(piece.offsets))]
                many = np.bincount(place, minlength=len(code))
                edge = np.searchsorted(language, np.arange(len(names) + 1))
                for i, (name, *_) in enumerate(names):
                    own = slice(edge[i], edge[i + 1])
                    there = np.flatnonzero(many[own])
                    held.setdefault(name, []).append((code[own][there], many[own][there]))
                    size += len(there)
            if size > _FLUSH:
                yield from out()
                size = 0
        yield from out()

    return count


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, k, d1, d2, d3): what is taken from counts of one, two and more of n-grams of order k."""
    of = counts.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def of_count(c: int, least: float, most: float) -> Column:
        have, more = F.col(f"n{c}"), F.col(f"n{c + 1}")
        taken = F.when(have > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(c)), c - (c + 1) * y * more / have))).otherwise(0.5 * c)
        return F.greatest(F.lit(least), F.least(F.lit(most), taken))

    return of.select("lang", "k", of_count(1, 0.05, 0.95).alias("d1"), of_count(2, 0.05, 1.9).alias("d2"), of_count(3, 0.05, 2.85).alias("d3"))


_COUNTS = "lang string, code long, n long"


def entries(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(kind, lang, code, n, p): probabilities of n-grams (kind 2 x order) and back-off weights of contexts (the odd kinds)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return _entries(rows.mapInArrow(_counter(order), _COUNTS), order, text_size(docs, text))


def _entries(counts: DataFrame, order: int, size: int) -> DataFrame:
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = stage(counts.select(language_key(F.col("lang")).alias("lang"), "code", "n"), "ngram-counts", size)
    tables = [counts]
    for k in range(order - 1, 0, -1):
        below = F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        tables.insert(0, stage(tables[0].groupBy("lang", below.alias("code")).agg(F.count("*").alias("n")), "ngram-counts", size))
    every = [table.select("lang", F.lit(k).alias("k"), "n") for k, table in enumerate(tables, 1)]
    discounts = checked_broadcast(stage(_discounts(reduce(DataFrame.union, every)), "discounts"))
    lower, found = None, []
    for k, table in enumerate(tables, 1):
        table = table.join(discounts.filter(F.col("k") == k).drop("k"), "lang").withColumn("taken", _discount(F.col("n")))
        table = table.withColumn("context", F.shiftright("code", 8))
        alike = Window.partitionBy("lang", "context")  # 256 rows at most
        total, taken, first = (f.over(alike) for f in (F.sum("n"), F.sum("taken"), F.min("code")))
        table = table.withColumns({"total": total, "gamma": taken / total, "first": F.col("code") == first})
        if lower is None:
            below = F.lit(1 / 256)
        else:
            table = table.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
            table = table.join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * below
        lower = stage(table.select("lang", "code", "context", "n", "total", "gamma", "first", p.alias("p")), "ngram-order", size)
        found.append(lower.select(F.lit(2 * k).alias("kind"), "lang", "code", "n", "p"))
        found.append(lower.filter("first").select(F.lit(2 * k + 1), "lang", "context", "total", "gamma"))
    discard(*tables)
    return reduce(DataFrame.union, found)


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _hashed(seed: np.ndarray | np.uint64, kind: np.ndarray | int, code: np.ndarray) -> np.ndarray:
    kind = np.asarray(kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return arrays.mix(arrays.mix(code.astype(np.uint64) ^ kind) + seed)


def language_key(lang: Column) -> Column:
    """'s' and the language, or 'n' for null."""
    return F.concat(F.when(lang.isNull(), "n").otherwise("s"), F.coalesce(lang.cast("string"), F.lit("")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, place = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        seeds = np.array([_seed(x) for x in names], np.uint64)[place] if len(names) else np.zeros(0, np.uint64)
        key = _hashed(seeds, batch.column(0).to_numpy(), batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(3)], names=["key", "p"])


def _part(code: np.ndarray | Column, parts: int) -> np.ndarray | Column:
    """Which of so many parts has the contexts that end in the two last bytes of ``code``."""
    if isinstance(code, Column):
        return F.shiftright((code.bitwiseAND(F.lit(0xFFFF)) * 40503).bitwiseAND(F.lit(0xFFFF)) * parts, 16)
    return ((code & 0xFFFF) * 40503 & 0xFFFF) * parts >> 16


def _figure(total: np.ndarray, piece: arrays.Piece) -> np.ndarray:
    return (total / np.maximum(np.diff(piece.offsets), 1)).round(6) + 0.0  # not -0


@dataclass
class Share:
    """Languages (as ``language_key`` gives them) whose models are in one array, or a part of the model of one."""

    languages: list[str]
    part: int = 0
    parts: int = 1


@dataclass
class KneserNey:
    """Sorted hashes of (language, kind, code), and the log10 of each, for the languages of a share."""

    keys: np.ndarray
    logs: np.ndarray
    share: Share
    order: int

    def find(self, seed: np.ndarray, kind: int, code: np.ndarray) -> np.ndarray:
        """The logs; NaN for what isn't there."""
        out = np.full(len(code), np.nan)
        if len(self.keys) and len(code):
            key = _hashed(seed, kind, code)
            order = np.argsort(key)
            place = np.minimum(np.searchsorted(self.keys, key[order]), len(self.keys) - 1)
            out[order] = np.where(self.keys[place] == key[order], self.logs[place], np.nan)
        return out

    def score(self, seed: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last symbol after the others."""
        out, weight = np.full(len(code), np.nan), np.zeros(len(code))
        for order in range(self.order, 0, -1):
            open_ = np.flatnonzero(np.isnan(out))
            own = code[open_] & ((1 << (8 * order)) - 1)
            out[open_] = self.find(seed[open_], 2 * order, own) + weight[open_]
            open_, own = (x[np.isnan(out[open_])] for x in (open_, own))
            if not len(open_):
                break
            weight[open_] += np.nan_to_num(self.find(seed[open_], 2 * order + 1, own >> 8))
        return np.where(np.isnan(out), weight - 8 * np.log10(2), out)

    def totals(self, names: list[str | None], piece: arrays.Piece, language: np.ndarray, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The sum of the scores of each document's n-grams, as ``grams`` gives them; of a part, those that it has."""
        seeds = np.array([_seed("n" if x is None else f"s{x}") for x in names], np.uint64)
        value = np.zeros(len(code))
        own = np.flatnonzero(_part(code >> 8, self.share.parts) == self.share.part)
        value[own] = self.score(seeds[language[own]], code[own])
        return arrays.per_document(value[place], piece.offsets)


def shares(found: DataFrame, order: int = ORDER) -> list[Share]:
    out, size = [Share([])], 0
    for r in found.groupBy("lang").count().orderBy("lang").collect():  # a row a language
        parts = -(-r["count"] // MOST_OF_ONE) if order > FIRST_ORDER else 1
        if out[-1].languages and (parts > 1 or out[-1].parts > 1 or size + r["count"] > MOST_ENTRIES):
            out.append(Share([]))
            size = 0
        out[-1].languages.append(r["lang"])
        size += r["count"]
        if parts > 1:
            out[-1:] = [Share([r["lang"]], i, parts) for i in range(parts)]
    return out


def load(found: DataFrame, all_shares: list[Share], i: int, order: int = ORDER) -> KneserNey:
    """The array of a share of the models of ``entries``."""
    share = all_shares[i]
    own = found.filter(F.col("lang").isin(share.languages)) if len(all_shares) > 1 else found
    if share.parts > 1:
        context = F.when(F.col("kind") % 2 == 0, F.shiftright("code", 8)).otherwise(F.col("code"))
        own = own.filter((F.col("kind") < 6) | (_part(context, share.parts) == share.part))
    table = own.select("kind", "lang", "code", "p").mapInArrow(_keys, "key long, p double").toArrow()
    key = table["key"].to_numpy().view(np.uint64)
    at = np.argsort(key)
    return KneserNey(key[at], np.log10(table["p"].to_numpy()[at]).astype(np.float32), share, order)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> list[KneserNey]:
    """Count the n-grams of all texts with Spark and build the models of all languages, in one array or more."""
    found = entries(docs, text, lang, order)
    dealt = shares(found, order)
    models = [load(found, dealt, i, order) for i in range(len(dealt))]
    discard(found)
    return models


def _doubled_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    with_word = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(with_word) - len(set(with_word))


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document in windows of three words that occur twice or more in it."""
    starts, doc = arrays.window_starts(first, 3)
    if not len(starts):
        return np.zeros(len(first) - 1, np.int64)
    value = arrays.mix(arrays.window_hashes(hashes, starts, 3) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(value), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[starts[again] + k] = True
    return arrays.per_document(covered, first)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_upper", "n_digits", "n_marks"]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and a few more."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in BASE + MORE}
    for piece in arrays.pieces(texts):
        data, offsets = piece.data, piece.offsets
        found = arrays.words(piece)
        hashes = arrays.span_hashes(piece, found.starts, found.ends)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        out["n_words"].append(found.counts)
        out["word_chars"].append(arrays.per_document(heads[found.ends] - heads[found.starts], found.first))
        out["n_symbols"].append(arrays.per_document(_MARKED[data], offsets))
        out["n_repeat_words"].append(_repeated(hashes, found.first))
        out["n_bytes"].append(np.diff(offsets))
        out["n_upper"].append(arrays.per_document((data >= 65) & (data <= 90), offsets))
        out["n_digits"].append(arrays.per_document((data >= 48) & (data <= 57), offsets))
        out["n_marks"].append(arrays.per_document(_MARKS[data], offsets))
        lines = [_doubled_lines(x.as_py() or "") for x in texts[piece.lo : piece.hi]]
        out["n_dup_lines"].append(np.array(lines, np.int64))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def measure(docs: DataFrame, models: list[KneserNey] | None, text: str = "text", *keep: str, lang: str = "lang") -> DataFrame:
    """``keep`` columns with the counts of every text and, with models, ``perplexity`` (its log10, a byte). With several
    arrays of models, the texts of the languages of each are a pass of their own; a language without any goes with the first."""
    if not models:
        return _measure(docs, None, text, *keep, lang=lang)
    return _passes(docs, [m.share for m in models], lambda i: models[i], lambda df: df, text, *keep, lang=lang)


def _dealt(docs: DataFrame, all_shares: list[Share], lang: str) -> Iterator[tuple[int, DataFrame]]:
    """The number of the first array of each language or group of such, and their documents."""
    key, others = language_key(F.col(lang)), [x for s in all_shares[all_shares[0].parts :] for x in s.languages]
    for i, share in enumerate(all_shares):
        if not share.part:
            yield i, docs.filter(key.isin(share.languages) if i else ~key.isin(others)) if others else docs


def _passes(
    docs: DataFrame, all_shares: list[Share], model: Callable[[int], KneserNey], done: Callable[[DataFrame], DataFrame], text: str, *keep: str, lang: str
) -> DataFrame:
    """``measure`` with the models that ``model`` gives by number, one after the other; each pass ends with ``done``."""
    found = None
    for i, own in _dealt(docs, all_shares, lang):
        parts = all_shares[i].parts
        if parts == 1:
            rows = done(_measure(own, model(i), text, *keep, lang=lang))
        else:
            same = [F.xxhash64(F.lit(k), language_key(F.col(lang)), F.col(text)).alias(f"_same{k}") for k in (0, 1)]
            own, by, sums = own.select("*", *same), ["_same0", "_same1"], None
            for k in range(parts):
                part = done(_sums(own, model(i + k), text, by, lang).groupBy(by).agg(F.max("_sum").alias("_sum")))
                sums = part if sums is None else sums.union(part)
            sums = sums.groupBy(by).agg(F.sum("_sum").alias("_sum"))
            rows = _measure(own, None, text, *keep, *by, lang=lang).join(sums, by)
            figure = F.round(F.col("_sum") / 1e9 / F.greatest(F.col("_n_bytes"), F.lit(1)), 6)
            rows = done(rows.withColumn("_perplexity", figure).drop(*by, "_sum"))
        found = rows if found is None else found.union(rows)
    return found


def _sums(docs: DataFrame, model: KneserNey, text: str, keep: list[str], lang: str) -> DataFrame:
    """Sums of the part of a model for every text, negated, in billionths: whole numbers have one sum in any order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.returned(batches):
            total = [np.zeros(0)]
            for piece, names, of in _labelled(batch, 0, 1):
                total.append(-shared.value.totals([x for x, in names], piece, *next(grams(piece, of, len(names), shared.value.order))))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array((np.concatenate(total) * 1e9).round().astype(np.int64))], names=[*keep, "_sum"])

    rows = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), *keep)
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in [*keep, "_sum"]))


def _measure(docs: DataFrame, model: KneserNey | None, text: str, *keep: str, lang: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    schema = docs.select(*keep).schema
    for k in BASE + MORE:
        schema = schema.add(f"_{k}", "long")
    schema = schema.add("_perplexity", "double")
    n = len(keep)

    def perplexity(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.zeros(0)]
        for piece, names, of in _labelled(batch, n, n + 1):
            found.append(_figure(-shared.value.totals([x for x, in names], piece, *next(grams(piece, of, len(names), shared.value.order))), piece))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.returned(batches):
            found = counts(batch.column(n))
            figure = perplexity(batch) if shared else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(v) for v in found.values()] + [pa.array(figure)],
                names=[*keep, *[f"_{k}" for k in found], "_perplexity"],
            )

    more = [F.col(lang).cast("string").alias("_lang")] if shared else []
    return docs.select(*keep, F.col(text).alias("_text"), *more).mapInArrow(run, schema)


def _failed() -> Column:
    return (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def _bands(measured: DataFrame, by: str, lower: float, upper: float) -> DataFrame:
    half = _STEPS // 2
    ranges = F.transform(
        F.sequence(F.lit(0), F.lit(half)),
        lambda i: F.struct(F.round(F.col("_q")[i + half] - F.col("_q")[i], 9).alias("width"), F.col("_q")[i].alias("low")),
    )
    shortest, few = F.array_min(ranges), 1 + 5 / F.col("_n")
    centre = shortest["low"] + shortest["width"] / 2
    room = lambda times: few * F.greatest(F.lit(LEAST_SPREAD), times * shortest["width"] / 2)
    bands = (
        measured.filter(~_failed())
        .groupBy(by)
        # of values rounded to thousandths: exact, and as small as the range of the values
        .agg(
            F.percentile(F.round("_perplexity", 3), F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)])).alias("_q"),
            F.count("*").alias("_n"),
        )
        .select(by, (centre - room(lower)).alias("_lower"), (centre + room(upper)).alias("_upper"))
    )
    return checked_broadcast(stage(bands, "bands"))


def learnt(docs: DataFrame, text: str, lang: str, own: str) -> DataFrame:
    """``entries`` of the models by ``own``, of all texts that are inside the band of their language."""
    docs = docs.select(F.col(text).alias("text"), F.col(own).alias("own"), F.col(lang).alias("lang"))
    size = text_size(docs, "text")
    first = _entries(docs.select("text", "lang").mapInArrow(_counter(FIRST_ORDER), _COUNTS), FIRST_ORDER, size)
    dealt = shares(first, FIRST_ORDER)
    seen = _passes(docs, dealt, lambda i: load(first, dealt, i, FIRST_ORDER), lambda df: stage(df, "first"), "text", "lang", lang="lang")
    within, counts = docs.join(_bands(seen, "lang", *FIRST_BAND), "lang", "left"), None
    for i, rows in _dealt(within, dealt, "lang"):
        shared = docs.sparkSession.sparkContext.broadcast(load(first, dealt, i, FIRST_ORDER))
        rows = rows.select("text", "own", "lang", "_lower", "_upper").mapInArrow(_counter(ORDER, shared), _COUNTS)
        rows = rows if len(dealt) == 1 else stage(rows, "ngrams", size)
        counts = rows if counts is None else counts.union(rows)
    found = _entries(counts, ORDER, size)
    discard(first, seen, *([counts] if len(dealt) > 1 else []))
    return found


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", *keep: str) -> DataFrame:
    """``keep`` columns, the counts, ``_base_failed``, ``_perplexity``, the band of its language and half and ``_kept``."""
    half, language = F.pmod(F.xxhash64(text), F.lit(2)), language_key(F.col(lang))
    docs = docs.withColumns({"_language": language, "_own": F.concat(half, language), "_other": F.concat(1 - half, language)})
    found = learnt(docs, text, "_language", "_own")
    dealt = shares(found)
    columns = dict.fromkeys([*keep, lang, "_other"])
    measured = _passes(docs, dealt, lambda i: load(found, dealt, i), lambda df: stage(df, "quality"), text, *columns, lang="_other")
    discard(found)
    kept = ~F.col("_base_failed") & F.col("_perplexity").between(F.col("_lower"), F.col("_upper"))
    return (
        measured.withColumn("_base_failed", _failed())
        .join(_bands(measured, "_other", LOWER, UPPER), "_other", "left")
        .withColumn("_kept", F.coalesce(kept, F.lit(False)))
        .drop("_other")
    )
