"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is inside a document if at least ``PERCENT`` in a hundred of its distinct ``WIDTH``-word shingles (without case;
an item of fewer words is one shingle) occur in the document. A short item has almost no Jaccard similarity with a long
document, so documents are searched in segments of the items' size: items are partitioned by their number of shingles
(classes grow by a quarter), and for each class documents are cut into overlapping segments a quarter longer than the
class, so that an item's occurrence lies whole in one of them. One-permutation MinHash with ``BINS`` bins and bands of one
value: item and segment are a candidate if they have the same least hash in a bin.

The search starts from the items' values, which are few: only places of a document whose shingle hash is such a value can
be a segment's least hash, and for those the segment's other hashes in the bin are looked at. Up to ``INLINE`` values are
a set in the expression; more are joined. Candidates are verified on the words themselves, over the whole document.

All of it is DataFrame functions. Very long texts are searched whole. Items and documents without words match nothing. Repeated documents each give their
rows, and repeated items theirs. Null ids are carried. Without items, or documents, the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, checked_broadcast, shield, stage

WIDTH = 5
PERCENT = 75
BINS = 64
INLINE = 20_000
GROWTH = 1.25


def normalised(text: Column) -> Column:
    """The words in lower case, with one blank between them and at both ends; a blank for a text without words."""
    spaced = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.regexp_replace(spaced, "[\\x20\\x09-\\x0D]+", " ")


def _words(padded: Column) -> Column:
    return F.when(F.length(padded) > 1, F.split(F.btrim(padded, F.lit(" ")), " ")).otherwise(F.array().cast("array<string>"))


def _windows(words: Column, width: int, of) -> Column:
    """``of`` the words of each window of ``width`` words, in order."""
    last = F.size(words) - width
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: of([F.get(words, i + k) for k in range(width)]))
    )


def _hashes(words: Column, width: int) -> Column:
    made = _windows(words, width, lambda w: F.xxhash64(*w))
    return F.coalesce(made, F.array().cast("array<bigint>"))


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row an item with words: its distinct shingles as text and as hashes, and its size class."""
    rows = items.select(F.col(item_id).alias("item_id"), normalised(F.col(text)).alias("padded"))
    rows = rows.withColumn("words", _words(F.col("padded"))).filter("size(words) > 0")
    width = F.least(F.lit(WIDTH), F.size("words"))
    by_width = lambda f: F.coalesce(*[F.when(width == k, f(k)) for k in range(1, WIDTH + 1)])
    shingles = by_width(lambda k: _windows(F.col("words"), k, lambda w: F.concat_ws(" ", *w)))
    hashes = by_width(lambda k: _hashes(F.col("words"), k))
    made = rows.select(
        F.monotonically_increasing_id().alias("item"),
        "item_id",
        width.alias("width"),
        F.array_distinct(shingles).alias("shingles"),
        F.array_distinct(hashes).alias("hashes"),
    )
    size = F.size("shingles")
    step = F.ceil(F.round(F.log(size) / F.log(F.lit(GROWTH)), 6))
    return made.withColumns(
        {"n": size, "upper": F.greatest(size, F.ceil(F.pow(F.lit(GROWTH), step)).cast("int"))}
    )


def signature(items: DataFrame) -> DataFrame:
    """The least hash of each item in each bin, with the length and stride of its class's segments."""
    return (
        items.select("item", "width", "upper", F.explode("hashes").alias("h"))
        .groupBy("item", "width", "upper", F.pmod("h", F.lit(BINS)).alias("bin"))
        .agg(F.min("h").alias("h"))
        .select(
            "item",
            "width",
            "h",
            "bin",
            F.ceil(F.col("upper") * GROWTH).cast("int").alias("span"),
            F.greatest(F.lit(1), F.floor(F.col("upper") * (GROWTH - 1))).cast("int").alias("stride"),
        )
    )


class Benchmark:
    """Items made ready for a search: tables ``items`` and ``values``, and what is known of their size."""

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text"):
        self.items = stage(item_table(items, item_id, text), "leak-items")
        self.values = stage(signature(self.items), "leak-values")
        about = self.values.groupBy("width").agg(F.count("*").alias("n"), F.max("span").alias("span")).collect()
        self.widths = {r["width"]: r["span"] for r in about}  # 1 to 5
        self.count = sum(r["n"] for r in about)
        self.inline: dict[int, list[int]] = {}
        if self.count <= INLINE:
            for r in self.values.select("width", "h").distinct().collect():
                self.inline.setdefault(r["width"], []).append(r["h"])


def _nowhere() -> Column:
    return F.array().cast("array<int>")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, and wherever Catalyst moves it."""
    return F.transform(F.array(value), body)[0]


def _places_of(hashes: Column, values: list[int]) -> Column:
    """The hashes with the places of those among ``values``."""
    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(_nowhere())
    return F.struct(hashes.alias("h"), F.filter(places, lambda i: F.get(hashes, i).isin(values)).alias("at"))


def _placed(docs: DataFrame, bench: Benchmark, text: str, hits_only: bool) -> DataFrame:
    """``docs`` with ``_row`` and, where they hold one of the items' values, ``_padded`` and ``_w{k}`` for each width k."""
    if not bench.inline:
        return _placed_by_join(docs, bench, text, hits_only)

    def search(padded: Column) -> Column:
        def of_words(words: Column) -> Column:
            return F.struct(*[_let(_hashes(words, k), lambda h: _places_of(h, bench.inline.get(k, []))).alias(f"w{k}") for k in sorted(bench.widths)])  # noqa: B023

        return _let(_words(padded), of_words)

    def wanted(found: Column) -> Column:
        return F.greatest(F.lit(0), F.lit(0), *[F.size(found[f"w{k}"]["at"]) for k in bench.widths]) > 0

    both = _let(normalised(F.col(text)), lambda p: F.struct(p.alias("padded"), search(p).alias("found")))
    # exploding an array of one or none filters the rows without a second evaluation of the search
    kept = F.filter(F.array(both), lambda x: wanted(x["found"]))
    made = docs.withColumn("_both", F.explode(kept) if hits_only else F.explode_outer(kept))
    made = made.select(*docs.columns, F.col("_both.padded").alias("_padded"), *[F.col(f"_both.found.w{k}").alias(f"_w{k}") for k in sorted(bench.widths)])
    return stage(made.withColumn("_row", F.monotonically_increasing_id()), "leak-places")


def _placed_by_join(docs: DataFrame, bench: Benchmark, text: str, hits_only: bool) -> DataFrame:
    """The same for many values: every place's hash meets the values in a join, and only those that have one are kept."""
    base = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "leak-documents")
    found = None
    hashes = lambda k: _let(_words(normalised(F.col(text))), lambda w: _hashes(w, k))
    for k in sorted(bench.widths):
        own = bench.values.filter(F.col("width") == k).select("h").distinct()
        own = F.broadcast(own) if bench.count <= BROADCAST_ROWS else own
        places = base.select("_row", F.posexplode(hashes(k)).alias("at", "h")).join(own, "h", "left_semi")
        one = places.groupBy("_row").agg(F.sort_array(F.collect_list("at")).alias(f"_at{k}"))
        found = one if found is None else found.join(one, "_row", "full_outer")
    made = base.join(found, "_row", "inner" if hits_only else "left")
    hit = F.coalesce(*[F.col(f"_at{k}") for k in bench.widths]).isNotNull()
    lists = {k: F.struct(hashes(k).alias("h"), F.coalesce(f"_at{k}", _nowhere()).alias("at")) for k in sorted(bench.widths)}
    return stage(
        made.select(*docs.columns, F.when(hit, normalised(F.col(text))).alias("_padded"), *[F.when(hit, w).alias(f"_w{k}") for k, w in lists.items()], "_row"),
        "leak-places",
    )


def _candidates(placed: DataFrame, bench: Benchmark) -> DataFrame:
    """Distinct (_row, item) that share a bin's least hash in a segment."""
    found = None
    for k, reach in bench.widths.items():
        h, at = F.col("h"), F.col("at")
        places = placed.select("_row", F.explode(f"_w{k}.at").alias("at"), F.col(f"_w{k}.h").alias("h")).select(
            "_row",
            "at",
            F.get(h, at).alias("h"),
            F.greatest(F.lit(0), at - reach).alias("base"),
            F.slice(h, F.greatest(F.lit(1), at - reach + 1), F.lit(2 * reach + 1)).alias("near"),
        )
        own = bench.values.filter(F.col("width") == k)
        own = F.broadcast(own) if bench.count <= BROADCAST_ROWS else own
        span, stride = F.col("span"), F.col("stride")
        first = F.greatest(F.lit(0), F.ceil((at - span + 1) / stride)).cast("int")
        starts = F.sequence(first, F.floor(at / stride).cast("int"))
        least = F.exists(
            starts,
            lambda s: F.forall(
                F.slice(
                    F.col("near"),
                    F.greatest(F.lit(1), s * stride - F.col("base") + 1),
                    (span + F.least(F.lit(0), s * stride - F.col("base"))).cast("int"),
                ),
                lambda x: (F.pmod(x, F.lit(BINS)) != F.col("bin")) | (x >= F.col("h")),
            ),
        )
        one = places.join(own, "h").filter(least).select("_row", "item").distinct()
        found = one if found is None else found.union(one)
    return found


def leaks(docs: DataFrame, bench: Benchmark, text: str = "text", hits_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents, or only those that hold a value, with ``_row`` and ``_padded`` (null for the others), and (_row,
    item_id, n_shingles, n_matched) of the items in them."""
    placed = _placed(docs, bench, text, hits_only)
    searched = placed.filter("_padded is not null")
    pairs = _candidates(searched, bench)
    items = bench.items.select("item", "item_id", "shingles")
    matched = F.size(
        F.filter("shingles", lambda s: F.contains(F.col("_padded"), F.concat(F.lit(" "), s, F.lit(" "))))
    )
    found = (
        searched.select("_row", "_padded")
        .join(pairs, "_row")
        .join(checked_broadcast(items), "item")
        .select("_row", "item_id", F.size("shingles").alias("n_shingles"), matched.alias("n_matched"))
        .filter(F.col("n_matched") * 100 >= F.col("n_shingles") * PERCENT)
    )
    return placed, found


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns of each document with each item inside it, ``_item_id``, ``_n_shingles`` and ``_n_matched``."""
    bench = Benchmark(items)
    if not bench.widths:
        return docs.select(
            *keep,
            F.lit(None).cast("long").alias("_item_id"),
            F.lit(0).alias("_n_shingles"),
            F.lit(0).alias("_n_matched"),
        ).limit(0)
    inside, name, _ = shield(docs.select(*dict.fromkeys([*keep, text])))
    placed, found = leaks(inside, bench, name(text))
    return placed.select("_row", *[name(c) for c in keep]).join(found, "_row").select(
        *[F.col(name(c)).alias(c) for c in keep],
        F.col("item_id").alias("_item_id"),
        F.col("n_shingles").alias("_n_shingles"),
        F.col("n_matched").alias("_n_matched"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold an item. Only documents with a value of an item are ever shuffled."""
    bench = Benchmark(items)
    if not bench.widths:
        return docs
    inside, name, back = shield(docs)
    placed, found = leaks(inside, bench, name(text), False)
    held = placed.filter("_padded is not null").join(found.select("_row"), "_row", "left_anti").select(*inside.columns)
    return back(placed.filter("_padded is null").select(*inside.columns).union(held))
