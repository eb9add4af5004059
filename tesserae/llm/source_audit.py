"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

Tasks count with Arrow's compute functions: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and the hash
``group_by`` turn a block of whole texts into counts of (language, source, term), which a task merges over its blocks, up
to ``HELD`` rows, and then sends on. Spark adds the partial counts up; a term stays if ``LEAST_DOCS`` documents of its
language have it. The kept counts of a language are dealt by term into columnar shards; a shard holds a matrix of sources by
terms, some terms at a time, and gives partial sums for each pair of sources and its best ``TOP`` terms of each source.

All arithmetic is on integers. With c the count of a term, N the sum of the counts of the kept terms and V their number,
p = 1 + floor(10^9 (c + 1) / (N + V)), in long division, as the product may exceed 64 bits; the divergence of p from q is
the sum of floor((p - q)^2 / q). One term's share is below 10^18 + 1 and so is a sum of them while V is below 10^9.

Skew: a key of the first exchange gets one row from each task at most, one of the second a row for each source. Shards
follow from the number of kept counts, not from sources or languages. The result has a row for each pair of sources of a
language, as is asked for, so it grows with the square of the sources, never of the documents.

Null language, source and text count as empty; a group without terms takes part with counts of 0; without any kept term,
divergences are 0. A very long text is a block of its own. A repeated row is a document of its own. Ties are ranked by
the item in the order of its UTF-8 bytes. An empty table gives an empty result. Other columns are not read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import stage, text_size, tuned

#: What stands between terms: all of ASCII but its letters.
GAP = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Bytes of text that are split at once, rows of partial counts that a task holds, kept counts of a shard, cells of a matrix.
BLOCK, HELD, SHARD, CELLS = 4 << 20, 400_000, 200_000, 1 << 19

_COUNTS = ["lang", "source", "term", "n", "docs"]
_KEYS = _COUNTS[:3]


def _block_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of a block of documents; a row with the empty term for each group that occurs."""
    lang, source = (x.fill_null("").dictionary_encode() for x in (lang, source))
    of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    group = of_lang * len(source.dictionary) + of_source
    parts = pc.split_pattern_regex(pc.ascii_lower(text.fill_null("")), pattern=GAP)
    doc, term = pc.list_parent_indices(parts), parts.flatten()
    own = pc.not_equal(term, "")
    doc, term = doc.filter(own), term.filter(own).dictionary_encode()
    in_doc = pa.table({"doc": doc, "code": term.indices}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    in_doc = in_doc.append_column("group", pa.array(group[in_doc["doc"].to_numpy()]))
    found = in_doc.group_by(["group", "code"], use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    present = np.unique(group)
    at = np.concatenate([present, found["group"].to_numpy()])
    none, zero = pa.nulls(len(present), pa.string()).fill_null(""), np.zeros(len(present), np.int64)
    return pa.table(
        {
            "lang": lang.dictionary.take(pa.array(at // max(1, len(source.dictionary)))),
            "source": source.dictionary.take(pa.array(at % max(1, len(source.dictionary)))),
            "term": pa.concat_arrays([none, term.dictionary.take(found["code"].combine_chunks())]),
            "n": np.concatenate([zero, found["count_all_sum"].to_numpy()]),
            "docs": np.concatenate([zero, found["count_all_count"].to_numpy()]),
        }
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns(_COUNTS)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in arrays.returned(batches):
        for piece in arrays.pieces(batch.column(2), BLOCK):
            held.append(_block_counts(*[c.slice(piece.lo, piece.hi - piece.lo) for c in batch.columns]))
            if sum(map(len, held)) > HELD:
                held = [_merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from held[0].combine_chunks().to_batches(50_000)
                    held = []
    if held:
        yield from _merged(held).combine_chunks().to_batches(50_000)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with the empty term for each group that occurs."""
    rows = docs.select(*[F.col(c).cast("string") for c in (lang, source, text)])
    found = rows.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counted: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, fresh) of terms in ``least`` documents of their language or more, and all rows of groups;
    ``fresh`` is 1 in one row of each term."""
    term = Window.partitionBy("lang", "term")
    nth = F.row_number().over(term.orderBy("source"))
    seen = counted.withColumns({"_all": F.sum("docs").over(term), "fresh": ((nth == 1) & (F.col("term") != "")).cast("int")})
    return seen.filter((F.col("term") == "") | (F.col("_all") >= least)).select(*_KEYS, "n", "fresh")


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), three digits at a time."""
    rest, out = n + 1, np.zeros(np.broadcast(n, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


_FOUND = "lang string, source string, part string, item string, value long"


def _diverge(key: tuple[pa.Scalar, ...], held: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard: partial sums for each pair of the language's sources, and the best terms of each source in it."""
    sources = groups["source"].combine_chunks()
    sizes, terms = groups["size"].to_numpy(), groups["terms"].to_numpy()
    k, every = len(sources), int(sizes.sum())
    names = held["term"].combine_chunks().dictionary_encode()
    who = pc.index_in(held["source"], sources).to_numpy().astype(np.int64)
    code, n = names.indices.to_numpy().astype(np.int64), held["n"].to_numpy()
    spelt = pc.sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(spelt), np.int64)  # of a term among those of the shard, by its bytes
    place[spelt] = np.arange(len(spelt))
    order = np.argsort(place[code], kind="stable")
    who, at, n = who[order], place[code][order], n[order]
    total, pairs, best = (sizes + terms)[:, None], np.zeros((k, k), np.int64), []
    step = max(1, CELLS // max(1, k))
    for lo in range(0, len(spelt), step):
        hi = min(lo + step, len(spelt))
        a, b = np.searchsorted(at, [lo, hi])
        table = np.zeros((k, hi - lo), np.int64)
        table[who[a:b], at[a:b] - lo] = n[a:b]
        p = _share(table, total)
        q = _share(table.sum(0), np.int64(every + terms[0]))
        for i in range(k):
            gap = p[i] - p
            pairs[i] += (gap * gap // p).sum(1)
        i, t = np.nonzero((table > 0) & (p > q))
        gap = p[i, t] - q[t]
        best.append((i, t + lo, gap * gap // q[t]))
    i, t, value = (np.concatenate(x) for x in zip(*best, strict=True)) if best else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((t, -value, i))
    i, t, value = i[order], t[order], value[order]
    head = np.searchsorted(i, i)
    own = np.arange(len(i)) - head < TOP
    i, t, value = i[own], t[own], value[own]
    one, two = np.nonzero(~np.eye(k, dtype=bool))
    item = [sources.take(pa.array(two)), names.dictionary.take(pa.array(spelt[t]))]
    out = {
        "lang": pa.array([key[0].as_py()] * (len(one) + len(i)), pa.string()),
        "source": sources.take(pa.array(np.concatenate([one, i]))),
        "part": pa.array(["pair"] * len(one) + ["term"] * len(i), pa.string()),
        "item": pa.concat_arrays([x.cast(pa.string()) for x in item]),
        "value": pa.array(np.concatenate([pairs[one, two], value])),
    }
    return pa.table(out)


def divergences(kept: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) from the kept counts, which must be a table that can be read again.

    Part ``pair``: the divergence of each source from each other one of its language. Part ``term``: the ``TOP`` terms
    that a source has more often than its language, by what each adds to the divergence of the source from the language.
    """
    of_lang = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("fresh").alias("terms"))
    groups = groups.withColumn("terms", F.sum("terms").over(of_lang))
    shards = max(1, -(-kept.count() // SHARD))
    terms = kept.filter(F.col("term") != "").select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n")
    asked = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = terms.groupBy("lang", "shard").cogroup(asked.groupBy("lang", "shard")).applyInArrow(_diverge, _FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``divergences`` of a table of documents."""
    tuned(docs.sparkSession)
    size = text_size(docs, text)
    return divergences(stage(kept_counts(counts(docs, text, lang, source)), "audit-counts", size))
