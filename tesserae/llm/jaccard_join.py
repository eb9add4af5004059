"""N-gram Jaccard join with grouped prefixes: links between texts whose shingle sets are similar, and their components.

A document's set is its distinct ``WIDTH``-word shingles without case (fewer words: the whole sequence as one). Two
documents link when 100 x intersection >= 75 x union. Components are those of all links, and none is estimated; pairs whose
members already are in one component are not tried, so the table of all links is not made:

1. Shingles are sent to buckets of their hash, which count in how many documents each occurs and send those in two or
   more back to the bundle of documents they came from. Copies inside a bundle send their set once.
2. In order of rising frequency, a set of n must share one of its first n - ceil(0.75 n) + 1 shingles with any set it
   links to. Shingles of one document come first, so a document with enough of them links to nothing and is done.
3. The others with the same set form a class; classes with the same size and prefix form a group. Groups that share a
   prefix shingle are paired if their sizes and the shingle's positions allow enough overlap.
4. Pairs are verified with the shared shingles of both sides; the shingles of only one document never intersect. First
   every group is paired with one group of each shingle, and members with one member of their group: the one whose
   shingles are the most frequent, as among near copies this is the text that the others were made from. Then only pairs
   of different components are left to try, and all of those are that a bitmap of each set doesn't rule out. So a large
   group of near copies costs a few pairs a member, and no link between different components can be missed.

Shingles are told apart by 64-bit hashes everywhere.
Null and empty texts have an empty set, link to nothing, and are their own component. Very long texts are whole pieces. Rows
that share an id are one node: all texts of an id, an empty one too, are in one component, and so is what any of them links to. Rows without an id are nodes by their text, with numbers from ``NO_ID`` on, above all ids. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import NO_ID, checked_broadcast, discard, node, stage, text_size

WIDTH = 5
PERCENT = 75
BUNDLE = 8 << 20
SALTS = 16
CROWD = 2_000  # members of a key that one task compares
PARITY = 8  # words of 64 bits in the parity bitmap of a set; a power of two
_SENT = (
    "bucket int, bundle string, packed binary, size int,"
    "ids array<bigint>, sizes array<bigint>, one array<bigint>, two array<bigint>, leaders array<int>"
)
_SENT_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("bundle", pa.string()), ("packed", pa.binary()), ("size", pa.int32())]
    + [(k, pa.list_(pa.int64())) for k in ("ids", "sizes", "one", "two")]
    + [("leaders", pa.list_(pa.int32()))]
)


def _digests(value: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's set: sums of two hashes of its shingles."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(arrays.mix(value ^ np.uint64(salt)), out=total[1:])
        out.append((total[edge[1:]] - total[edge[:-1]]).astype(np.int64))
    return out[0], out[1]


def _send(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (id, text) -> a row for each bundle and bucket of shingles, and one with the bundle's documents."""

    def bundled(name: str, ids: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codec = pa.Codec("zstd", 1)
        value = np.concatenate([v for v, _ in sets])
        size = np.concatenate([np.diff(e) for _, e in sets])
        edge = np.concatenate([[0], np.cumsum(size)])
        one, two = _digests(value, edge)
        # the first of equal sets, in order of id, sends the shingles
        order = np.lexsort((ids, two, one, size))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            same[1:] = (
                (one[order][1:] == one[order][:-1])
                & (two[order][1:] == two[order][:-1])
                & (size[order][1:] == size[order][:-1])
            )
        leader = np.zeros(len(order), np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        doc = np.repeat(np.arange(len(size)), size)
        own = leader[doc] == doc
        value, doc = value[own], doc[own]
        bucket = (value >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        by = np.argsort(bucket, kind="stable")
        value = value[by]
        doc = doc[by].astype(np.int32)
        cut = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)):
            x, y = cut[b], cut[b + 1]
            packed = np.diff(doc[x:y], prepend=np.int32(0)).tobytes() + value[x:y].tobytes()
            rows.append(
                {"bucket": int(b), "bundle": name, "packed": codec.compress(packed, asbytes=True), "size": int(y - x)}
            )
        about = {"ids": ids.tolist(), "sizes": size.tolist(), "one": one.tolist(), "two": two.tolist()}
        at = zlib.crc32(name.encode()) % (1 << bits)
        rows.append({"bucket": at, "bundle": name, "size": 0, **about, "leaders": leader.astype(np.int32).tolist()})
        return pa.RecordBatch.from_pylist(rows, schema=_SENT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets, weight, lo = [], 0, 0
            for piece in arrays.pieces(batch.column(1)):
                low = piece.lowered()
                found = arrays.words(low)
                hashes = arrays.span_hashes(low, found.starts, found.ends)
                sets.append(arrays.shingle_sets(hashes, found.first, WIDTH))
                weight += len(piece.data)
                if weight >= BUNDLE or piece.hi == len(batch):
                    yield bundled(f"{task}-{serial}", ids[lo : piece.hi], sets)
                    sets, weight, lo, serial = [], 0, piece.hi, serial + 1

    return run


def _share(table: pa.Table) -> pa.Table:
    """A bucket: to each bundle, its shingles that occur elsewhere too, with their counts (65,535 at most)."""
    codec = pa.Codec("zstd", 1)
    rows = table.to_pylist()
    parts = [(arrays.unpacked(r["packed"], r["size"], np.int32, np.uint64) if r["size"] else None) for r in rows]
    own = [p[1] for p in parts if p]
    values = np.concatenate(own) if own else np.zeros(0, np.uint64)
    order = np.argsort(values)
    sorted_ = values[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(sorted_)))
    df = np.empty(len(values), np.int64)
    df[order] = np.repeat(many, many)
    at, out = 0, []
    for r, p in zip(rows, parts, strict=True):
        if not p:
            out.append(r)
            continue
        count = df[at : at + r["size"]]
        at += r["size"]
        shared = np.flatnonzero(count > 1)
        if len(shared):
            doc = np.cumsum(p[0])[shared].astype(np.int32)
            packed = np.diff(doc, prepend=np.int32(0)).tobytes() + p[1][shared].tobytes()
            packed += np.minimum(count[shared], 65535).astype(np.uint16).tobytes()
            out.append(r | {"packed": codec.compress(packed, asbytes=True), "size": len(shared)})
    return pa.Table.from_pylist(out, schema=_SENT_SCHEMA)


_LIVE = "id long, n int, one long, two long, unique int, middle double, bits array<bigint>, prefix array<bigint>, shared binary, n_shared int"


_LIVE_SCHEMA = pa.schema(
    [("id", pa.int64()), ("n", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("unique", pa.int32())]
    + [("middle", pa.float64()), ("bits", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary()), ("n_shared", pa.int32())]
)


def _prefixes(table: pa.Table) -> pa.Table:
    """A bundle: prefix and shared shingles of those class leaders that may link to something."""
    schema = _LIVE_SCHEMA
    codec = pa.Codec("zstd", 1)
    rows = table.to_pylist()
    leads = {i for r in rows for i in r["lead"] or ()}
    about = next((r for r in rows if r["ids"] is not None), None)
    docs, keys, counts = [], [], []
    for r in rows:
        if r["packed"] is not None:
            doc, rest, df = arrays.unpacked(r["packed"], r["size"], np.int32, np.uint64, np.uint16)
            docs.append(np.cumsum(doc))
            keys.append(rest.view(np.int64))
            counts.append(df)
    if not docs or not leads or about is None:
        return schema.empty_table()
    doc, key, df = np.concatenate(docs), np.concatenate(keys), np.concatenate(counts)
    wanted = np.zeros(len(about["ids"]), bool)
    wanted[list(leads)] = True
    own = wanted[doc]
    doc, key, df = doc[own], key[own], df[own]
    order = np.lexsort((key, df, doc))
    doc, key, weight = doc[order], key[order], np.log(df[order])
    edge = np.searchsorted(doc, np.arange(len(wanted) + 1))
    out: dict[str, list] = {k: [] for k in schema.names}
    for d in np.flatnonzero(np.diff(edge) > 0):
        n, shared = about["sizes"][d], key[edge[d] : edge[d + 1]]
        unique = n - len(shared)
        length = n - (PERCENT * n + 99) // 100 + 1 - unique
        if length <= 0:
            continue
        prefix = shared[:length]
        g = np.concatenate([[n], prefix]).astype(np.uint64)
        place = np.arange(len(g), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for name, salt in (("one", 0x51ED270B), ("two", 0x2545F491)):
            out[name].append(arrays.mix(arrays.mix(g ^ np.uint64(salt)) + place).sum(dtype=np.uint64).astype(np.int64))
        out["id"].append(about["ids"][d])
        out["n"].append(n)
        out["unique"].append(unique)
        out["middle"].append(round(float(weight[edge[d] : edge[d + 1]].sum()) / n, 6))
        odd = np.bincount(arrays.mix(shared.astype(np.uint64)) & np.uint64(64 * PARITY - 1), minlength=64 * PARITY) & 1
        out["bits"].append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        out["prefix"].append(prefix)
        out["shared"].append(codec.compress(np.sort(shared).tobytes(), asbytes=True))
        out["n_shared"].append(len(shared))
    return pa.table({k: pa.array(out[k], schema.field(k).type) for k in schema.names})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sides' shared shingles -> the pairs that link."""
    codec = pa.Codec("zstd")
    for batch in batches:
        keep = []
        last, left = None, None
        for i, r in enumerate(batch.select(["a", "n_a", "k_a", "s_a", "n_b", "k_b", "s_b"]).to_pylist()):
            if last != (r["a"], r["s_a"]):
                last = (r["a"], r["s_a"])
                left = np.frombuffer(codec.decompress(r["s_a"], 8 * r["k_a"], asbytes=True), np.int64)
            right = np.frombuffer(codec.decompress(r["s_b"], 8 * r["k_b"], asbytes=True), np.int64)
            both = np.intersect1d(left, right).size
            if 100 * both >= PERCENT * (r["n_a"] + r["n_b"] - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _links(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Only b's shingles travel to a; a node with many pairs is dealt over salts."""
    side = live.select("id", "n", "n_shared", "shared")
    right = side.toDF("b", "n_b", "k_b", "s_b")
    left = side.toDF("a", "n_a", "k_a", "s_a").join(pairs.select("a").distinct(), "a", "left_semi")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.join(right, "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return dealt.join(left, ["a", "salt"]).mapInArrow(_verify, "a long, b long").distinct()


def components(links: DataFrame, size: int | None = None) -> DataFrame:
    """(id, component) of every node in ``links`` (a, b): the smallest id that can be reached.

    Each round a node takes the least label among its own, its neighbours' and that of its label, until none changes.
    """
    both = stage(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "join-edges", size)
    label = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).toDF("id", "c"), "join-labels", size)
    while True:
        near = both.join(label.toDF("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
        far = label.toDF("c", "far")
        # a label is the id of a node, so its own label is known
        following = (
            label.join(near, "id", "left")
            .join(far, "c", "left")
            .select("id", F.col("c").alias("was"), F.least("c", F.coalesce("near", "c"), F.coalesce("far", "c")).alias("c"))
        )
        before, label = label, stage(following, "join-labels", size)
        discard(before)
        if label.filter("c < was").isEmpty():
            discard(both)
            return label.select("id", F.col("c").alias("component"))
        label = label.drop("was")


def _possible(n_a: Column, n_b: Column, at_a: Column, at_b: Column) -> Column:
    """Whether sets of n_a and n_b whose first common shingle is at these places (from 0) can overlap enough."""
    least = F.ceil(PERCENT * (n_a + n_b) / (100 + PERCENT))
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (F.least(n_a - at_a, n_b - at_b) >= least)


def _near(a: str, b: str) -> Column:
    """Whether the sets can be near enough by what tells them apart for certain.

    A shingle of one document only is in one of the sets. Of the others, each flips a bit of its set's bitmap, so at least
    as many differ as bits do.
    """
    c = lambda name, side: F.col(f"{name}_{side}")
    apart = c("u", a) + c("u", b)
    for i in range(PARITY):
        apart = apart + F.bit_count(c(f"b{i}", a).bitwiseXOR(c(f"b{i}", b)))
    both = c("n", a) + c("n", b)
    return apart <= both - 2 * F.ceil(PERCENT * both / (100 + PERCENT))


def link_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``_id`` (see ``common.node``), ``_n_shingles`` and ``_component`` of every row."""
    size = text_size(docs, text)
    bits = arrays.bucket_bits(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size)
    rows = docs.select(node(F.col(doc_id), F.col(text)).alias("id"), F.col(text).alias("text"))
    sent = rows.mapInArrow(_send(bits), _SENT).groupBy("bucket").applyInArrow(_share, _SENT)
    sent = stage(sent, "join-shared", size)

    about = sent.filter("ids is not null").select("bundle", F.posexplode(F.arrays_zip("ids", "sizes", "one", "two")))
    about = stage(about.select("bundle", F.col("pos").alias("at"), "col.*"), "join-about", size)
    sets = stage(
        about.filter("sizes > 0")
        .groupBy("sizes", "one", "two")
        .agg(F.min(F.struct("ids", "bundle", "at")).alias("first"))
        .select("sizes", "one", "two", "first.*"),
        "join-sets", size,
    )
    # ids with more than one set: each of their sets is linked by them
    about_set = F.struct("sizes", "one", "two")
    several = about.groupBy("ids").agg(F.min(about_set).alias("least"), F.max(about_set).alias("most")).filter("least <> most")
    own = about.filter("sizes > 0").join(several.select("ids"), "ids", "left_semi").select(F.col("ids").alias("a"), "sizes", "one", "two")
    own = own.join(sets.select("sizes", "one", "two", F.col("ids").alias("b")), ["sizes", "one", "two"]).select("a", "b").distinct()
    own = stage(own, "join-ids", size)
    leads = sets.groupBy("bundle").agg(F.collect_list("at").alias("lead"))
    shared = sent.select("bundle", "bucket", "packed", "size", "ids", "sizes")
    live = (
        shared.unionByName(leads, allowMissingColumns=True).groupBy("bundle").applyInArrow(_prefixes, _LIVE)
    )
    live = stage(live, "join-live", size)
    discard(sent)

    # classes with the same size and prefix, and what their first members share
    groups = live.groupBy("one", "two").agg(
        F.max(F.struct("middle", (-F.col("id")).alias("back"))).alias("best"),
        F.min("n").alias("n"),
        F.min("unique").alias("u"),
        F.min("prefix").alias("prefix"),
    )
    groups = groups.withColumns({"g": -F.col("best.back"), "middle": F.col("best.middle")}).drop("best")
    groups = stage(groups, "join-groups", size)
    bits = [F.col("bits")[i].alias(f"b{i}") for i in range(PARITY)]
    members = live.select("id", "one", "two", "n", F.col("unique").alias("u"), *bits)
    members = members.join(groups.select("one", "two", "g"), ["one", "two"]).drop("one", "two")
    members = stage(members, "join-members", size)
    postings = stage(
        groups.select("g", "n", "u", "middle", F.posexplode("prefix").alias("at", "key")).select(
            "key", "g", "n", "middle", (F.col("u") + F.col("at")).alias("at")
        ),
        "join-postings", size,
    )
    first = postings.groupBy("key").agg(
        F.max(F.struct("middle", (-F.col("g")).alias("back"), "n", "at")).alias("first"), F.count("*").alias("many")
    )
    first = first.filter("many > 1").select("key", -F.col("first.back"), "first.n", "first.at")
    first = first.toDF("key", "a", "n_a", "at_a")
    starred = (
        postings.join(first, "key")
        .filter((F.col("a") != F.col("g")) & _possible(F.col("n_a"), F.col("n"), F.col("at_a"), F.col("at")))
        .select("a", F.col("g").alias("b"))
    )
    inside = members.filter("g != id").select(F.col("g").alias("a"), F.col("id").alias("b"))
    tried = stage(starred.union(inside).distinct(), "join-pairs", size)
    links = stage(_links(tried, live).union(own.filter("a <> b")), "join-links", size)
    found = components(links, size)

    # what is left: groups that share a key, or members of one group, in different components
    placed = members.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    placed = span_of = stage(placed, "join-placed", size)
    span = placed.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    open_keys = (
        postings.join(span, "g")
        .groupBy("key")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
        .filter("least < most")
        .select("key")
    )
    left_over = stage(
        postings.select("key", "g", "at").join(open_keys, "key", "left_semi").join(placed, "g").drop("g"),
        "join-open", size,
    )
    # a key with many members is dealt over salts: a member meets the others of its key in parts, in as many tasks
    crowd = left_over.groupBy("key").count().filter(F.col("count") > CROWD)
    crowd = stage(crowd.select("key", F.ceil(F.col("count") / CROWD).cast("int").alias("parts")), "join-crowds", size)
    placed = left_over.join(crowd, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["key", "part", "parts"]
    a, b = (t.toDF(*[c if c in keys else x if c == "id" else f"{c}_{x}" for c in t.columns]).drop("parts") for t, x in ((dealt, "a"), (every, "b")))
    more = (
        a.join(b, ["key", "part"])
        .filter((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")))
        .filter(_possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b")) & _near("a", "b"))
        .select("a", "b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = stage(more, "join-more", size)
    if not more.isEmpty():
        links = links.union(stage(_links(more, live), "join-links", size))
        found = components(links, size)

    discard(live, groups, members, postings, tried, span_of, crowd, left_over, more, links)
    # the empty texts of an id that has sets, too, are the same node
    empty = own.select("a").distinct().join(found.withColumnRenamed("id", "a"), "a").select(F.col("a").alias("ids"), F.col("component").alias("_of_id"))
    # every row has the component of its set's first row; rows of one id are one node
    sets = sets.join(found.withColumnRenamed("id", "ids"), "ids", "left")
    of_set = sets.select("sizes", "one", "two", F.coalesce("component", "ids").alias("_component"))
    # copies of a set may be many, so its row goes to every salt
    of_set = of_set.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    about = about.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
    placed = about.join(of_set, ["sizes", "one", "two", "salt"], "left").join(checked_broadcast(empty), "ids", "left")
    return placed.select(
        F.col("ids").alias("_id"), F.col("sizes").alias("_n_shingles"), F.coalesce("_component", "_of_id", "ids").alias("_component")
    )
