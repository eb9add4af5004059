"""Prefix trie of conversations, by the recursion of van Emde Boas.

A turn is named by its role and text, a prefix by the name of the one before it and the turn: 128 bits each, so at n distinct
ones about n^2 / 2^129 pairs collide. A conversation is a string of turns, 20 bytes each (the name, and the number of the text's
code points); the texts themselves travel nowhere.

Down: all strings are cut at half the depth of the trie. The upper parts make one trie; a lower part belongs to the forest
named by the prefix that was cut off. Both are rows of one table: equal strings of a forest become one row, which adds up
the conversations, and in the next step all of them are cut at half their depth again, until each row is a node. So a trie
of depth D takes log2(D) steps, each of one exchange with sums on the map side; a group of copies is one row after the first.

Up: a node's totals start with its own. In the step for blocks of s turns, the totals of the trees that hang below a cut prefix
are added up and grafted to each node above it in the upper block, of which there are s: the cut strings give the pairs,
about half the turns of the distinct strings in each step. After log2(D) steps each node has the totals of its subtree.

The conversations that end at a node are told by a hash of all their ids in order, which only one pass in order can make.
They are sorted in ranges of (node, id), so those of one node may be dealt over many tasks; a task writes its ids as text,
``CHUNK`` bytes a row, and only those rows meet at the node's task, which streams through them and holds one at a time.

Skew: nothing is gathered by node but these rows. A donor's first turns go to the at most 199 conversations that share it. The
join that gives each node its parent's first member has a hot key where a node has many children; it is a left
sort-merge join without anything above it, whose large partitions adaptive execution splits.

Null role and text are empty ones, null turns come first. Turns with an equal number stand in the order of their names, so
ties and repeated rows, each a turn of its own, give the same trie in any order of the input. Rows without a conv_id belong to
no conversation and are left out. A very long text counts by its name; a conversation of very many turns is a row of 20 bytes a
turn. An empty table gives an empty result, without a root. Columns of the input other than the four aren't read, so no names
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import arrays
from tesserae.llm.common import discard, stage, text_size, tuned

#: Bytes of a turn in a string (its name and its length), bytes of a name, bytes of ids in a row.
TURN, NAME, CHUNK = 20, 16, 1 << 16
#: Donors are the conversations whose id is a multiple of this; a conversation takes fewer turns from it than ``TAKEN``.
DONORS, TAKEN = 100, 6
ROOT = b""


def turn_name(role: Column, text: Column) -> Column:
    """20 bytes, as 40 hex digits: a name of role and text, and the code points of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(name, F.lpad(F.hex(F.char_length(text)), 8, "0"))


def strings(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, as one string of bytes."""
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).isNotNull().alias("a"), F.col(turn).alias("b"), turn_name(F.col(role), F.col(text)).alias("c")).alias("t")
    )
    path = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["c"]), "")
    return rows.groupBy("conv_id").agg(F.unhex(path).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``strings`` whose first h turns are those of the conversation's donor, the one before it whose id is a multiple of 100.

    h is crc32 of the id modulo ``TAKEN``; a donor with fewer turns gives them all, an absent one none.
    """
    donors = own.filter(F.col("conv_id") % DONORS == 0).select(F.col("conv_id").alias("donor"), F.substring("path", 1, TURN * TAKEN).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).cast("int")
    asked = own.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % DONORS, "h": h * TURN})
    head = F.coalesce(F.col("first").substr(F.lit(1), F.col("h")), F.lit(b""))
    rest = F.col("path").substr(F.col("h") + 1, F.length("path"))
    return asked.join(donors, "donor", "left").select("conv_id", F.concat(head, rest).alias("path"))


def _prefix(name: Column, path: Column, turns: int | Column) -> Column:
    """The name of the prefix that follows on ``name`` by these turns of a string."""
    many = turns if isinstance(turns, Column) else F.lit(turns)
    step = lambda acc, i: F.unhex(F.md5(F.concat(acc, path.substr(i * TURN + 1, F.lit(NAME)))))
    return F.when(many == 0, name).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), name, step))


def halves(rows: DataFrame, turns: int) -> DataFrame:
    """Rows (forest, depth, path, n, least, ended) cut after so many turns, equal ones added up.

    ``forest``: the name of the prefix above, and ``depth`` its turns; ``n``: conversations that have the string; ``least``: the
    smallest id of them; ``ended``: how many of them end with it.
    """
    path, cut = F.col("path"), F.length("path") > turns * TURN
    upper = F.struct("forest", "depth", path.substr(F.lit(1), F.lit(turns * TURN)).alias("path"), "n", "least", F.when(cut, F.lit(0).cast("long")).otherwise(F.col("ended")).alias("ended"))
    lower = F.struct(
        _prefix(F.col("forest"), path, turns).alias("forest"), (F.col("depth") + turns).alias("depth"), path.substr(F.lit(turns * TURN + 1), F.length("path")).alias("path"), "n", "least", "ended"
    )
    parts = rows.select(F.inline(F.when(cut, F.array(upper, lower)).otherwise(F.array(upper))))
    return parts.groupBy("forest", "depth", "path").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ended").alias("ended"))


_TOTALS = "name binary, parent binary, depth int, leaves long, saved long"


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cut, name, parent, depth): of each string (forest, depth, path), the name of the whole and each node on its way."""
    for batch in arrays.returned(batches):
        out: list[tuple[bytes, bytes, bytes, int]] = []
        for forest, depth, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            names = [forest]
            for at in range(0, len(path), TURN):
                names.append(hashlib.md5(names[-1] + path[at : at + NAME]).digest())
            out += [(names[-1], name, parent, depth + i) for i, (parent, name) in enumerate(zip(names, names[1:]), 1)]
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("cut", pa.binary()), ("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (name, conv_id) in order: (name, first, ids), runs of ids as text with a comma after each."""
    name, first, held, size = None, None, [], 0

    def row() -> pa.RecordBatch:
        columns = [pa.array([name], pa.binary()), pa.array([first], pa.int64()), pa.array(["".join(held)], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["name", "first", "ids"])

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (own != name or size > CHUNK):
                yield row()
                held, size = [], 0
            if not held:
                name, first = own, conv
            held.append(f"{conv},")
            size += len(held[-1])
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (name, first, ids) in order: (name, digest) of all ids of a name, without the last comma."""
    name, last, state = None, "", hashlib.sha256()

    def row() -> pa.RecordBatch:
        state.update(last[:-1].encode())
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "digest"])

    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != name:
                if name is not None:
                    yield row()
                name, last, state = own, "", hashlib.sha256()
            state.update(last.encode())
            last = ids
    if name is not None:
        yield row()


def end_digests(paths: DataFrame) -> DataFrame:
    """(name, digest) of each prefix that is a whole conversation: SHA-256 of their ids in order, joined by commas."""
    ends = paths.select(_prefix(F.lit(ROOT), F.col("path"), (F.length("path") / TURN).cast("int")).alias("name"), "conv_id")
    sorted_ = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    chunks = sorted_.mapInArrow(_ids, "name binary, first long, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name binary, digest string")


def trie(paths: DataFrame, size: int | None = None) -> DataFrame:
    """The nodes of the trie of (conv_id, path), which must be a table that can be read again; ``size`` is that of the texts.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    spark = paths.sparkSession
    deepest = paths.agg(F.max(F.length("path"))).first()[0]
    if deepest is None:
        kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], kinds)
    one = F.lit(1).cast("long")
    rows = paths.select(F.lit(ROOT).alias("forest"), F.lit(0).alias("depth"), "path", one.alias("n"), F.col("conv_id").alias("least"), one.alias("ended"))
    turns, levels = 1, []
    while turns * TURN < deepest:
        turns *= 2
    whole = rows.groupBy("forest", "depth", "path").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ended").alias("ended"))
    rows = stage(whole, "trie-strings", size)
    root = rows.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(F.when(F.length("path") == 0, F.col("ended")).otherwise(0)).alias("ended"))
    root = root.select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("chars"), "n", "least", "ended")
    rows = rows.filter(F.length("path") > 0)
    while turns > 1:
        turns //= 2
        rows = stage(halves(rows, turns), f"trie-halves-{turns}", size)
        levels.append((turns, rows))
    name = F.unhex(F.md5(F.concat("forest", F.substring("path", 1, NAME))))
    chars = F.conv(F.hex(F.substring("path", NAME + 1, TURN - NAME)), 16, 10).cast("long")
    nodes = rows.select(name.alias("name"), F.col("forest").alias("parent"), (F.col("depth") + 1).alias("depth"), chars.alias("chars"), "n", "least", "ended")
    nodes = stage(nodes.unionByName(root), "trie-nodes", size)

    leaf = (F.col("n") == F.col("ended")).cast("long")
    totals = nodes.select("name", "parent", "depth", leaf.alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    for turns, cut in reversed(levels):  # blocks of so many turns, each below another one
        beyond = (F.col("depth") % (2 * turns) == 0) & (F.length("path") == turns * TURN) & (F.col("n") > F.col("ended"))
        pairs = cut.filter(beyond).select("forest", "depth", "path").mapInArrow(_above, "cut binary, name binary, parent binary, depth int")
        tops = totals.filter((F.col("depth") - 1) % (2 * turns) == turns)
        below = tops.groupBy(F.col("parent").alias("cut")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        grown = pairs.join(below, "cut").groupBy("name", "parent", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        totals = totals.unionByName(stage(grown, f"trie-totals-{turns}", size))
    discard(*[cut for _, cut in levels])

    no = F.lit(0).cast("long")
    sums = totals.select("name", "leaves", "saved", no.alias("children"))
    sums = sums.union(totals.filter("depth = 1").select(F.lit(ROOT), "leaves", "saved", no))
    sums = sums.union(nodes.filter("depth > 0").select("parent", no, no, one))
    sums = sums.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    none = hashlib.sha256().hexdigest()
    found = nodes.join(sums, "name").join(end_digests(paths), "name", "left").withColumn("digest", F.coalesce("digest", F.lit(none)))
    above = nodes.select(F.col("name").alias("parent"), F.col("least").alias("parent_conv_id"))
    return found.join(above, "parent", "left").select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("digest").alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, rebuild: bool = True, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``trie`` of a table of turns; with ``rebuild``, of the conversations that begin like their donors."""
    tuned(turns.sparkSession)
    size = text_size(turns, text)
    paths = stage(strings(turns, conv_id, turn, role, text), "trie-own", size)
    if rebuild:
        paths = stage(rebuilt(paths), "trie-paths", size)
    return trie(paths, size)
