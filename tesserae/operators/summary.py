"""Aggregates: scope coverage, hierarchy, status and byte summaries, storage by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.labels import filled
from tesserae.operators.search import in_scope


def scope_coverage(metadata: DataFrame, publisher: str, dataset: str, classified: str = "kingdom") -> DataFrame:
    """(scope, n_rows, percent): one pass over the table; percent is null for an empty one."""
    scopes = {
        "all": F.lit(True),
        "url": in_scope("url_only"),
        "no_url": ~in_scope("url_only"),
        "publisher": in_scope("inaturalist", publisher, dataset),
        "training": in_scope("training"),
        "classified": filled(F.col(classified)).isNotNull(),
    }
    counts = metadata.agg(F.count("*").alias("_n"), *[F.count_if(p).alias(s) for s, p in scopes.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).alias("n_rows")) for s in scopes])
    return counts.select("_n", F.inline(rows)).select(
        "scope", "n_rows", F.round(F.try_divide(100.0 * F.col("n_rows"), F.col("_n")), 4).alias("percent")
    )


def hierarchy(df: DataFrame, ranks: list[str]) -> DataFrame:
    """Every node of the tree of ``ranks`` with its distinct leaf paths and its rows; null and '' are ``Unknown``.

    Rows are counted per path first, so the rollup runs over paths, not rows. ``depth`` is the number of ranks given.
    """
    named = df.select(*[F.coalesce(filled(F.col(c)), F.lit("Unknown")).alias(c) for c in ranks])
    paths = named.groupBy(*ranks).agg(F.count("*").alias("_rows"))
    return (
        paths.rollup(*ranks)
        .agg(F.count("*").alias("leaf_paths"), F.sum("_rows").alias("n_rows"), F.grouping_id().alias("_g"))
        .withColumn("depth", (F.lit(len(ranks)) - F.bit_count("_g")).cast("long"))
        .drop("_g")
    )


def children(df: DataFrame, parent: list[str], rank: str) -> DataFrame:
    """(parents, ``rank``, n_rows, position): what stands below each parent, the largest first, then by name."""
    named = df.select(*[F.coalesce(filled(F.col(c)), F.lit("Unknown")).alias(c) for c in [*parent, rank]])
    counted = named.groupBy(*parent, rank).agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy(*parent).orderBy(F.desc("n_rows"), rank)
    return counted.withColumn("position", F.row_number().over(order).cast("long"))


def tree(df: DataFrame, ranks: list[str]) -> DataFrame:
    """(``ranks``, depth, leaf_paths, line) of every node below the root: a drawn tree, siblings in the order of code points.

    ``line`` is the node's line, with the number of leaf paths below it; lines stand in the order of ``ranks``, where the ranks
    below a node are null and come first. Null and '' are ``Unknown``. Whether a node is its parent's last child is one maximum
    for each parent, so siblings aren't ranked in one task.
    """
    nodes = hierarchy(df, ranks).filter("depth > 0").drop("n_rows")
    for d, rank in enumerate(ranks, 1):
        top = nodes.filter(F.col("depth") == d).groupBy(*ranks[: d - 1]).agg(F.max(rank).alias("_last"))
        # above the first rank there is one parent, whose maximum is a row
        nodes = nodes.join(top, ranks[: d - 1], "left") if d > 1 else nodes.join(F.broadcast(top))
        nodes = nodes.withColumn(f"_last{d}", F.col(rank) == F.col("_last")).drop("_last")
    stem = F.concat(*[F.when(F.col("depth") <= d, "").when(F.col(f"_last{d}"), "    ").otherwise("│   ") for d in range(1, len(ranks) + 1)])
    fork = F.when(F.coalesce(*[F.when(F.col("depth") == d, F.col(f"_last{d}")) for d in range(1, len(ranks) + 1)]), "└── ").otherwise("├── ")
    name = F.coalesce(*[F.when(F.col("depth") == d, F.col(rank)) for d, rank in enumerate(ranks, 1)])
    line = F.concat(stem, fork, name, F.lit(" ("), F.col("leaf_paths").cast("string"), F.lit(")"))
    return nodes.select(*ranks, "depth", "leaf_paths", line.alias("line"))


def status_summary(outcomes: DataFrame, status: str = "image_status") -> DataFrame:
    ok, no_url = F.col(status) == "ok", F.col(status) == "no_url"
    return outcomes.agg(
        F.count_if(ok).alias("n_ok"), F.count_if(no_url).alias("n_no_url"), F.count_if(~ok & ~no_url).alias("n_failed")
    )


def bytes_by_host(outcomes: DataFrame, limit: int | None = None, throttled: list[str] = ()) -> DataFrame:
    """(host, n_bytes, over): ``over`` marks throttled hosts above the limit."""
    summed = outcomes.groupBy("host").agg(F.sum("n_bytes").alias("n_bytes"))
    over = F.col("host").isin(list(throttled)) & (F.col("n_bytes") > limit) if limit is not None else F.lit(False)
    return summed.withColumn("over", over)


def storage_by_column(df: DataFrame) -> DataFrame:
    """(column, n_bytes, n_null): bytes of the values of each column, as text for those of other types."""
    def size(name: str, kind: str):
        c = F.col(f"`{name}`")
        return F.octet_length(c if kind in ("string", "binary") else c.cast("string")).cast("long")

    plain = [(n, k) for n, k in df.dtypes if not k.startswith(("array", "map", "struct"))]
    one = df.agg(
        *[F.coalesce(F.sum(size(n, k)), F.lit(0)).alias(f"b{i}") for i, (n, k) in enumerate(plain)],
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, (n, _) in enumerate(plain)],
    )
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"b{i}").alias("n_bytes"), F.col(f"n{i}").alias("n_null")) for i, (n, _) in enumerate(plain)]
    return one.select(F.inline(F.array(*rows)))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, n_bytes) of a table's files, by their listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return listed.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bytes of both tables and the percent saved."""
    total = lambda df, name: storage_by_column(df).agg(F.sum("n_bytes").alias(name))
    both = total(before, "bytes_before").join(total(after, "bytes_after"))
    saved = 100.0 * (1 - F.try_divide(F.col("bytes_after"), F.col("bytes_before")))
    return both.withColumn("percent_saved", F.round(saved, 4))
