"""Metadata pipeline: flags, catalogue membership, back-fill, corruption rules, closed domains, URL split."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import urls
from tesserae.functions.labels import canonical_uuid
from tesserae.operators.numbering import contiguous_ids

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]

# The rules of the data, in their own order.
KINGDOMS = [
    "Animalia", "Plantae", "Fungi", "Chromista", "Protozoa", "Bacteria", "Archaea", "Viruses", "Metazoa",
    "Archaeplastida", "incertae sedis",
]
PHYLUM_DATE = "2024-"
PHYLUM_LITERALS = ["true", "false", "US", "bracteatum"]
PHYLUM_CONTAINS = ["Wall.", "Pers.", "Makino", "subsp.", "var.", "Stokes", "Reveal", "E.Wolf"]
PHYLUM_ENDS = [" L."]
CLASS_CONTAINS = ["INVALID", "MATCH"]
CLASS_BOTH = (" var. ", ".")
DOMAIN_LIMITS = {
    "source_dataset": 5, "kingdom": 50, "phylum": 200, "class": 500, "order": 2000, "family": 15000, "publisher": 600,
    "img_type": 20, "basisOfRecord": 15,
}


@dataclass
class Rules:
    """Which values of kingdom, phylum and class mark a row as corrupted."""

    kingdoms: list[str] = field(default_factory=lambda: list(KINGDOMS))
    date: str = PHYLUM_DATE
    literals: list[str] = field(default_factory=lambda: list(PHYLUM_LITERALS))
    contains: list[str] = field(default_factory=lambda: list(PHYLUM_CONTAINS))
    ends: list[str] = field(default_factory=lambda: list(PHYLUM_ENDS))
    class_contains: list[str] = field(default_factory=lambda: list(CLASS_CONTAINS))
    class_both: tuple[str, ...] = CLASS_BOTH

    def rule(self, kingdom: Column, phylum: Column, class_: Column) -> Column:
        """'K', 'P' or 'C', the first rule that holds, or null for a clean row."""

        def any_of(tests: list[Column]) -> Column:
            out = F.lit(False)
            for t in tests:
                out = out | t
            return F.coalesce(out, F.lit(False))

        bad_kingdom = F.coalesce(~kingdom.isin(self.kingdoms), F.lit(False))
        dated = F.coalesce(F.startswith(phylum, F.lit(self.date)), F.lit(False))
        bad_phylum = any_of(
            [dated, phylum.isin(self.literals)]
            + [F.contains(phylum, F.lit(x)) for x in self.contains]
            + [F.endswith(phylum, F.lit(x)) for x in self.ends]
        )
        both = F.lit(True)
        for x in self.class_both:
            both = both & F.contains(class_, F.lit(x))
        bad_class = any_of(
            [F.startswith(class_, F.lit(self.date)), both] + [F.contains(class_, F.lit(x)) for x in self.class_contains]
        )
        return F.when(bad_kingdom, "K").when(bad_phylum, "P").when(bad_class & ~dated, "C")


def derive_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column unless the table has it."""
    return df if name in df.columns else df.withColumn(name, value)


def has_url(identifier: Column) -> Column:
    return F.coalesce(identifier != "", F.lit(False))


def training_flag(df: DataFrame, catalog: DataFrame, uuid: str = "uuid", name: str = "in_training") -> DataFrame:
    """TRUE where the uuid, in canonical form, is in the catalogue; FALSE otherwise, never null."""
    keys = catalog.select(canonical_uuid(F.col(uuid)).alias("_key")).filter("_key is not null").distinct()
    keys = keys.withColumn("_found", F.lit(True))
    joined = df.withColumn("_key", canonical_uuid(F.col(uuid))).join(keys, "_key", "left")
    return joined.withColumn(name, F.coalesce("_found", F.lit(False))).drop("_key", "_found")


def membership_flag(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    keys = members.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_found", F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_found")


def backfill(base: DataFrame, recoveries: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Fill nulls of ``columns`` from the recovery tables, the first that has a value. Their keys must be unique."""
    out = base
    for i, recovery in enumerate(recoveries):
        own = recovery.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in columns])
        out = out.join(own, key, "left")
    filled = {c: F.coalesce(F.col(c), *[F.col(f"_{i}_{c}") for i in range(len(recoveries))]) for c in columns}
    return out.withColumns(filled).select(*base.columns)


def corrupt_ids(df: DataFrame, rules: Rules, id_col: str = "id") -> DataFrame:
    """(id, rule) of corrupted rows."""
    rule = rules.rule(F.col("kingdom"), F.col("phylum"), F.col("class"))
    return df.select(id_col, rule.alias("rule")).filter("rule is not null")


def null_out(df: DataFrame, rules: Rules, columns: list[str]) -> DataFrame:
    """``columns`` become null in corrupted rows; the others stay. No join: the rules are part of the projection."""
    bad = rules.rule(F.col("kingdom"), F.col("phylum"), F.col("class")).isNotNull()
    return df.select(*[F.when(~bad, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def null_out_ids(df: DataFrame, ids: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """The same by a table of ids."""
    marked = df.join(ids.select(id_col).distinct().withColumn("_bad", F.lit(True)), id_col, "left")
    return marked.select(*[F.when(F.col("_bad").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def cardinality_gate(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(column, n_distinct, most, accepted): which columns are closed domains. One pass for all of them."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in limits])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct"), F.lit(most).cast("long").alias("most")) for c, most in limits.items()]
    )
    return counts.select(F.inline(rows)).withColumn("accepted", F.col("n_distinct") <= F.col("most"))


#: Registers of a sketch of distinct values, as a power of two, and how near to its limit an estimate may be: five standard
#: errors of 1.04 / sqrt(2^14).
REGISTERS, MARGIN = 14, 0.041


def domain_sketches(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(``by``, column, sketch) of the distinct values of each column, in one pass; those of several files or days can be merged
    (``merged_sketches``) without reading these again."""
    aggregates = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(c) for c in columns]
    made = df.groupBy(*([by] if by else [])).agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sketch")) for c in columns])
    return made.select(*([by] if by else []), F.inline(rows))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))


def gate_by_sketches(df: DataFrame, limits: dict[str, int], sketches: DataFrame | None = None) -> DataFrame:
    """(column, n_distinct, most, accepted, exact) as ``cardinality_gate``: a column whose estimate is within ``MARGIN`` of its
    limit is counted exactly, the others are decided by the estimate, in one pass that keeps a sketch for each column.

    ``sketches``: (column, sketch) of the same rows, where there are some already; then clear columns aren't read.
    """
    found = sketches if sketches is not None else domain_sketches(df, list(limits))
    estimates = {r["column"]: r["n"] for r in found.select("column", F.hll_sketch_estimate("sketch").alias("n")).collect()}  # a row a column
    near = {c: most for c, most in limits.items() if abs(estimates[c] - most) <= 1 + MARGIN * most}
    clear = [(c, estimates[c], most, estimates[c] <= most, False) for c, most in limits.items() if c not in near]
    out = df.sparkSession.createDataFrame(clear, "column string, n_distinct long, most long, accepted boolean, exact boolean")
    return out.union(cardinality_gate(df, near).withColumn("exact", F.lit(True))) if near else out


def closed_domain(df: DataFrame, column: str, domain: DataFrame, value: str = "value") -> DataFrame:
    """The column's value if the domain has it, else null."""
    allowed = domain.select(F.col(value).alias(column)).distinct().withColumn("_in", F.lit(True))
    return df.join(allowed, column, "left").withColumn(column, F.when(F.col("_in"), F.col(column))).select(*df.columns)


def domain_violations(df: DataFrame, column: str, domain: DataFrame, value: str = "value") -> DataFrame:
    """Values in use that the domain lacks."""
    used = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return used.join(domain.select(F.col(value).alias(column)), column, "left_anti")


def domain_frequency(df: DataFrame, url: str = "identifier") -> DataFrame:
    """(domain, cnt) of urls that aren't null; '' stands for those without a domain."""
    return df.filter(F.col(url).isNotNull()).groupBy(urls.domain(F.col(url)).alias("domain")).agg(F.count("*").alias("cnt"))


def url_prefixes(df: DataFrame, url: str = "identifier") -> DataFrame:
    """(prefix_id, prefix): ids by falling frequency. Urls without a domain take a place in the order, but have no row.

    Domains are numbered by ranges of the order, so a web crawl's millions of them don't meet in one task.
    """
    counted = domain_frequency(df, url).withColumn("_back", -F.col("cnt"))
    placed = contiguous_ids(counted, ["_back", "domain"], "prefix_id")
    return placed.filter("domain <> ''").select("prefix_id", F.col("domain").alias("prefix"))


def split_urls(df: DataFrame, prefixes: DataFrame, url: str = "identifier") -> DataFrame:
    """``url`` becomes ``url_prefix_id`` and ``identifier_suffix``; a url without a known domain is all suffix."""
    keyed = df.withColumn("_domain", urls.domain(F.col(url)))
    joined = keyed.join(prefixes.select(F.col("prefix").alias("_domain"), F.col("prefix_id").alias("url_prefix_id")), "_domain", "left")
    rest = F.when(F.col("url_prefix_id").isNull(), F.col(url)).otherwise(urls.suffix(F.col(url)))
    return joined.withColumn("identifier_suffix", rest).drop("_domain", url)


def rebuild_urls(df: DataFrame, prefixes: DataFrame, name: str = "identifier") -> DataFrame:
    joined = df.join(prefixes.withColumnRenamed("prefix_id", "url_prefix_id"), "url_prefix_id", "left")
    return joined.withColumn(name, urls.rebuild(F.col("prefix"), F.col("identifier_suffix"))).drop("prefix", "url_prefix_id", "identifier_suffix")


def with_identifiers(df: DataFrame, prefixes: DataFrame | None, name: str = "identifier") -> DataFrame:
    """Urls from prefix and suffix; a table of the older layout, without prefixes, has them as they are."""
    if prefixes is not None and "url_prefix_id" in df.columns:
        return rebuild_urls(df, prefixes, name)
    return df.withColumn(name, F.nullif(F.col(name), F.lit("")))


def map_columns(df: DataFrame, renamed: dict[str, str], dropped: list[str]) -> DataFrame:
    """Rename and drop columns; those that are missing are passed over."""
    return df.drop(*dropped).withColumnsRenamed(renamed)


def join_manifest(manifest: DataFrame, catalog: DataFrame, uuid: str = "uuid") -> DataFrame:
    """(id, uuid) of a manifest with the catalogue's columns, by the canonical form of the uuid on both sides."""
    key = canonical_uuid(F.col(uuid))
    left = manifest.withColumn(uuid, key).filter(F.col(uuid).isNotNull())
    return left.join(catalog.withColumn(uuid, key), uuid)


def join_stored(manifest: DataFrame, table: str, uuid: str = "uuid") -> DataFrame:
    """``join_manifest`` with a catalogue that ``sinks.write_bucketed`` made by its canonical uuid: only the manifest is
    shuffled, to the catalogue's buckets."""
    left = manifest.withColumn(uuid, canonical_uuid(F.col(uuid))).filter(F.col(uuid).isNotNull())
    return left.join(manifest.sparkSession.table(table).hint("merge"), uuid)


def rebuilt_only(df: DataFrame, prefixes: DataFrame, id_col: str, name: str = "identifier") -> DataFrame:
    """Only rows with a known prefix and a suffix, with their url."""
    known = prefixes.withColumnRenamed("prefix_id", "url_prefix_id")
    joined = df.filter(F.col("identifier_suffix").isNotNull()).join(known, "url_prefix_id")
    return joined.select(id_col, urls.rebuild(F.col("prefix"), F.col("identifier_suffix")).alias(name))
