"""Small text expressions of the metadata: identifiers, labels, links, lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_uuid(value: Column) -> Column:
    """Lower case with hyphens, from either form; null if it isn't 32 hex digits."""
    bare = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    made = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), made)


def filled(value: Column) -> Column:
    """Null for ''."""
    return F.nullif(value, F.lit(""))


def display_label(species: Column, common_name: Column) -> Column:
    return F.coalesce(filled(species), filled(common_name), F.lit("Unknown"))


def source_link(dataset: Column, source_id: Column, base: str) -> Column:
    """The occurrence's address for that dataset whose records have one, else the dataset's name."""
    linked = (F.lower(dataset) == "gbif") & filled(source_id).isNotNull()
    return F.when(linked, F.concat(F.lit(base), source_id)).otherwise(F.coalesce(filled(dataset), F.lit("Unknown")))


def lineage(ranks: list[Column], common_name: Column | None = None) -> Column:
    """The ranks that are filled, joined by blanks, and the common name in parentheses."""
    parts = [filled(r) for r in ranks]
    if common_name is not None:
        parts.append(F.when(filled(common_name).isNotNull(), F.concat(F.lit("("), common_name, F.lit(")"))))
    return F.concat_ws(" ", *parts)


def narrow(value: Column) -> Column:
    """BIGINT to INT; a value out of range is an error, not a wrap."""
    return F.when(value.between(-(2**31), 2**31 - 1) | value.isNull(), value.try_cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("id out of range of INT: "), value.cast("string")))
    )


def error_text(message: Column, most: int = 80) -> Column:
    return F.left(message, F.lit(most))


def mapped(value: Column, names: dict[str, str], default: str) -> Column:
    """The name of a value, or the default: a map that is part of the expression."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))
