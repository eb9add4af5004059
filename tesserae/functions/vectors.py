"""Vector expressions: normalisation, distances and the dimension guard, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalise(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2, negative inner product, or one minus the cosine. Smaller is nearer for each of them."""
    if metric == "l2":
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return _sum(F.transform(gap, lambda x: x * x))
    if metric == "ip":
        return -dot(a, b)
    if metric == "cosine":
        sizes = norm(a) * norm(b)
        return 1 - F.when(sizes > 0, dot(a, b) / sizes).otherwise(0.0)
    raise ValueError(f"unknown metric {metric!r}")


def guarded(v: Column, dim: int) -> Column:
    """The vector itself, or an error if its dimension differs: ``zip_with`` would fill a shorter one with nulls."""
    return F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector of dimension {dim} expected, got "), F.size(v).cast("string")))
    )
