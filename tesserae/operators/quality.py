"""Data-quality checks. Each is one row: check, passed, observed, expected."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "check string, passed boolean, observed string, expected string"


def _row(df: DataFrame, name: str, passed: Column, observed: Column, expected: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("string").alias("observed"),
        expected.cast("string").alias("expected"),
    )


def reconcile(source: DataFrame, output: DataFrame, key: str, columns: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """Rows that differ: key, state (missing, extra, changed) and the columns that changed. Nulls are equal to nulls.

    ``allowed`` (key) names rows whose ``columns`` may have become null.
    """
    a = source.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = output.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    if allowed is not None:
        both = both.join(allowed.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    else:
        both = both.withColumn("_ok", F.lit(None).cast("boolean"))

    def differs(c: str) -> Column:
        excused = F.coalesce(F.col("_ok"), F.lit(False)) & F.col(f"_b_{c}").isNull()
        return ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) & ~excused

    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]))
    state = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size(changed) > 0, "changed")
    )
    return both.select(key, state.alias("state"), F.array_join(changed, ",").alias("columns")).filter("state is not null")


def same_count(source: DataFrame, output: DataFrame, name: str = "row_count") -> DataFrame:
    one = source.agg(F.count("*").alias("a")).join(output.agg(F.count("*").alias("b")))
    return _row(one, name, F.col("a") == F.col("b"), F.col("b"), F.col("a"))


def expected_count(df: DataFrame, expected: int, name: str = "expected_count") -> DataFrame:
    return _row(df.agg(F.count("*").alias("n")), name, F.col("n") == expected, F.col("n"), F.lit(expected))


def none_of(df: DataFrame, violation: Column, name: str) -> DataFrame:
    """Passes if no row meets the condition."""
    return _row(df.agg(F.count_if(violation).alias("n")), name, F.col("n") == 0, F.col("n"), F.lit(0))


def urls_rebuilt(source: DataFrame, rebuilt: DataFrame, key: str, url: str = "identifier") -> DataFrame:
    wrong = reconcile(source.withColumn(url, F.nullif(F.col(url), F.lit(""))), rebuilt, key, [url])
    return _row(wrong.agg(F.count("*").alias("n")), "url_rebuild", F.col("n") == 0, F.col("n"), F.lit(0))


def corrupted_are_null(output: DataFrame, ids: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return none_of(output.join(ids, key, "left_semi"), some, "corrupted_are_null")


def in_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return none_of(df, F.col(column).isNotNull() & ~F.col(column).isin(domain), f"{column}_in_domain")


def flag_counts(source: DataFrame, output: DataFrame, flag: str) -> DataFrame:
    """Counts of the flag on both sides. A source without the column is skipped, with the rows that are left unchecked; an
    output without it fails, if the source has the flag in any row."""
    if flag not in source.columns:
        unchecked = F.concat(F.lit("skipped "), F.col("n").cast("string"))
        return _row(output.agg(F.count("*").alias("n")), f"{flag}_count", F.lit(True), unchecked, F.lit("skipped"))
    if flag not in output.columns:
        return _row(source.agg(F.count_if(flag).alias("n")), f"{flag}_count", F.col("n") == 0, F.lit("missing"), F.col("n"))
    both = source.agg(F.count_if(flag).alias("a")).join(output.agg(F.count_if(flag).alias("b")))
    return _row(both, f"{flag}_count", F.col("a") == F.col("b"), F.col("b"), F.col("a"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of md5(key, seed): the same ones each time."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def sampled_fields(source: DataFrame, output: DataFrame, key: str, columns: list[str], n: int, allowed: DataFrame | None = None) -> DataFrame:
    """Passes if ``n`` sampled rows have the same ``columns`` in both tables; observed is how many don't."""
    taken = sample(source.select(key, *columns), key, n)
    wrong = reconcile(taken, output.join(taken.select(key), key, "left_semi"), key, columns, allowed)
    return _row(wrong.agg(F.count("*").alias("n")), "sampled_fields", F.col("n") == 0, F.col("n"), F.lit(0))


def sampled_flags(source: DataFrame, output: DataFrame, key: str, flag: str, n: int) -> DataFrame:
    """Passes if ``n`` sampled rows of those with the flag still have it; observed is how many don't."""
    taken = sample(source.filter(flag).select(key), key, n)
    held = taken.join(output.select(key, F.col(flag).alias("_flag")), key, "left")
    lost = held.agg(F.count_if(~F.coalesce("_flag", F.lit(False))).alias("n"))
    return _row(lost, f"sampled_{flag}", F.col("n") == 0, F.col("n"), F.lit(0))


def types_as_declared(df: DataFrame, declared: StructType, spark: SparkSession) -> DataFrame:
    """One row for each declared column."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [
        (f"type_{f.name}", found.get(f.name) == f.dataType.simpleString(), found.get(f.name, "missing"), f.dataType.simpleString())
        for f in declared
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values_fit(df: DataFrame, declared: StructType) -> DataFrame:
    """One row for each declared column that the table has: observed is how many values its type can't hold. One pass."""
    own = [f for f in declared if f.name in df.columns]
    lost = [F.count_if(F.col(f.name).isNotNull() & ~F.col(f.name).eqNullSafe(F.col(f.name).try_cast(f.dataType))).alias(f"n{i}") for i, f in enumerate(own)]
    rows = F.explode(F.array(*[F.struct(F.lit(f"values_{f.name}").alias("name"), F.col(f"n{i}").alias("n")) for i, f in enumerate(own)]))
    counted = df.agg(*lost).select(rows.alias("x")).select("x.*")
    return counted.select(F.col("name").alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("observed"), F.lit("0").alias("expected"))


def missing_columns(df: DataFrame, required: list[str]) -> set[str]:
    return set(required) - set(df.columns)


def summary(*checks: DataFrame) -> DataFrame:
    """(passed, n_checks)."""
    return union(*checks).groupBy("passed").agg(F.count("*").alias("n_checks"))


def union(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def mean_seconds(df: DataFrame, runs: int) -> float:
    """Mean time of making every row, after one run to warm up."""
    df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    for _ in range(runs):
        df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / runs


def layout_gate(original: DataFrame, optimised: DataFrame, ids: list[int], key: str = "id", runs: int = 5, most: float = 2.0) -> DataFrame:
    """Lookups of ``ids`` in the optimised layout may take at most ``most`` times those in the original one."""
    ratio = mean_seconds(optimised.filter(F.col(key).isin(ids)), runs) / mean_seconds(original.filter(F.col(key).isin(ids)), runs)
    return original.sparkSession.createDataFrame([("layout_ratio", ratio < most, f"{ratio:.3f}", f"< {most:g}")], SCHEMA)
