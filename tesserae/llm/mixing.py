"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r in [0, 3]. Among all rates that meet a source's token constraint, the chosen ones are
closest to 1 in (bounded) relative entropy. The dual of that problem is convex with one multiplier a source, and its
solution tilts the rates exponentially in the document's size x: r = 3 / (1 + 2 exp(-m x)). Newton's method finds m;
each iteration is one grouped aggregation over the counts of (source, size), and a bracket guards the steps. Sums are of
decimals, so their order doesn't matter and reruns agree to the last bit. A source that misses its target by more than
``TOLERANCE`` after ``ITERATIONS`` steps is an error.

Rates become copies by systematic rounding: documents of a source stand in order of falling size, and a document's
copies are what the rounded running sum of the rates grows by. The source's words then miss its target by half its
longest document at most, whatever the number of documents. The running sum is formed over a source's sizes, then over
the ``SALTS`` strata of a size, so neither a hot source nor a large group of equal sizes is ranked in one task.

Null sources form one source of their own, the last. Null texts have size 0 and are never taken; very long ones count
like all others. Repeated rows count as often as they occur; equal sizes stand in the order of a hash of their id, so ties
give each the same rate and the copies to some of them. An empty table gives an empty result. Columns of the input that
are named like those that are added are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import discard, shield, stage, word_count
from tesserae.operators.numbering import contiguous_ids

MOST = 3
SALTS = 64
ITERATIONS = 100
TOLERANCE = 1e-6
_KEYS = ["_source", "_size", "_salt"]


def _exact(value: Column) -> Column:
    """The sum of ``value`` in millionths, the same in any order."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def source_targets(strata: DataFrame) -> DataFrame:
    """One row a source: ``source_size``, ``mean_size`` and ``target``.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share all words; what exceeds ``MOST`` times
    a source's words is shared again by weight. The words that a unit of weight gets rise from round to round, until no
    other source reaches its limit; each round is one aggregation over the sources.
    """
    sizes = strata.groupBy("_source").agg(
        F.sum(F.col("_size") * F.col("_count")).alias("source_size"), F.sum("_count").alias("_docs")
    )
    weighed = stage(
        contiguous_ids(sizes, ["_source"], "_at").withColumns(
            {"_weight": (1 + F.col("_at") % 3).cast("double"), "_limit": F.lit(float(MOST)) * F.col("source_size")}
        ),
        "mix-weights",
    )
    level, full = 0.0, F.lit(False)
    while True:
        x = weighed.agg(
            F.sum("source_size").alias("all"), _exact(F.when(full, F.col("_limit"))).alias("fixed"), F.sum(F.when(~full, F.col("_weight"))).alias("free")
        ).first()
        if not x["free"] or (following := (x["all"] - (x["fixed"] or 0.0)) / x["free"]) <= level:
            break
        level = following
        full = F.col("_limit") <= F.lit(level) * F.col("_weight")
    return weighed.select(
        "_source",
        "source_size",
        F.greatest(F.lit(1.0), F.col("source_size") / F.col("_docs")).alias("mean_size"),
        F.when(full, F.col("_limit")).otherwise(F.lit(level) * F.col("_weight")).alias("target"),
        full.alias("full"),
    )


def _rate(multiplier, size, mean):
    return MOST / (1 + (MOST - 1) * F.exp(-multiplier * size / mean))


def balance(strata: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the multiplier of each that meets its target."""
    counts = stage(strata.groupBy("_source", "_size").agg(F.sum("_count").alias("_count")), "mix-sizes")
    at = sources.select(
        "*", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")
    )
    for _ in range(ITERATIONS):
        rate = _rate(F.col("m"), F.col("_size"), F.col("mean_size"))
        now = (
            counts.join(at.filter("not full").select("_source", "m", "mean_size"), "_source")
            .groupBy("_source")
            .agg(
                _exact(F.col("_count") * F.col("_size") * rate).alias("_words"),
                _exact(
                    F.col("_count") * F.col("_size") * F.col("_size") / F.col("mean_size") * rate * (1 - rate / MOST)
                ).alias("_slope"),
            )
        )
        miss = F.coalesce(F.col("_words") - F.col("target"), F.lit(0.0))
        step = F.col("m") - F.try_divide(miss, F.col("_slope"))
        wide = F.when(miss > 0, F.col("m") - 2 * F.abs("m") - 1).otherwise(F.col("m") + 2 * F.abs("m") + 1)
        lo = F.when(miss < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("m")).otherwise(F.col("hi"))
        done = F.abs(miss) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target"))
        inside = step.isNotNull() & (F.coalesce(step > lo, step >= wide)) & (F.coalesce(step < hi, step <= wide))
        between = F.coalesce((lo + hi) / 2, wide)
        before = at
        at = stage(
            at.join(now, "_source", "left")
            .withColumn("done", done)
            .withColumn("_next", F.when(done, F.col("m")).when(inside, step).otherwise(between))
            .withColumns({"lo": lo, "hi": hi})
            .withColumn("m", F.col("_next"))
            .drop("_next", "_words", "_slope"),
            "mix-step",
        )
        discard(before)
        if at.filter("not done").isEmpty():
            discard(counts)
            return at.drop("lo", "hi", "done")
        at = at.drop("done")
    raise RuntimeError(f"a source misses its target after {ITERATIONS} Newton steps")


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``_size`` (words), ``_source_size``, ``_target``, ``_rate`` and ``_copies`` (0 to 3).

    A table without the column ``text`` must have the sizes, as ``_size``.
    """
    inside, name, back = shield(docs)
    doc_id = name(doc_id)
    sized = inside.withColumns(
        {
            # 's' before each name and 't' for null: the order of code points, with null last
            "_source": F.coalesce(F.concat(F.lit("s"), F.col(name(source))), F.lit("t")),
            "_size": word_count(F.col(name(text))) if text in docs.columns else F.col(name("_size")),
            "_salt": F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int"),
        }
    )
    strata = stage(sized.groupBy(*_KEYS).agg(F.count("*").alias("_count")), "mix-strata")
    sources = stage(source_targets(strata), "mix-sources")
    solved = balance(strata, sources)
    rate = F.when(F.col("full"), F.lit(float(MOST))).otherwise(_rate(F.col("m"), F.col("_size"), F.col("mean_size")))
    longer = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = strata.groupBy("_source", "_size").agg(F.sum("_count").alias("_all")).join(solved, "_source")
    sizes = sizes.withColumn("_rate", rate).select(
        "_source",
        "_size",
        "_rate",
        F.coalesce(F.sum(F.col("_rate") * F.col("_all")).over(longer), F.lit(0.0)).alias("_longer"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    lower = Window.partitionBy("_source", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.coalesce(F.sum("_count").over(lower), F.lit(0))
    placed = strata.withColumn("_nth", nth).join(sizes, ["_source", "_size"])
    placed = placed.withColumn("_before", F.col("_longer") + F.col("_rate") * F.col("_nth")).drop("_longer", "_nth", "_count")
    rank = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id)))
    upto = lambda k: F.floor(F.col("_before") + F.col("_rate") * k + 0.5)
    copies = F.when(F.col("_size") == 0, 0).otherwise(upto(F.col("_rank")) - upto(F.col("_rank") - 1))
    mixed = sized.withColumn("_rank", rank).join(placed, _KEYS).withColumn("_copies", F.least(F.lit(MOST), copies).cast("int"))
    return back(mixed, new=["_size", "_source_size", "_target", "_rate", "_copies"])
