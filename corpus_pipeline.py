"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

1. language_id: documents in no language that the profiles know go: those without a letter, and those whose likeness to
   the nearest language is below ``SHARE`` of what nearly all labelled texts of that language reach. Where nothing is
   labelled, only those without a letter go.
2. jaccard_join: of each group of linked documents, the one with the smallest id stays; so does one of equal rows.
3. substring_dedup: words of passages that stand earlier too are cut out; a document that loses all its words goes.
4. decontamination: documents that hold a benchmark item go.
5. mixing: every document gets 0 to 3 copies, one row each (``copy`` counts from 1), so that sources meet their weights.

All but the last return the columns of their input. Columns that the stages don't know are carried, whatever their names.
Rows that share a doc_id, or have none, are told apart by their text. Empty tables give empty ones at every stage. Very
long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, jaccard_join, langid, mixing, substring_dedup
from tesserae.llm.common import NO_ID, shield, stage

#: A language's limit: this share of the likeness that all but one in a thousand of its labelled texts reach.
SHARE, QUANTILE = 0.5, 0.001


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inside, name, back = shield(docs)
    languages, bundles = langid.prototypes(inside, name("lang"), name("text"))
    if not languages:
        return back(inside.filter(F.coalesce(F.rlike(name("text"), F.lit("\\p{L}")), F.lit(False))))
    known = langid.predict(inside.filter(F.col(name("lang")).isNotNull()), languages, bundles, name("text"), name("lang"))
    labelled = known.filter((F.col("_lang") == F.col(name("lang"))) & (F.col("_score") > 0))
    # scores are rounded to thousandths for this, so a task sends a few hundred values a language
    limit = F.percentile(F.round("_score", 3), QUANTILE) * SHARE
    limits = labelled.groupBy("_lang").agg(limit.alias("_limit"))  # a row a language, of which there are a bounded number
    found = langid.predict(inside, languages, bundles, name("text"), *inside.columns)
    held = found.join(F.broadcast(limits), "_lang", "left")
    return back(held.filter((F.col("_lang") != "und") & (F.col("_score") >= F.coalesce("_limit", F.lit(0.0)))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inside, name, back = shield(docs)
    text = name("text")
    keyed = substring_dedup.documents(inside, text, name("doc_id"))
    # rows that share an id, but not their text, are different documents
    own = F.lit(NO_ID) + F.pmod(F.xxhash64("_doc", text), F.lit(NO_ID >> 1))
    keyed = keyed.withColumn("_node", F.when(F.col("_part") == 0, F.col("_doc")).otherwise(own))
    linked = jaccard_join.link_components(keyed, text, "_node").select(F.col("_id").alias("_node"), "_component").distinct()
    placed = linked.join(keyed.select("_node", "_doc").distinct(), "_node")
    first = placed.groupBy("_component").agg(F.min(F.struct("_doc", "_node"))["_node"].alias("_node")).select("_node")
    copies = Window.partitionBy("_node").orderBy(F.xxhash64(*inside.columns))  # deliveries of one text under one id
    held = keyed.join(first, "_node", "left_semi").withColumn("_nth", F.row_number().over(copies))
    return back(held.filter("_nth = 1"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inside, name, back = shield(docs)
    cut = substring_dedup.kept_words(inside, name("text"), name("doc_id"))
    changed = F.col("_n_removed") > 0
    cut = cut.filter((F.col("_n_words") == 0) | (F.col("_n_removed") < F.col("_n_words")))
    text = F.when(changed, F.col("_kept")).otherwise(F.col(name("text")))
    columns = {name("text"): text}
    if "n_chars" in docs.columns:
        size = F.when(changed, F.length("_kept")).otherwise(F.col(name("n_chars")))
        columns[name("n_chars")] = size.cast(docs.schema["n_chars"].dataType)
    return back(cut.withColumns(columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inside, name, back = shield(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return back(decontaminate.without_leaks(inside, items, name("text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inside, name, back = shield(docs)
    rated = mixing.mix_sources(inside, name("source"), name("text"), name("doc_id"))
    copies = rated.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return back(copies, F.col("_copy").alias("copy"), F.round("_rate", 6).alias("rate"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", decontamination),
    ("mixing", mixed),
]

#: Language ID is not expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
