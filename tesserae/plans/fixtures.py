"""The given tables in the roles of the data model: metadata, corpus, queries, fetch log, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.urls import host
from tesserae.operators.metadata import has_url, membership_flag

#: Every hundredth vector is a query, searched against all vectors.
QUERY_STRIDE = 100
PUBLISHER, DATASET = "src1", "en"
THROTTLED_HOSTS = ["ththan.example.net", "www.ththes.example.net", "blog.ththon.example.net", "tionsh.example.net"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return as_queries(corpus(spark, folder))


def as_queries(vectors: DataFrame) -> DataFrame:
    rows = vectors.filter(F.col("vec_id") % QUERY_STRIDE == 0)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """id, uuid, kingdom, genus, source_dataset, publisher, identifier, has_url, in_training."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("identifier"))
    trained = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    bare = F.md5(F.col("doc_id").cast("string"))
    hyphened = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    flagged = membership_flag(docs.join(pages, "doc_id", "left"), trained, "doc_id", "in_training")
    return flagged.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, hyphened).otherwise(F.upper(bare)).alias("uuid"),
        F.col("lang").alias("kingdom"),
        F.col("source").alias("genus"),
        F.col("lang").alias("source_dataset"),
        F.col("source").alias("publisher"),
        "identifier",
        has_url(F.col("identifier")).alias("has_url"),
        "in_training",
    )


def ranked_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata with phylum and class, and values that the corruption rules know: by source and id."""
    base = metadata(spark, folder)
    phylum = F.when(F.col("id") % 17 == 0, "2024-05-01").when(F.col("id") % 19 == 0, F.concat(F.col("genus"), F.lit(" L."))).otherwise(F.col("genus"))
    class_ = F.when(F.col("id") % 23 == 0, "INVALID rank").when(F.col("id") % 29 == 0, "a var. b").otherwise(F.col("genus"))
    return base.withColumns({"phylum": phylum, "class": class_})


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    return as_fetch_log(table(spark, folder, "events"))


def as_fetch_log(events: DataFrame) -> DataFrame:
    """ts, host, code, error, n_bytes of ``events``: every fourth user's host is throttled."""
    kind = F.col("event_type")
    code = F.when(kind.isin("view", "click"), 200).when(kind == "signup", 429).when(kind == "purchase", 404)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 4 == 0, "slow.example.org").otherwise("open.example.org").alias("host"),
        code.alias("code"),
        F.when(code.isNull(), "timeout").alias("error"),
        (F.col("value") * 1048576).cast("long").alias("n_bytes"),
    )


def hierarchy_rows(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", host(F.col("url")).alias("host"))
