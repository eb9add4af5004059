"""Stores by bucket, joined in place, and sketches of distinct values."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators import infer, metadata
from tesserae.sources import sinks


def make_model():
    return lambda texts: np.array([[len(str(t)), 1.0] for t in texts], np.float32)


def shuffled_beside(df, table):
    """The plan's scans of a table's files, and whether an exchange stands between each and its join."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.partition("Final Plan ==")[2].partition("Initial Plan ==")[0] or plan
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth, above = re.search(r"\w", line).start(), []
            for up in reversed(lines[:i]):
                at = re.search(r"[\w*]", up)
                if at and at.start() < depth:
                    depth = at.start()
                    above.append(up)
                    if "Join" in up:
                        break
            out.append(any("Exchange" in x or "ShuffleQueryStage" in x for x in above))
    return out


def test_embeddings_are_added_to_a_store_in_place(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)] + [(500, None)], "id int, content string")
    store = rows.filter("id < 20").select(F.md5(F.col("content").cast("binary")).alias("content_hash")).withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    sinks.write_bucketed(store, "own_store", "content_hash", 4, f"file://{tmp_path}/own_store")
    got = infer.embed_into(rows.filter("id < 30 or id = 500"), "own_store", "content", make_model)
    assert got.count() == 30 and spark.table("own_store").count() == 30
    assert shuffled_beside(got, "own_store") == [False]
    again = infer.embed_into(rows, "own_store", "content", make_model)
    assert again.count() == 40 == again.select("content_hash").distinct().count()
    assert sum(r["embedding"][0] == 9.0 for r in again.collect()) == 20
    infer.embed_into(rows, "own_store", "content", make_model)
    assert spark.table("own_store").count() == 40
    with pytest.raises(ValueError, match="no buckets"):
        rows.write.mode("overwrite").option("path", f"file://{tmp_path}/plain").saveAsTable("plain_store")
        infer.embed_into(rows, "plain_store", "content", make_model)


def test_a_manifest_meets_a_stored_catalogue(spark, tmp_path):
    bare = F.md5(F.col("id").cast("string"))
    manifest = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.upper(bare)).otherwise(labels.canonical_uuid(bare)).alias("uuid"))
    catalog = spark.range(50, 150).select(bare.alias("uuid"), (F.col("id") * 2).alias("x"))
    sinks.write_bucketed(catalog.withColumn("uuid", labels.canonical_uuid(F.col("uuid"))), "own_catalogue", "uuid", 4, f"file://{tmp_path}/own_catalogue")
    found = metadata.join_stored(manifest, "own_catalogue")
    want = metadata.join_manifest(manifest, catalog)
    assert sorted(map(tuple, found.select("id", "uuid", "x").collect())) == sorted(map(tuple, want.select("id", "uuid", "x").collect()))
    assert found.count() == 50 and shuffled_beside(found, "own_catalogue") == [False]


def test_gate_by_sketches(spark):
    """Clear columns are not counted; those near their limit are; nulls are no value; sketches of parts can be merged."""
    df = spark.range(5000).select("id", (F.col("id") % 100).alias("hundred"), (F.col("id") % 3).cast("string").alias("three"), F.lit(None).cast("string").alias("none"), (F.col("id") % 7).alias("part"))
    limits = {"id": 1000, "hundred": 100, "three": 10, "none": 5}
    got = {r["column"]: r for r in metadata.gate_by_sketches(df, limits).collect()}
    assert {c: r["accepted"] for c, r in got.items()} == {"id": False, "hundred": True, "three": True, "none": True}
    assert {c: r["exact"] for c, r in got.items()} == {"id": False, "hundred": True, "three": False, "none": False}
    assert got["hundred"]["n_distinct"] == 100 and abs(got["id"]["n_distinct"] - 5000) < 250
    assert "Expand" not in metadata.domain_sketches(df, list(limits))._jdf.queryExecution().toString()
    merged = metadata.merged_sketches(metadata.domain_sketches(df, list(limits), "part"))
    again = metadata.gate_by_sketches(df, limits, merged)
    assert {r["column"]: r["accepted"] for r in again.collect()} == {c: r["accepted"] for c, r in got.items()}
    assert metadata.gate_by_sketches(df.limit(0), limits).filter("accepted").count() == 4
