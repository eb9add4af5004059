import os

import helpers
from pyspark.sql import functions as F

from tesserae.llm import common


def folder(df):
    return df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")


def test_staged_tables_are_removed_and_others_stay(spark, tmp_path):
    one, two = common.stage(spark.range(5), "test"), common.stage(spark.range(7), "test", 10)
    spark.range(3).write.parquet(f"{tmp_path}/kept")
    own = spark.read.parquet(f"file://{tmp_path}/kept")
    paths = [folder(one), folder(two)]
    assert all(map(os.path.isdir, paths)) and one.count() + two.count() == 12
    common.discard(one.union(two), own)
    assert not any(map(os.path.isdir, paths)) and own.count() == 3


def test_small_inputs_make_few_files(spark):
    wide = spark.range(1000, numPartitions=100)
    assert len(common.stage(wide, "test", 1000).inputFiles()) <= common.files(spark, 1000) == common.WAVES * 4
    assert common.files(spark, 10**14) == -(-(10**14) // common.FILE)


def test_settings_are_lowered_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for now, then in (("10000", common.SENT), ("0", common.SENT), ("500", 500)):
            spark.conf.set(key, now)
            common.tuned(spark)
            assert int(spark.conf.get(key)) == then
    finally:
        spark.conf.set(key, before)


def test_shield_restores_names_and_replaces_new_ones(spark):
    docs = helpers.documents(spark, [(1, "a b")]).selectExpr("*", "1 as c0", "2 as _new", "3 as `a.b`")
    inside, name, back = common.shield(docs)
    assert inside.columns == [f"c{i}" for i in range(8)] and name("a.b") == "c7"
    out = back(inside.withColumn("_new", F.lit(9)), F.lit(8).alias("last"), new=["_new"])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "a.b", "_new", "last"]
    assert tuple(out.first())[5:] == (1, 3, 9, 8)
