import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tesserae.functions import labels, urls
from tesserae.operators import metadata, quality, search, summary
from tesserae.sources import sinks, tables


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_has_url_and_flags_are_never_null(spark):
    df = table(spark, "identifier string", (None,), ("",), ("http://x/",))
    assert column(df.select(metadata.has_url(F.col("identifier")).alias("x")), "x") == [False, False, True]


URLS = ["HTTP://h/x", "https://h?x=1/2", "not a url", None, "", "https://a_b.org/x", "https://a.com/x", "https://a.com.au/x", "http://U@Host.org:8/p q"]


def test_domain_and_suffix(spark):
    df = table(spark, "i int, u string", *enumerate(URLS))
    got = df.select("i", urls.domain(F.col("u")).alias("d"), urls.suffix(F.col("u")).alias("s"), urls.host(F.col("u")).alias("h")).orderBy("i").collect()
    assert [r["d"] for r in got] == ["", "https://h?x=1", "", "", "", "https://a_b.org", "https://a.com", "https://a.com.au", "http://U@Host.org:8"]
    assert [r["s"] for r in got] == ["HTTP://h/x", "/2", "not a url", None, "", "/x", "/x", "/x", "/p q"]
    assert [r["h"] for r in got] == ["h", "h", "", "", "", "a_b.org", "a.com", "a.com.au", "host.org"]


def test_split_and_rebuild_are_inverse_and_ids_leave_gaps(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, "plain", "plain2", "plain3", "https://a.com/y"])]
    df = table(spark, "id int, identifier string", *rows)
    prefixes = metadata.url_prefixes(df)
    ids = {r["prefix"]: r["prefix_id"] for r in prefixes.collect()}
    assert 0 not in ids.values() and ids["https://a.com"] == 1  # those without a domain are the most frequent
    split = metadata.split_urls(df, prefixes)
    back = {r["id"]: r["identifier"] for r in metadata.rebuild_urls(split, prefixes).collect()}
    assert back == {i: (u or None) for i, u in rows}
    unknown = table(spark, "url_prefix_id int, identifier_suffix string", (999, "/x"), (None, None))
    assert sorted(column(metadata.rebuild_urls(unknown, prefixes), "identifier"), key=str) == ["/x", None]


def test_thumbnail(spark):
    df = table(spark, "u string", ("http://slow/original/1",), ("http://slow/x",), ("http://other/original/1",), (None,))
    assert column(df.select(urls.thumbnail(F.col("u"), ["slow"]).alias("x")), "x") == ["http://slow/medium/1", "http://slow/x", "http://other/original/1", None]


RULED = [
    ("Animalia", "Chordata", "Aves", None), (None, None, None, None), ("x", "Chordata", "Aves", "K"), ("", None, None, "K"),
    ("Plantae", "2024-01-01", "a", "P"), (None, "true", None, "P"), ("Fungi", "Rosa L.", None, "P"), ("Fungi", "L. Rosa", None, None),
    ("Fungi", "a Wall. b", None, "P"), ("Fungi", "US", None, "P"), ("Fungi", "USA", None, None), ("Fungi", "ok", "2024-x", "C"),
    ("Fungi", None, "an INVALID one", "C"), ("Fungi", None, "MATCHED", "C"), ("Fungi", None, "a var. b", "C"), ("Fungi", None, "a var b.", None),
]


def test_corruption_rules(spark):
    rows = [(i, *r[:3], "keep", "name") for i, r in enumerate(RULED)]
    df = table(spark, "id int, kingdom string, phylum string, class string, source_dataset string, common_name string", *rows)
    rules = metadata.Rules()
    got = {r["id"]: r["rule"] for r in metadata.corrupt_ids(df, rules).collect()}
    assert got == {i: r[3] for i, r in enumerate(RULED) if r[3]}
    columns = ["kingdom", "phylum", "class", "common_name"]
    cleaned = metadata.null_out(df, rules, columns)
    assert sorted(map(str, cleaned.collect())) == sorted(map(str, metadata.null_out_ids(df, metadata.corrupt_ids(df, rules), columns).collect()))
    for r in cleaned.collect():
        assert r["source_dataset"] == "keep" and (r["common_name"] is None) == (r["id"] in got)
    assert quality.corrupted_are_null(cleaned, metadata.corrupt_ids(df, rules), columns).first()["passed"]
    assert not quality.corrupted_are_null(df, metadata.corrupt_ids(df, rules), columns).first()["passed"]


HEX = "0123456789abcdef0123456789abcdef"
UUID = "01234567-89ab-cdef-0123-456789abcdef"


def test_training_flag_by_canonical_uuid(spark):
    df = table(spark, "id int, uuid string", (1, HEX.upper()), (2, UUID), (3, "f" * 32), (4, None), (5, "no"))
    catalog = table(spark, "uuid string", (UUID,), (HEX,), (None,))
    got = {r["id"]: r["in_training"] for r in metadata.training_flag(df, catalog).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert not any(column(metadata.training_flag(df, catalog.limit(0)), "in_training"))


def test_narrow_cast_raises(spark):
    df = table(spark, "id long", (2147483647,), (None,))
    assert column(df.select(labels.narrow(F.col("id")).alias("x")), "x") == [2147483647, None]
    with pytest.raises(Exception, match="out of range"):
        table(spark, "id long", (2147483648,)).select(labels.narrow(F.col("id"))).collect()


def test_labels(spark):
    df = table(spark, "s string, c string, d string, i string", ("S", "c", "GBIF", "7"), ("", "c", "gbif", ""), (None, "", None, "7"))
    got = df.select(labels.display_label(F.col("s"), F.col("c")).alias("a"), labels.source_link(F.col("d"), F.col("i"), "u/").alias("b"), labels.lineage([F.col("s"), F.col("d")], F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("S", "u/7", "S GBIF (c)"), ("c", "gbif", "gbif (c)"), ("Unknown", "Unknown", "")]


def test_backfill_takes_the_first_value(spark):
    base = table(spark, "id int, a string, b string", (1, None, "x"), (2, "y", None), (3, None, None))
    one = table(spark, "id int, a string, b string", (1, "r1", "r1"), (2, "r1", None))
    two = table(spark, "id int, a string, b string", (1, "r2", "r2"), (2, "r2", "r2"))
    got = sorted(map(tuple, metadata.backfill(base, [one, two], "id", ["a", "b"]).collect()))
    assert got == [(1, "r1", "x"), (2, "y", "r2"), (3, None, None)]


def test_closed_domain_and_gate(spark):
    df = table(spark, "id int, v string", (1, "a"), (2, "b"), (3, None))
    domain = table(spark, "value string", ("a",), ("a",))
    assert sorted(map(tuple, metadata.closed_domain(df, "v", domain).collect())) == [(1, "a"), (2, None), (3, None)]
    assert column(metadata.domain_violations(df, "v", domain), "v") == ["b"]
    assert [tuple(r) for r in metadata.cardinality_gate(df, {"v": 2, "id": 2}).collect()] == [("v", 2, 2, True), ("id", 3, 2, False)]


def test_scopes(spark):
    rows = [(f, d, p) for f in (True, False, None) for d in ("gbif", "eol", None) for p in ("iNaturalist", "inaturalist", None, "x iNaturalist y")]
    df = table(spark, "has_url boolean, source_dataset string, publisher string", *rows).withColumn("in_training", F.col("has_url"))
    n = lambda scope: df.filter(search.in_scope(scope)).count()
    assert (n("all"), n("whatever"), n("url_only"), n("iNaturalist Only"), n("training")) == (36, 36, 12, 2, 12)


def test_hierarchy_counts_paths_and_rows(spark):
    df = table(spark, "a string, b string", ("x", "1"), ("x", "1"), ("x", None), ("x", ""), (None, "1"))
    got = {(r["a"], r["b"], r["depth"]): (r["leaf_paths"], r["n_rows"]) for r in summary.hierarchy(df, ["a", "b"]).collect()}
    assert got == {(None, None, 0): (3, 5), ("x", None, 1): (2, 4), ("Unknown", None, 1): (1, 1), ("x", "1", 2): (1, 2), ("x", "Unknown", 2): (1, 2), ("Unknown", "1", 2): (1, 1)}


def test_coverage_of_an_empty_table(spark):
    empty = table(spark, "has_url boolean, source_dataset string, publisher string, in_training boolean, kingdom string")
    got = summary.scope_coverage(empty, "p", "d").collect()
    assert {(r["n_rows"], r["percent"]) for r in got} == {(0, None)} and len(got) == 6


def test_reconcile(spark):
    a = table(spark, "id int, x string, y string", (1, "a", "b"), (2, None, "b"), (3, "c", "d"), (4, "e", "f"))
    b = table(spark, "id int, x string, y string", (1, "a", "b"), (2, None, "B"), (4, None, "f"), (5, "z", "z"))
    got = sorted(map(tuple, quality.reconcile(a, b, "id", ["x", "y"]).collect()))
    assert got == [(2, "changed", "y"), (3, "missing", "x,y"), (4, "changed", "x"), (5, "extra", "x,y")]
    allowed = table(spark, "id int", (4,), (2,))
    assert sorted(column(quality.reconcile(a, b, "id", ["x", "y"], allowed), "id")) == [2, 3, 5]


def test_checks(spark):
    df = table(spark, "id int, kingdom string", (1, "a"), (2, None))
    checks = [
        quality.same_count(df, df),
        quality.same_count(df, df.limit(1)),
        quality.expected_count(df, 2),
        quality.in_domain(df, "kingdom", ["b"]),
        quality.flag_counts(df, df, "flag"),
        quality.flag_counts(df.withColumn("flag", F.lit(True)), df, "flag"),
        quality.types_as_declared(df, df.schema, spark),
    ]
    assert [r["passed"] for c in checks for r in c.collect()] == [True, False, True, False, True, False, True, True]
    assert {r["passed"]: r["n_checks"] for r in quality.summary(*checks).collect()} == {True: 5, False: 3}
    assert quality.missing_columns(df, ["id", "x"]) == {"x"}
    assert column(quality.sample(df, "id", 1), "id") == column(quality.sample(df, "id", 1), "id")


def test_sorted_layout_and_lookups(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("string")).alias("source_dataset"))
    sinks.write_sorted(df, f"{tmp_path}/s", ["source_dataset", "id"], 3)
    parts = [sorted(x) for x in spark.read.parquet(f"{tmp_path}/s").rdd.map(tuple).glom().collect() if x]
    assert sum(map(len, parts)) == 500
    got = sinks.sorted_rows(df, ["source_dataset"], 3).collect()
    keys = [r["source_dataset"] for r in got]
    assert keys == sorted(k for k in keys if k is not None) + [None] * keys.count(None)
    sinks.write_lookup(df, f"{tmp_path}/l", "id", ["source_dataset"])
    assert spark.read.parquet(f"{tmp_path}/l").filter("id = 77").count() == 1
    sinks.write_bucketed(df, "bucketed_rows", "id", 4)
    plan = spark.table("bucketed_rows").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    spark.sql("DROP TABLE bucketed_rows")


def test_import_and_optional_tables(spark, tmp_path):
    table(spark, "id int, identifier string", (1, "u"), (2, "")).write.parquet(f"{tmp_path}/t")
    first = tables.import_existing(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, first.collect())) == [(1, "u", True, False), (2, "", False, False)]
    first.withColumn("has_url", F.lit(None).cast("boolean")).write.parquet(f"{tmp_path}/u")
    assert column(tables.import_existing(spark, f"{tmp_path}/u"), "has_url") == [None, None]
    assert tables.optional(spark, f"{tmp_path}/none") is None
    assert tables.optional(spark, f"{tmp_path}/t").count() == 2


def test_import_from_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("cast(id AS int) AS ID", "cast(id * 2 AS string) AS NAME").write.format("jdbc").options(url=url, dbtable="ITEMS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = tables.import_jdbc(spark, url, "ITEMS", "ID", 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100


def test_storage(spark):
    df = table(spark, "a string, b int", ("é", 10), (None, None))
    got = [tuple(r) for r in summary.storage_by_column(df).collect()]
    assert got == [("a", 2, 1), ("b", 2, 1)]
    assert summary.reduction(df, df.select("a")).first() == Row(bytes_before=4, bytes_after=2, percent_saved=50.0)


def test_layout_gate(spark, tmp_path):
    df = spark.range(2000).withColumn("x", F.md5(F.col("id").cast("string")))
    df.orderBy("x").write.parquet(f"{tmp_path}/a")
    sinks.write_lookup(df, f"{tmp_path}/b")
    got = quality.layout_gate(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), [1, 77], runs=2, most=50.0)
    assert got.first()["passed"] and float(got.first()["observed"]) > 0
