import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import vectors
from tesserae.operators import fetch, infer, ivf, search
from tesserae.streaming import streams


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[9]
    rows = [(i, [float(x) for x in v[i]], int(i % 4)) for i in range(300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.filter("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def hits(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_exact_search_equals_expressions(corpus, queries, metric, monkeypatch):
    pairs = queries.crossJoin(corpus)
    d = (F.round(vectors.distance(F.col("query_vec"), F.col("embedding"), metric), 6) + 0.0).alias("distance")
    want = hits(search.ranked(pairs.select("query_id", "vec_id", d), 6))
    assert hits(search.top_k(queries, corpus, 6, metric)) == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    assert hits(search.top_k(queries, corpus, 6, metric)) == want


def test_ties_and_small_corpora(spark, corpus, queries):
    one = queries.filter("query_id = 7")
    assert [h[2] for h in hits(search.top_k(one, corpus, 2))] == [7, 9]
    assert search.top_k(queries, corpus.limit(3), 10).count() == 36
    assert search.top_k(queries, corpus.limit(0), 10).count() == 0
    assert search.top_k(queries.limit(0), corpus, 10).count() == 0
    with pytest.raises(Exception, match="have dimension 3"):
        search.top_k(queries.withColumn("query_vec", F.slice("query_vec", 1, 3)), corpus, 2).collect()
    holes = corpus.withColumn("embedding", F.when(F.col("vec_id") != 3, F.col("embedding")))
    assert hits(search.top_k(queries, holes, 4)) == hits(search.top_k(queries, corpus.filter("vec_id <> 3"), 4))
    missing = queries.withColumn("query_vec", F.when(F.col("query_id") != 3, F.col("query_vec")))
    assert search.top_k(missing, corpus, 4).count() == 44
    with pytest.raises(ValueError):
        search.top_k(queries, corpus, 2, "other")


@pytest.mark.parametrize("block", [4096, 2])
def test_thousands_of_equal_distances_go_by_id(spark, monkeypatch, block):
    """Equal vectors, vectors at equal distance, and some that differ by less than what is reported."""
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    order = rng.permutation(6000)
    v = np.zeros((6000, 4))
    v[np.arange(6000), rng.integers(0, 4, 6000)] = rng.choice([-1.0, 1.0], 6000)  # all at distance 1 from the origin
    v[order[:3000]] = [0.5, 0.5, 0.5, 0.5]
    v[order[3000:3500]] += rng.normal(size=(500, 4)) * 1e-9
    rows = [(int(i), v[i].tolist()) for i in order]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = np.array([[0, 0, 0, 0], [0.5, 0.5, 0.5, 0.5], [1, 0, 0, 0.0], [0.3, -0.2, 0.9, 0.1]])
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, query_vec array<double>")
    for k in (5, 40):
        want = []
        for i, q in enumerate(asked):
            d = ((v - q) ** 2).sum(1).round(6)
            want += [(i, r + 1, int(x), float(d[x])) for r, x in enumerate(np.lexsort((np.arange(6000), d))[:k])]
        assert hits(search.top_k(queries, corpus, k)) == want
    cells = spark.createDataFrame([(0, [0.5] * 4), (1, [-0.5] * 4)], "cell int, center array<double>")
    monkeypatch.setattr(ivf, "CELL_PART", 700)
    assert hits(ivf.search_cells(queries, ivf.assign_cells(corpus, cells), cells, 40, 2)) == want


def test_throttled_rows_that_repeat_an_id(spark):
    rows = [(1, "http://slow/a"), (1, "http://slow/b"), (None, "http://slow/c"), (2, "http://fast/x"), (2, "http://fast/x"), (3, None)]
    got = fetch.plan(spark.createDataFrame(rows, "id long, url string"), "url", "id", ["slow"]).collect()
    assert sorted((r["url"] or "", r["start_offset_s"]) for r in got) == [("", 0.0), ("http://fast/x", 0.0), ("http://fast/x", 0.0), ("http://slow/a", 1.0), ("http://slow/b", 2.0), ("http://slow/c", 0.0)]


def test_normalise_and_guard(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "i int, v array<float>")
    assert [r["v"] for r in df.select(vectors.normalise(F.col("v")).alias("v")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    with pytest.raises(Exception, match="dimension 3"):
        df.select(vectors.guarded(F.col("v"), 3)).collect()


@pytest.fixture(scope="module")
def metadata(spark):
    return spark.range(250).select("id", (F.col("id") % 5 == 0).alias("has_url"), F.lit("d").alias("source_dataset"), F.lit("p").alias("publisher"), F.lit(None).cast("boolean").alias("in_training"))


def test_overfetch_then_filter(corpus, queries, metadata):
    plain = hits(search.search(queries, corpus.filter("vec_id < 250"), metadata, 4))
    assert plain == hits(search.top_k(queries, corpus.filter("vec_id < 250"), 4))
    after = search.search(queries, corpus, metadata, 4, 3, search.in_scope("url_only"))
    before = search.search_within(queries, corpus, metadata, 4, search.in_scope("url_only"))
    n = {r[0]: r[1] for r in after.groupBy("query_id").count().collect()}
    assert max(n.values()) <= 4 and sum(n.values()) < 48
    assert before.count() == 48
    assert {x[:3] for x in hits(after)} <= {x[:3] for x in hits(before)}
    assert search.search(queries, corpus, metadata, 4, 3, search.in_scope("training")).count() == 0


def test_empty_slots_and_missing_metadata_drop_out(spark, metadata):
    found = spark.createDataFrame([(1, -1, 0.0, 1), (1, 3, 0.1, 2), (1, 9999, 0.2, 3)], "query_id long, vec_id long, distance double, rank long")
    assert [(r["vec_id"], r["rank"]) for r in search.enrich(found, metadata).collect()] == [(3, 2)]


def test_cells(corpus, queries):
    cells = ivf.train_cells(corpus, 6)
    indexed = ivf.assign_cells(corpus, cells)
    assert indexed.count() == 300 and indexed.select("vec_id").distinct().count() == 300
    assert hits(ivf.search_cells(queries, indexed, cells, 5, 6)) == hits(search.top_k(queries, corpus, 5))
    exact, last = search.top_k(queries, corpus, 5), 0.0
    for nprobe in (1, 3, 6):
        now = ivf.recall(exact, ivf.search_cells(queries, indexed, cells, 5, nprobe), 5).agg(F.avg("recall")).first()[0]
        assert now >= last
        last = now
    assert last == 1.0
    stats = ivf.index_stats(indexed).first()
    assert stats["n_vectors"] == 300 and stats["n_cells"] <= 6
    again = ivf.assign_cells(corpus, ivf.train_cells(corpus, 6))
    assert sorted(map(tuple, again.select("vec_id", "cell").collect())) == sorted(map(tuple, indexed.select("vec_id", "cell").collect()))
    assert "cell" not in corpus.columns


def test_codes(corpus, queries):
    cells = ivf.train_cells(corpus, 4)
    books = ivf.train_codebooks(corpus, 4, 8)
    codes = ivf.encode(ivf.assign_cells(corpus, cells), books)
    assert all(len(r["codes"]) == 4 and all(0 <= c < 8 for c in r["codes"]) for r in codes.collect())
    halves = ivf.merge_shards(codes.filter("vec_id % 2 = 0"), codes.filter("vec_id % 2 = 1"))
    assert hits(ivf.search_codes(queries, codes, cells, books, 5, 4)) == hits(ivf.search_codes(queries, halves, cells, books, 5, 4))
    settled = ivf.search_codes(queries, codes, cells, books, 5, 4, corpus.select("vec_id", "embedding"), 60)
    assert hits(settled) == hits(search.top_k(queries, corpus, 5))
    with pytest.raises(ValueError):
        ivf.train_codebooks(corpus, 3, 4)


def test_samples_and_ids(spark, corpus):
    got = ivf.stratified_sample(corpus, "label", 0.1, 5, "vec_id")
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}
    ids = ivf.contiguous_ids(spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("u")).repartition(7), ["u"]).collect()
    assert [r["new_id"] for r in sorted(ids)] == list(range(1000))


def test_prediction_by_rank(spark, corpus):
    names = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "z")], "cell int, family string")
    items = corpus.filter("vec_id < 5").select(F.col("vec_id").alias("item"), "embedding")
    got = infer.predict_rank(items, corpus, names, "family", 5).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert all(abs(sum(r["score"] for r in got if r["item"] == i) - 1) < 1e-5 for i in range(5))


def test_prediction_with_many_blocks_of_classes(spark, corpus, monkeypatch):
    names = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "z")], "cell int, family string")
    items = corpus.filter("vec_id < 9").select(F.col("vec_id").alias("item"), "embedding")
    want = sorted(map(tuple, infer.predict_rank(items, corpus, names, "family", 5).collect()))
    for name, value in (("CLASS_BLOCK", 1), ("CLASS_BYTES", 64)):  # a class at a time; passes of about two classes
        monkeypatch.setattr(infer, name, value)
        assert sorted(map(tuple, infer.predict_rank(items, corpus, names, "family", 5).collect())) == want


def test_prediction_by_brute_force(spark, corpus):
    """Ties of score go by value; classes without a name take their share of the sum; only k rows an item leave a task."""
    rng = np.random.default_rng(3)
    classes = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    classes += [(30, classes[0][1]), (31, classes[0][1])]
    names = {i: ["é", "b", "Z", None, "a"][i % 5] for i in range(28)} | {0: "tie2", 30: "tie1", 31: None}
    items = [(i, rng.normal(size=4).tolist()) for i in range(20)] + [(20, classes[0][1]), (21, None)]
    want = []
    for i, v in items:
        if v is None:
            continue
        e = [np.exp(10 * np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)) for _, c in classes]
        sums = {}
        for (cell, _), x in zip(classes, e):
            if names.get(cell) is not None:
                sums[names[cell]] = sums.get(names[cell], 0) + x / sum(e)
        best = sorted(((-round(s, 6), n) for n, s in sums.items()), key=lambda x: (x[0], x[1].encode()))[:3]
        want += [(i, n, -s, r) for r, (s, n) in enumerate(best, 1)]
    df = spark.createDataFrame(items, "item long, embedding array<double>")
    scores = infer.rank_scores(df, spark.createDataFrame(classes, "cell int, center array<double>"), spark.createDataFrame(list(names.items()), "cell int, rank_value string"), 3)
    got = sorted(map(tuple, scores.collect()), key=lambda r: (r[0], -r[2], r[1].encode()))
    assert len(got) == 63 and [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tesserae.sources.shared import shared_path

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError):
        shared_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")), "x")


def make_model():
    return lambda texts: np.array([[len(str(t)), 1.0] for t in texts], np.float32)


def test_embeddings_are_reused(spark):
    rows = spark.createDataFrame([("a",), ("bb",), ("a",)], "content string")
    first = infer.embed_new(rows, spark.createDataFrame([], "content_hash string, embedding array<float>"), "content", make_model)
    assert first.count() == 2
    marked = first.withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    again = infer.embed_new(rows.union(spark.createDataFrame([("ccc",)], "content string")), marked, "content", make_model)
    assert sorted(r["embedding"][0] == 9.0 for r in again.collect()) == [False, True, True]


def fake(address):
    if "slow" in address:
        return 429, None, None
    if "time" in address:
        raise TimeoutError
    if "bad" in address:
        raise ValueError("x" * 100)
    return (404, None, None) if "gone" in address else (200, b"abc", None)


def test_fetching(spark):
    names = ["http://ok/1", "http://slow.org/1", "http://slow.org/2", "http://time/", "http://bad/", "http://gone/", None, ""]
    df = spark.createDataFrame(list(enumerate(names)), "id long, u string")
    planned = fetch.plan(df, "u", "id", ["slow.org"], 2.0)
    assert {r["id"]: r["start_offset_s"] for r in planned.collect()} == {0: 0, 1: 0, 2: 0.5, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    got = {r["id"]: (r["image_status"], r["n_bytes"]) for r in fetch.fetch(planned, fake, "u", "id", 3, clock=fetch.Simulated()).collect()}
    assert got == {0: ("ok", 3), 1: ("rate_limited", 0), 2: ("rate_limited", 0), 3: ("timeout", 0), 4: ("error:" + "x" * 80, 0), 5: ("http_404", 0), 6: ("no_url", 0), 7: ("no_url", 0)}
    some = df.withColumn("image", F.when(F.col("id") == 0, F.lit(b"old")))
    filled = {r["id"]: r["image"] for r in fetch.fill_missing(some, lambda a: (200, b"new", None), "u", "id", [], clock=fetch.Simulated()).collect()}
    assert bytes(filled[0]) == b"old" and bytes(filled[1]) == b"new" and filled[6] is None


def test_streams(spark, corpus, queries, metadata, tmp_path):
    queries.coalesce(2).write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    out = f"{tmp_path}/out"
    streams.search_on_arrival(stream, corpus, metadata, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}"), f"{tmp_path}/c", 4).awaitTermination()
    got = spark.read.parquet(out)
    assert hits(got) == hits(search.search(queries, corpus, metadata, 4))
