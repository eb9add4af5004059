"""The stored index: commits, pruning, searches by vectors and codes, two levels of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import index, ivf, search

VECTORS = "vec_id long, embedding array<double>"


def table(spark, v, name="vec_id", vector="embedding"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{name} long, {vector} array<double>")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.collect())


def files(df):
    """How many files of a batch's data the executed plan has read."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec" and "/data/batch=" in node.relation().location().rootPaths().head().toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture(scope="module")
def v():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8)) * 4
    return centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))


@pytest.fixture(scope="module")
def corpus(spark, v):
    return table(spark, v).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark, v):
    return table(spark, v[::90] + 0.05, "query_id", "query_vec").cache()


@pytest.fixture(scope="module")
def path(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    index.create(path, ivf.train_cells(corpus, 24), None, ivf.train_codebooks(corpus, 4, 16), 12)
    assert [index.append(path, n, corpus.filter(f"vec_id % 3 = {i}"), 2) for i, n in ((0, "a"), (1, "b/../ß"), (2, "c"), (1, "b/../ß"))] == [True, True, True, False]
    return path


def test_all_cells_give_the_exact_hits(path, corpus, queries):
    assert hits(index.search(path, queries, 10, 24)) == hits(search.top_k(queries, corpus, 10))
    assert index.sizes(corpus.sparkSession, path).agg(F.sum("n")).first()[0] == 1800


def test_recall_with_few_cells(path, corpus, queries):
    exact = search.top_k(queries, corpus, 10)
    for codes, shortlist in ((False, 0), (True, 8)):
        found = index.search(path, queries, 10, 6, codes, shortlist)
        assert ivf.recall(exact, found, 10).agg(F.avg("recall")).first()[0] >= 0.95
    assert index.search(path, queries, 10, 6).groupBy("query_id", "vec_id").count().filter("count > 1").isEmpty()


def test_only_files_of_probed_cells_are_read(path, queries):
    one = queries.limit(1)
    found = index.search(path, one, 5, 1)
    few = files(found)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert few == 3 < files(index.search(path, one, 5, 4)) < files(index.search(path, one, 5, 24)) == 36


def test_codes_by_brute_force(spark, path, v, queries):
    """All cells: distances are sums of distances of slices to the centers of the codes."""
    books = ivf._books(spark.read.parquet(f"{path}/books"))
    parts = v.reshape(900, 4, 2)
    codes = np.stack([((parts[:, s, None] - b[None]) ** 2).sum(-1).argmin(1) for s, b in enumerate(books)], 1)
    near = np.stack([b[codes[:, s]] for s, b in enumerate(books)], 1).reshape(900, 8)
    want = []
    for i, q in enumerate(v[::90] + 0.05):
        d = ((near - q) ** 2).sum(1).round(6)
        want += [(i, r + 1, int(x), float(d[x])) for r, x in enumerate(np.lexsort((np.arange(900), d))[:7])]
    got = hits(index.search(path, queries, 7, 24, codes=True))
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)


def test_hot_cells_are_dealt_over_tasks(path, corpus, queries, monkeypatch):
    want = hits(index.search(path, queries, 10, 5)), hits(index.search(path, queries, 10, 5, codes=True))
    monkeypatch.setattr(ivf, "CELL_PART", 7)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 2)
    assert (hits(index.search(path, queries, 10, 5)), hits(index.search(path, queries, 10, 5, codes=True))) == want


def test_queries_of_a_cell_are_dealt_by_their_hits(path, queries, monkeypatch):
    """Many hits a query: a task gets, and searches for together, fewer queries, and the hits are the same."""
    want = hits(index.search(path, queries, 10, 24)), hits(index.search(path, queries, 5, 24, codes=True, shortlist=4))
    sizes = []
    monkeypatch.setattr(ivf, "PART_HITS", 40)
    monkeypatch.setattr(ivf, "KEPT", 20)
    parts = ivf._parts
    monkeypatch.setattr(ivf, "_parts", lambda rows, name, most: sizes.append(most) or parts(rows, name, most))
    assert (hits(index.search(path, queries, 10, 24)), hits(index.search(path, queries, 5, 24, codes=True, shortlist=4))) == want
    assert sizes == [4, 2]


def test_failed_appends_compaction_and_vacuum(spark, corpus, queries, tmp_path):
    path = f"file://{tmp_path}/i"
    index.create(path, ivf.train_cells(corpus, 6), buckets=3)
    assert index.search(path, queries, 3, 6).collect() == [] and not index.compact(spark, path, "none")
    index.append(path, "none", corpus.filter("vec_id < 0"))
    assert index.search(path, queries, 3, 6).collect() == []
    for n in range(3):
        index.append(path, str(n), corpus.filter(f"vec_id % 3 = {n}"))
    corpus.limit(5).withColumns({"cell": F.lit(1), "bucket": F.lit(0)}).write.partitionBy("bucket").parquet(f"{path}/data/batch={index._folder('failed')}")
    before = sorted(map(tuple, index.scan(spark, path).select("vec_id", "cell").collect()))
    assert len(before) == 900
    want = hits(index.search(path, queries, 4, 2))
    assert index.compact(spark, path, "all") and not index.compact(spark, path, "all")
    assert len(index.live(spark, path)) == 1 and len(index.scan(spark, path).inputFiles()) <= 6
    assert index.vacuum(spark, path) == 5  # three batches, an empty one and the failed one
    assert sorted(map(tuple, index.scan(spark, path).select("vec_id", "cell").collect())) == before
    assert hits(index.search(path, queries, 4, 2)) == want
    assert index.append(path, "failed", corpus.limit(5).withColumn("vec_id", F.col("vec_id") + 5000)) and index.scan(spark, path).count() == 905


def test_rows_without_id_or_vector_and_empty_queries(spark, corpus, queries, tmp_path):
    path = f"file://{tmp_path}/i"
    index.create(path, ivf.train_cells(corpus, 4), buckets=2)
    odd = spark.createDataFrame([(9000, None), (None, [0.0] * 8), (9001, [0.0] * 8)], VECTORS).withColumn("cell", F.lit("x"))
    assert index.append(path, "odd", odd) and [r["vec_id"] for r in index.scan(spark, path).collect()] == [9001]
    assert index.search(path, queries.filter("query_id < 0"), 3, 4).collect() == []
    twice = queries.filter("query_id = 1").union(queries.filter("query_id = 1"))
    assert [(r["query_id"], r["vec_id"]) for r in index.search(path, twice, 3, 4).collect()] == [(1, 9001)]


def test_scope_by_bounds(spark, path, corpus, queries):
    """Exact hits in scope, and fewer cells visited than there are: the vectors lie in clusters."""
    metadata = corpus.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4 == 0).alias("has_url"), F.lit("d").alias("source_dataset"))
    scope = search.in_scope("url_only")
    found = index.search_within(path, queries, metadata, 3, scope, 1)
    assert hits(found) == hits(search.search_within(queries, corpus, metadata, 3, scope))
    visited = {r["query_id"]: r["probed"] for r in found.select("query_id", "probed").distinct().collect()}
    assert len(visited) == 10 and np.mean(list(visited.values())) < 18
    none = index.search_within(path, queries, metadata, 3, search.in_scope("url_only") & (F.col("id") == 4), 1)
    assert [(r["vec_id"], r["rank"]) for r in none.filter("query_id = 0").collect()] == [(4, 1)]


def test_two_levels(spark, corpus, v, queries, monkeypatch, tmp_path):
    coarse, cells = ivf.train_two_levels(corpus, 6, 5)
    rows = cells.collect()
    assert 20 <= len(rows) <= 30 and all(r["cell"] // 5 == r["coarse"] for r in rows)
    again = ivf.train_two_levels(corpus.repartition(3), 6, 5)[1].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    # cells of both levels tell vectors apart better than the coarse ones
    c = {r["cell"]: np.array(r["center"]) for r in rows}
    top = np.array([r["center"] for r in coarse.orderBy("coarse").collect()])
    loss = sum(((v[r["vec_id"]] - c[r["cell"]]) ** 2).sum() for r in ivf.assign_beam(corpus, coarse, cells, 2).collect())
    assert loss < 0.7 * ((v[:, None] - top[None]) ** 2).sum(-1).min(1).sum()
    key = lambda df: sorted(map(tuple, df.select("vec_id", "cell").collect()))
    whole = key(ivf.assign_cells(corpus, cells.select("cell", "center"), 2))
    assert key(ivf.assign_beam(corpus, coarse, cells, 6, 2)) == whole and len(whole) == 1800
    narrow = key(ivf.assign_beam(corpus, coarse, cells, 2))
    path = f"file://{tmp_path}/i"
    index.create(path, cells, coarse, buckets=4)
    index.append(path, "all", corpus, beam=6)
    assert hits(index.search(path, queries, 5, 30)) == hits(search.top_k(queries, corpus, 5))
    monkeypatch.setattr(ivf, "CENTER_BYTES", 8 * 8 * 6)  # the coarse centers fit, the fine ones don't
    assert key(ivf.assign_beam(corpus, coarse, cells, 2)) == narrow
    assert key(ivf.assign_beam(corpus, coarse, cells, 6, 2)) == whole
    with pytest.raises(ValueError, match="two_levels"):
        ivf.assign_cells(corpus, cells.select("cell", "center"))


def test_a_coarse_cell_with_a_third_of_the_sample(spark, monkeypatch):
    """A task fits a bounded number of vectors, of equal ones too."""
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full((400, 3), 9.0), rng.normal(size=(600, 3))])
    monkeypatch.setattr(ivf, "PER_CENTER", 10)
    coarse, cells = ivf.train_two_levels(table(spark, v), 2, 4)
    assert 5 <= cells.count() <= 8
    assert ivf.assign_beam(table(spark, v), coarse, cells, 2).filter("vec_id < 400").select("cell").distinct().count() == 1


def test_queries_in_blocks_of_bytes(spark, corpus, queries, monkeypatch):
    want = hits(search.top_k(queries, corpus, 6))
    plan = search.top_k(queries, corpus, 6)._jdf.queryExecution().toString()
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert hits(search.top_k(queries, corpus, 6)) == want
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    blocks = search.top_k(queries, corpus, 6)
    assert hits(blocks) == want
    assert plan.count("MapInArrow") < blocks._jdf.queryExecution().toString().count("MapInArrow")
    # all queries of one id are dealt over blocks, and count as one
    same = queries.withColumn("query_id", F.lit(1).cast("long"))
    monkeypatch.setattr(search, "QUERY_BYTES", 1 << 20)
    whole = hits(search.top_k(same, corpus, 6))
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    assert hits(search.top_k(same, corpus, 6)) == whole


def test_nearest_distances_by_brute_force(spark, path, v, queries, monkeypatch):
    """Few distinct codes, so that many vectors are at one distance; copies in two cells and repeated ids count once."""
    books = spark.createDataFrame([(s, c, [float(c - 1), float(s)]) for s in range(4) for c in range(3)], "sub int, code int, center array<double>")
    codes = np.random.default_rng(3).integers(0, 3, (900, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(codes)] + [(i, codes[i].tolist()) for i in range(0, 900, 7)] + [(i, [1, 1, 1, 1]) for i in range(5)] + [(None, [1, 1, 1, 1]), (1000, None)]
    held = spark.createDataFrame(rows, "vec_id long, codes array<short>").repartition(6)
    asked = queries.union(queries.limit(1).selectExpr("query_id + 90", "query_vec")).union(queries.filter("query_id = 0").selectExpr("query_id", "transform(query_vec, x -> x + 1)"))
    centers = ivf._books(books)
    of = {}
    for r in asked.collect():
        q = np.array(r["query_vec"]).reshape(4, 2)
        far = np.array([[((q[s] - centers[s, c]) ** 2).sum() for c in range(3)] for s in range(4)])
        for i, x in rows:
            if i is not None and x is not None:
                d = round(float(sum(far[s, c] for s, c in enumerate(x))), 6)
                of.setdefault(r["query_id"], {})[i] = min(d, of.get(r["query_id"], {}).get(i, d))
    want = []
    for name, found in of.items():
        d = np.array(sorted(found.values()))
        want += [(name, x, int((d == x).sum())) for x in np.unique(d) if (d < x).sum() < 40]
    want = np.array(sorted(want))

    def right():
        found = np.array(sorted(map(tuple, ivf.nearest_distances(asked, held, books, 40).collect())))
        return found.shape == want.shape and np.allclose(found, want, atol=2e-6)

    assert right() and want[:, 2].max() > 10
    # no task sends more than it must: distances that fewer than 40 vectors are below
    plan = ivf._distances(asked, held.filter("vec_id is not null and codes is not null").repartition(3, "vec_id"), spark.sparkContext.broadcast(centers), 40)
    assert plan.count() <= 3 * 40 * len(of) < 900 * len(of)
    monkeypatch.setattr(ivf, "TASK_PAIRS", 2000)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ivf, "QUERY_BYTES", 100)
    monkeypatch.setattr(ivf, "HELD", 50)
    monkeypatch.setattr(ivf, "PAIRS", 17)
    assert right()


def test_nearest_distances_of_a_stored_index(spark, path, queries):
    """Each vector is stored in two cells, and counts once."""
    found = index.search(path, queries, 900, 24, codes=True).withColumn("r", F.expr("rank() over (partition by query_id order by distance)"))
    want = found.filter("r <= 30").groupBy("query_id", "distance").agg(F.count("*").alias("n"))
    key = lambda df: sorted((r["query_id"], r["distance"], r["n"]) for r in df.collect())
    assert key(index.nearest_distances(path, queries, 30)) == key(want)
    assert index.nearest_distances(path, queries.filter("query_id < 0"), 30).isEmpty()
