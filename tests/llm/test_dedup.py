import helpers
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, jaccard_join, substring_dedup


def kept(rows):
    """Brute force; rows without an id come last."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = helpers.words(t)
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone |= set(range(k, k + 20))
            seen.add(x)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_repeated_windows(spark):
    passage = helpers.sentence(1, 60)
    rows = [(i, helpers.sentence(100 + i, 30) + "\n" + passage + " " + helpers.sentence(200 + i, 25)) for i in range(30)]
    rows += [(50, passage), (51, passage), (52, "same " * 300), (53, helpers.sentence(1, 19)), (54, passage.upper())]
    rows = [r[:2] for r in helpers.awkward(rows)]
    got = substring_dedup.kept_words(helpers.documents(spark, rows).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in got), key=str) == kept(rows)


def test_hot_minimisers_change_nothing(spark, monkeypatch):
    passage = helpers.sentence(1, 25)
    rows = [(i, helpers.sentence(i, 40) + " " + passage + " " + helpers.sentence(i + 500, 40)) for i in range(60)]
    docs = helpers.documents(spark, rows).repartition(6)
    assert len(substring_dedup.hot_minimisers(substring_dedup.documents(docs).selectExpr("_doc", "_part", "text"))[0])
    monkeypatch.setattr(substring_dedup, "HOT_PART", 1)
    got = substring_dedup.kept_words(docs).collect()
    assert sorted(((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in got), key=str) == kept(rows)


def test_repeated_rows_and_empty_table(spark):
    text = helpers.sentence(3, 50)
    got = substring_dedup.kept_words(helpers.documents(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["_n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 50)]
    long = helpers.sentence(8, 200_000, 10**9)
    got = substring_dedup.kept_words(helpers.documents(spark, [(2, long), (1, long[100:])])).collect()
    assert sorted((r["doc_id"], r["_n_removed"] > 199_000) for r in got) == [(1, False), (2, True)]
    assert substring_dedup.kept_words(helpers.documents(spark, [(1, text)]).limit(0)).count() == 0


def test_rows_without_an_id_and_rows_that_share_one(spark):
    """Each loses only what stands earlier: in smaller ids, in parts of its own document, in other rows without an id."""
    passage, own = helpers.sentence(1, 30), helpers.sentence(2, 60)
    rows = [(1, passage), (None, passage + " " + helpers.sentence(3, 30)), (None, own), (None, own), (None, None)]
    got = substring_dedup.kept_words(helpers.documents(spark, rows)).collect()
    by = {r["text"]: (r["_n_words"], r["_n_removed"]) for r in got}
    assert len(got) == 5 and sorted(by.values()) == [(0, 0), (30, 0), (60, 0), (60, 30)] and by[own] == (60, 0)
    rows = [(5, own + f" {passage} {i}") for i in range(4)] + [(5, own + f" {passage} 0"), (5, helpers.sentence(9, 50)), (6, own)]
    got = substring_dedup.kept_words(helpers.documents(spark, rows).repartition(3)).collect()
    gone = sorted((r["doc_id"], r["_n_words"], r["_n_removed"]) for r in got)
    assert [x for x in gone if x[1] == 50] == [(5, 50, 0)] and (6, 60, 60) in gone
    parts = {}
    for r in got:
        if r["_n_words"] == 91:
            parts.setdefault(r["text"], set()).add(r["_n_removed"])
    assert sorted(map(list, parts.values())) == [[0], [90], [90], [90]]


def test_removal_keeps_columns_of_any_name(spark):
    text = helpers.sentence(3, 50)
    docs = helpers.documents(spark, [(1, text), (2, text)]).selectExpr("*", "1 as _text", "2 as _spans", "3 as _doc", "4 as _n_words", "5 as `a.b`", "6 as c1")
    got = substring_dedup.kept_words(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "_spans", "_doc", "a.b", "c1", "_n_words", "_n_removed", "_kept"]
    assert sorted(tuple(r)[5:12] for r in got.collect()) == [(1, 2, 3, 5, 6, 50, 0), (1, 2, 3, 5, 6, 50, 50)]


def sets(text):
    w = helpers.words((text or "").translate(helpers.LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    rows = sorted(rows)
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [(rows[i][0], len(s[i]), rows[find(i)][0]) for i in range(len(rows))]


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


@pytest.mark.parametrize("partitions", [1, 6])
def test_links(spark, partitions):
    base = [helpers.sentence(i, 40 + 11 * i) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t) for i, t in enumerate(base)] + [(40 + i, edited(t, i)) for i, t in enumerate(base)]
    # near copies of near copies, some only just within reach, some not
    rows += [(100 + k, edited(base[7], *range(0, 5 * k, 5))) for k in range(1, 12)]
    rows += [(200 + k, edited(base[6], k, 50 + k)) for k in range(12)]
    rows += [(300, "one two"), (301, "One  TWO"), (302, "one two three"), (303, None), (304, ""), (305, " \n"), (306, helpers.sentence(9, 20_000))]
    docs = helpers.documents(spark, rows).repartition(partitions)
    got = jaccard_join.link_components(docs).collect()
    assert sorted((r["_id"], r["_n_shingles"], r["_component"]) for r in got) == linked(rows)


def test_links_of_repeated_rows_and_rows_without_id(spark):
    text = helpers.sentence(4, 30)
    got = jaccard_join.link_components(helpers.documents(spark, [(7, text), (7, text), (None, text), (None, "alone")])).collect()
    assert sorted(r["_component"] for r in got)[:3] == [7, 7, 7]
    assert sorted(r["_component"] for r in got)[3] >= jaccard_join.NO_ID
    assert jaccard_join.link_components(helpers.documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    """Copies of two texts under ids that chain; near copies behind a shared id; an empty text of an id that has others."""
    a, b, c, d = (helpers.sentence(i, 40) for i in range(4))
    rows = [(3, a), (7, a), (7, b), (9, b), (20, c), (21, edited(c, 5)), (21, d), (30, edited(d, 9)), (30, None), (31, ""), (31, "lone words only"), (40, ""), (40, None)]
    for parts in (1, 5):
        got = jaccard_join.link_components(helpers.documents(spark, rows).repartition(parts)).collect()
        want = {3: 3, 7: 3, 9: 3, 20: 20, 21: 20, 30: 20, 31: 31, 40: 40}
        assert sorted((r["_id"], r["_component"]) for r in got) == sorted((i, want[i]) for i, _ in rows)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard_join.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def contained(docs, items):
    def shingles(t):
        w = helpers.words((t or "").lower())
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set(), k

    out, wanted = [], [(j, *shingles(q)) for j, q in items]
    for i, t in docs:
        w = helpers.words((t or "").lower())
        of_width = {k: {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} for k in range(6)}
        for j, s, k in wanted:
            d = of_width[k]
            if s and 100 * len(s & d) >= 75 * len(s):
                out.append((i, j, len(s), len(s & d)))
    return sorted(out, key=str)


def leak_rows():
    items = [(j, helpers.sentence(1000 + j, 12 + 5 * j)) for j in range(12)] + [(50, "tiny Item"), (51, None), (52, ""), (0, helpers.sentence(2000, 30))]
    docs = [(i, helpers.sentence(i, 400) + " " + items[i % 12][1].upper() + "\n" + helpers.sentence(i + 50, 300)) for i in range(24)]
    docs += [(60 + j, helpers.sentence(j, 50) + " " + edited(items[j][1], 3) + " x") for j in range(4, 12)]
    docs += [(90, "a tiny item here"), (91, items[3][1]), (92, " ".join(items[5][1].split()[:20]))]
    return [r[:2] for r in helpers.awkward(docs)], items


@pytest.mark.parametrize("inline", [20_000, 0])
def test_leaks(spark, monkeypatch, inline):
    monkeypatch.setattr(decontaminate, "INLINE", inline)
    docs, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(helpers.documents(spark, docs), table, "text", "doc_id").collect()
    got = sorted(((r["doc_id"], r["_item_id"], r["_n_shingles"], r["_n_matched"]) for r in found), key=str)
    assert got == contained(docs, items)
    clean = decontaminate.without_leaks(helpers.documents(spark, docs), table)
    dirty = {x[0] for x in got}
    assert sorted(map(str, [r["doc_id"] for r in clean.collect()])) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_leaks_keep_columns_of_any_name(spark):
    docs, items = leak_rows()
    table = helpers.documents(spark, docs).selectExpr("doc_id", "text", "1 as item_id", "2 as _row", "3 as item", "4 as h", "5 as _padded")
    names = ["doc_id", "item_id", "_row", "item", "h", "_padded"]
    found = decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id long, text string"), "text", *names)
    assert found.columns == [*names, "_item_id", "_n_shingles", "_n_matched"]
    rows = found.collect()
    assert sorted(((r["doc_id"], r["_item_id"], r["_n_shingles"], r["_n_matched"]) for r in rows), key=str) == contained(docs, items)
    assert {tuple(r)[1:6] for r in rows} == {(1, 2, 3, 4, 5)}


def test_leaks_of_many_items_and_scattered_ones(spark):
    """2,000 items, far above what the expression takes; items whole, edited, and in pieces all over a document."""
    items = [(j, helpers.sentence(5000 + j, 40 + j % 60)) for j in range(2000)]
    docs = [(i, helpers.sentence(i, 300) + " " + items[(i * 37) % 2000][1] + " " + helpers.sentence(i + 500, 200)) for i in range(120)]
    docs += [(200 + i, edited(items[i][1], 10) + " end") for i in range(20)]
    for i in range(10):  # 50 to 59 words, cut into four runs that stand far apart: most shingles are there, but nowhere near each other
        w = items[10 + i][1].split()
        runs = [w[0:13], w[13:26], w[26:39], w[39:]]
        docs.append((300 + i, " ".join(" ".join(x) + " " + helpers.sentence(900 + 4 * i + k, 150) for k, x in enumerate(runs))))
    table = spark.createDataFrame(items, "item_id long, text string")
    bench = decontaminate.Benchmark(table)
    assert bench.count > decontaminate.INLINE and not bench.inline
    found = decontaminate.find_leaks(helpers.documents(spark, docs), table, "text", "doc_id").collect()
    got = {(r["doc_id"], r["_item_id"], r["_n_shingles"], r["_n_matched"]) for r in found}
    want = set(contained(docs, items))
    assert got <= want
    assert len(want) >= 145 and len({x for x in want if x[0] >= 300}) >= 5 and len(got) >= 0.99 * len(want)
    clean = decontaminate.without_leaks(helpers.documents(spark, docs), table)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {x[0] for x in got}


def test_leaks_without_items(spark):
    docs = helpers.documents(spark, [(1, "a b c")])
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none, "text", "doc_id").count() == 0
    assert decontaminate.without_leaks(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_leaks(docs.filter(F.lit(False)), some, "text", "doc_id").count() == 0
