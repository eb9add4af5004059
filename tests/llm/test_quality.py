import math
import random
import re
from collections import Counter, defaultdict

import helpers
import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import quality_rules, site_quality, toxicity


def base(text):
    w = helpers.words(text)
    lines = [x for x in (text or "").split("\n") if helpers.words(x)]
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = set()
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    n_sym = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), n_sym, len(lines) - len(set(lines)), len(cover)


def test_base_counts_and_bands(spark):
    rows = [(i, helpers.sentence(i, 80), "en") for i in range(30)]
    rows += [(100, "a b c a b c\na b c\n\n a b c\na b c #*$", "en"), (101, "x " * 120, "en")]
    rows += [(102, " ".join("|#$%&*@!" * 3 for _ in range(90)), "en"), (0, helpers.sentence(0, 80), "en")]
    rows = helpers.awkward(rows)
    got = quality_rules.judge(helpers.documents(spark, rows), "text", "lang", "doc_id").collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in got:
        want = base(texts[r["doc_id"]])
        assert tuple(r[f"_{k}"] for k in quality_rules.BASE) == want, r["doc_id"]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["_base_failed"] == failed
        assert not (failed and r["_kept"])
    kept = {r["doc_id"]: r["_kept"] for r in got}
    assert all(kept[i] for i in range(30)) and not kept[102]


def test_bands_beside_a_third_of_junk(spark):
    """A third of a language's texts is spelt oddly, a third of another's too evenly; both thirds go, the rest stays."""
    rows = [(i, helpers.sentence(i, 150, 300), "de" if i < 100 else "fr") for i in range(200)]
    rows += [(1000 + i, " ".join(x[::-1] for x in helpers.sentence(i, 150, 300).split()), "de") for i in range(50)]
    # words of three digits each, which a model of four symbols saw as too even, are not even for a model of trigrams
    rows += [(2000 + i, " ".join(f"wwwwwwww{100 + (i + 7 * k) % 200}" for k in range(120)), "fr") for i in range(50)]
    got = quality_rules.judge(helpers.documents(spark, rows), "text", "lang", "doc_id").collect()
    out = {r["doc_id"] for r in got if not r["_kept"]}
    assert not any(r["_base_failed"] for r in got)
    assert {*range(1000, 1050), *range(2000, 2050)} <= out and len(out & set(range(200))) <= 4


def spelt(text):
    """The bytes that the models see, with those that stand before a text."""
    return bytes(quality_rules.ORDER - 1) + re.sub("[0-9]", "0", (text or "").translate(helpers.LOWER)).encode()


def plain_kneser_ney(texts):
    """Modified Kneser-Ney from dictionaries: the probability of a byte after a history, for one language."""
    n = quality_rules.ORDER
    counts = [Counter(s[i - n + 1 : i + 1] for s in map(spelt, texts) for i in range(n - 1, len(s)))]
    while len(counts) < n:
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    lower = None
    tables = []
    for table in counts:
        of = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        y = of[0] / max(of[0] + 2 * of[1], 1)
        off = [max(0.0, min(c, c - (c + 1) * y * of[c] / of[c - 1])) if of[c - 1] else 0.5 * c for c in (1, 2, 3)]
        off = [min(max(x, 0.05), most) for x, most in zip(off, (0.95, 1.9, 2.85))]
        total, left = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            left[g[:-1]] += off[min(c, 3) - 1]
        tables.append((table, off, total, left))

    def probability(gram, k=n):
        if not k:
            return 1 / 256
        table, off, total, left = tables[k - 1]
        g = gram[len(gram) - k :]
        below = probability(gram, k - 1)
        if not total[g[:-1]]:
            return below
        c = table[g]
        return ((c - off[min(c, 3) - 1]) if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below

    return probability


def test_perplexity_by_brute_force(spark, monkeypatch):
    """One model a language, null included; unseen n-grams back off; every context sums to one."""
    rows = [(i, helpers.sentence(i, 40, 90), ["en", "fr", None][i % 3]) for i in range(45)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "Ünï 漢字 é", None), (103, "ABAB abab " * 300, "de")]
    docs = helpers.documents(spark, rows).repartition(4)
    model = quality_rules.train(docs)
    got = {r["doc_id"]: r["_perplexity"] for r in quality_rules.measure(docs, model, "text", "doc_id").collect()}
    plain = {x: plain_kneser_ney([t for _, t, lang in rows if lang == x]) for x in ("en", "fr", None, "de")}
    n = quality_rules.ORDER
    for i, text, lang in rows:
        data = spelt(text)
        logs = [-math.log10(plain[lang](data[k - n + 1 : k + 1])) for k in range(n - 1, len(data))]
        assert math.isclose(got[i], sum(logs) / max(len(logs), 1), abs_tol=2e-5), i
    other = docs.withColumn("lang", F.lit("en")).filter("lang is not null and doc_id % 3 = 1")
    got = {r["doc_id"]: r["_perplexity"] for r in quality_rules.measure(other, model, "text", "doc_id").collect()}
    data = spelt(rows[1][1])
    want = sum(-math.log10(plain["en"](data[k - n + 1 : k + 1])) for k in range(n - 1, len(data))) / len(rows[1][1])
    assert math.isclose(got[1], want, abs_tol=2e-5)
    seed = np.full(256, quality_rules._seed("sen"))
    for context in (b"w00 ", b"zzzz", bytes(4)):
        code = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert math.isclose((10.0 ** model[0].score(seed, code)).sum(), 1, rel_tol=1e-4)
    monkeypatch.setattr(quality_rules, "MOST_ENTRIES", 10)
    parts = quality_rules.train(docs)
    assert len(model) == 1 and len(parts) == 4  # an array for each language, and the same figures
    want = {r["doc_id"]: r["_perplexity"] for r in quality_rules.measure(docs, model, "text", "doc_id").collect()}
    assert want == {r["doc_id"]: r["_perplexity"] for r in quality_rules.measure(docs, parts, "text", "doc_id").collect()}


def test_letters_that_are_right_by_threes(spark):
    """Junk whose every three letters are as frequent as in prose, which a model of trigrams takes for prose."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(200)]
    prose = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(100)]
    after = defaultdict(list)
    for text in prose:
        for k in range(len(text) - 2):
            after[text[k : k + 2]].append(text[k + 2])
    rows = [(i, text, "fr") for i, text in enumerate(prose)]
    for i in range(10):
        text = prose[i][:2]
        while len(text) < 1200:
            text += rng.choice(after[text[-2:]])
        rows.append((1000 + i, text, "fr"))
    got = quality_rules.judge(helpers.documents(spark, rows), "text", "lang", "doc_id").collect()
    out = {r["doc_id"] for r in got if not r["_kept"]}
    assert not any(r["_base_failed"] for r in got)
    assert set(range(1000, 1010)) <= out and len(out & set(range(100))) <= 4


def spoken(seed, n, vocabulary=5000):
    """Like sentences, of letters."""
    return helpers.sentence(seed, n, vocabulary).translate(str.maketrans("0123456789", "aeioubdgkm"))


def test_judged_by_the_other_half(spark, monkeypatch):
    """A text's figure is that of the other half's model, of texts inside the first band; copies are in one half."""
    rows = [(i, spoken(i, 60), ["en", None][i % 2]) for i in range(40)] + [(100, None, "en"), (0, spoken(0, 60), "en")]
    rows += [(200, " ".join(bytes(97 + (k * k * 7 + j * k * 13 + j**3) % 26 for j in range(5)).decode() for k in range(200)), "en")]
    docs = helpers.documents(spark, rows).repartition(3)
    half = {r["text"]: r["h"] for r in docs.selectExpr("text", "pmod(xxhash64(text), 2) as h").collect()}
    first = {r["doc_id"]: r["_perplexity"] for r in quality_rules.measure(docs, quality_rules.train(docs, order=3), "text", "doc_id").collect()}
    monkeypatch.setattr(quality_rules, "LEAST_SPREAD", 0.1)
    others = [x for i, x in first.items() if i < 100]
    assert max(others) - min(others) < 0.1 and first[200] < min(others) - 0.2
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, "text", "lang", "doc_id").collect()}
    for lang in ("en", None):
        for h in (0, 1):
            plain = plain_kneser_ney([t for i, t, x in rows if x == lang and t and half[t] != h and i != 200])
            for i, text, x in rows:
                if x == lang and half[text] == h:
                    data, n = spelt(text), quality_rules.ORDER
                    logs = [-math.log10(plain(data[k - n + 1 : k + 1])) for k in range(n - 1, len(data))]
                    assert math.isclose(got[i]["_perplexity"], sum(logs) / max(len(logs), 1), abs_tol=2e-5), i
    assert not got[200]["_kept"] and not got[100]["_kept"] and got[0]["_kept"]


def test_models_in_parts(spark, monkeypatch):
    """A model that is cut into several arrays gives the same figures, also for languages without a model, and verdicts."""
    rows = [(i, spoken(i, 60), ["en", "fr", None][i % 3]) for i in range(45)] + [(0, spoken(0, 60), "en")]
    docs = helpers.documents(spark, helpers.awkward(rows)).repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    learnt = docs.filter("coalesce(lang, '') != 'de'")
    whole = key(quality_rules.measure(docs, quality_rules.train(learnt), "text", "doc_id"))
    judged = key(quality_rules.judge(docs, "text", "lang", "doc_id"))
    monkeypatch.setattr(quality_rules, "MOST_ENTRIES", 2500)
    monkeypatch.setattr(quality_rules, "MOST_OF_ONE", 2500)
    parts = quality_rules.train(learnt)
    sizes = [len(m.keys) for m in parts]
    assert len(parts) > 2 and max(m.share.parts for m in parts) > 1 and max(sizes) < 0.7 * sum(sizes)
    assert key(quality_rules.measure(docs, parts, "text", "doc_id")) == whole
    assert key(quality_rules.judge(docs, "text", "lang", "doc_id")) == judged


def test_grams_by_numbers_or_sorting(monkeypatch):
    """N-grams of pieces with two languages, empty texts and bytes of zero, against slices."""
    import pyarrow as pa

    texts = ["", "ABAB 12", None, "\x00\x00b", "Ünï 漢字", "z", ""]
    of = np.array([0, 1, 0, 1, 0, 0, 1])
    for dense in (quality_rules._DENSE, 0):
        monkeypatch.setattr(quality_rules, "_DENSE", dense)
        (piece,) = quality_rules.arrays.pieces(pa.array(texts))
        for order, (language, code, place) in zip((1, 3, 5), quality_rules.grams(piece, of, 2, 1, 3, 5)):
            padded = [bytes(order - 1) + spelt(t)[quality_rules.ORDER - 1 :] for t in texts]
            want = [(o, int.from_bytes(s[k : k + order], "big")) for o, s in zip(of, padded) for k in range(len(s) - order + 1)]
            assert list(zip(language[place], code[place])) == want
            pairs = list(zip(language, code))
            assert pairs == sorted(set(want) | {(0, 0), (1, 0)})


def test_empty_table(spark):
    docs = helpers.documents(spark, [(1, "a", "en")]).limit(0)
    assert quality_rules.judge(docs, "text", "lang", "doc_id").count() == 0


def test_toxicity_learns_held_out_words(spark):
    rows = [(i, helpers.sentence(i, 40) + (" you stupid clown" if i % 4 == 0 else "")) for i in range(400)]
    rows = helpers.awkward(rows)
    docs = helpers.documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["_score"] for r in toxicity.score(docs, model, "text", "doc_id").collect()}
    assert len(got) == len(rows) and len(model[0]) < 5000
    held = range(300, 400)
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in held) >= 95
    assert got[9001] == got[9002] == got[9003] < 0.3


def test_toxicity_keeps_states_near_zero():
    """A slot that moves a little in each of several rounds gets its weight: a pass gives back every state it changed."""
    rows = [{"doc_id": 1, "text": "rare word", "label": 1.0, "order": 1, "shard": 0}]
    import pyarrow as pa

    found = toxicity._added(toxicity._fit(pa.Table.from_pylist(rows), None))
    slots, _ = toxicity.features(next(toxicity.arrays.pieces(pa.array(["rare word"]))))
    (at, z, n) = toxicity.arrays.unpacked(found["packed"][0].as_py(), found["n"][0].as_py(), np.int64, np.float64, np.float64)
    parts = toxicity._fit(pa.Table.from_pylist(rows), None)
    assert sum(parts["n"].to_pylist()) == len({*slots.tolist(), toxicity.SLOTS})
    assert len(at) == len(z) == sum(parts["n"].to_pylist()) and np.allclose(z, -0.5) and np.allclose(n, 0.25)


def test_toxicity_without_labels(spark):
    docs = helpers.documents(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels), "text", "doc_id").collect()
    assert [r["_score"] for r in got] == [0.5, 0.5]


def test_sites(spark):
    good = [(i, helpers.sentence(i, 60), None, "s") for i in range(60)]
    bad = [(i, "BUY!! NOW!! $$$ ### " * 20, None, "s") for i in range(60, 90)]
    rows = helpers.awkward(good + bad)
    docs = helpers.documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 90, 2)] + [(None, 1)], "doc_id long, quality int")
    pages = spark.createDataFrame([(i, f"http://h{i // 30}.org/p{i % 2}/x") for i in range(80)] + [(3, None), (None, "http://x/")], "page_id long, url string")
    evidence = site_quality.document_evidence(docs, labels, "text", "quality", "doc_id", "source")
    got = site_quality.combine(site_quality.site_of(evidence, pages)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["_kept"] for i in range(60)) and not any(by[i]["_kept"] for i in range(60, 90))
    assert (by[0]["_host"], by[0]["_path"], by[85]["_host"], by[9001]["_host"]) == ("h0.org", "/p0", "s", "")
    assert by[0]["_host_mean"] > by[60]["_host_mean"]


def test_sites_of_single_documents_and_equal_figures(spark):
    """Every path has one document; one host alone; all figures equal; nothing at all."""
    schema = "doc_id long, _host string, _path string, _p double"
    for rows in (
        [(i, "h", f"/p{i}", 0.2 + 0.05 * i) for i in range(10)],
        [(i, f"h{i}", "/", 0.9) for i in range(5)],
        [(1, "h", "/", 0.5)],
        [(1, "h", "/", 0.5), (1, "h", "/", 0.5), (None, "h", "/", 0.5)],
        [(i, "h", "/", 0.999 if i else 0.001) for i in range(3)],
    ):
        got = site_quality.combine(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 and 0 < r["_host_mean"] < 1 for r in got)
    assert site_quality.combine(spark.createDataFrame([], schema)).count() == 0
    none = helpers.documents(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert site_quality.document_evidence(none, labels, "text", "quality", "doc_id", "source").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels.withColumnRenamed("quality", "toxic")), "text", "doc_id").count() == 0


def plain_sites(rows):
    """Posteriors and scores of (host, path, p) from the formulas: moments, shrinkage, and odds without a document's own p."""

    def strength(groups, prior):
        n, total = sum(len(g) for g in groups), len(groups)
        within = max(sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups), 1e-9) / max(n - total, 1)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, prior))
        spread = (between - (total - 1) * within) / max(n - sum(len(g) ** 2 for g in groups) / n, 1.0)
        return min(1e6, max(site_quality.LEAST_STRENGTH, within / max(spread, within / 1e6)))

    hosts, paths = {}, {}
    for host, path, p in rows:
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)
    mean = sum(p for _, _, p in rows) / len(rows)
    of_host = strength(list(hosts.values()), [mean] * len(hosts))
    host_mean = {h: (sum(g) + of_host * mean) / (len(g) + of_host) for h, g in hosts.items()}
    of_path = strength(list(paths.values()), [host_mean[h] for h, _ in paths])
    logit, cut = (lambda p: math.log(p / (1 - p))), (lambda p: max(0.001, min(0.999, p)))
    for host, path, p in rows:
        g = paths[host, path]
        own = cut((sum(g) - p + of_path * host_mean[host]) / (len(g) - 1 + of_path))
        yield host_mean[host], own, 1 / (1 + math.exp(-(logit(p) + logit(own) - logit(cut(mean)))))


def test_site_posteriors_by_brute_force(spark):
    """Also beside columns that are named like those within, which stay as they are."""
    rng = np.random.default_rng(2)
    rows = [(f"h{h}", f"/{k % 4}", float(np.clip(round(rng.beta(1 + h, 4), 3), 0.001, 0.999))) for h in range(6) for k in range(2 + 5 * h)]
    names = ["n", "s", "q", "hn", "hs", "_salt", "_host_mean", "c0"]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, _host string, _path string, _p double").selectExpr("*", *[f"'x' as {c}" for c in names])
    found = site_quality.combine(table)
    assert found.columns == ["doc_id", "_host", "_path", "_p", *[c for c in names if c != "_host_mean"], "_host_mean", "_path_mean", "_score", "_kept"]
    got = {r["doc_id"]: r for r in found.collect()}
    for i, want in enumerate(plain_sites(rows)):
        assert np.allclose([got[i][c] for c in ("_host_mean", "_path_mean", "_score")], want, atol=1e-9)
        assert got[i]["_kept"] == (got[i]["_score"] >= 0.5) and got[i]["n"] == got[i]["_salt"] == "x"


def test_site_posteriors_improve_on_noisy_documents(spark):
    """Sites differ, single documents tell little: shrunk posteriors of path and host make fewer mistakes than documents alone."""
    rng = np.random.default_rng(11)
    rows, good = [], {}
    for h in range(40):
        rate = rng.choice([0.1, 0.9])
        for k in range(int(rng.integers(2, 60))):
            i = len(rows)
            good[i] = bool(rng.random() < rate)
            p = 1 / (1 + math.exp(-(1.0 if good[i] else -1.0) * 0.8 - rng.normal() * 1.2))
            rows.append((i, f"h{h}", f"/p{k % 3}", float(min(0.999, max(0.001, p)))))
    got = site_quality.combine(spark.createDataFrame(rows, "doc_id long, _host string, _path string, _p double")).collect()
    alone = sum((r["_p"] >= 0.5) != good[r["doc_id"]] for r in got)
    together = sum(r["_kept"] != good[r["doc_id"]] for r in got)
    assert together < 0.85 * alone


def test_sites_without_labels(spark):
    docs = helpers.documents(spark, [(1, "a b", None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["_p"] for r in site_quality.document_evidence(docs, none, "text", "quality", "doc_id").collect()] == [0.5]


def plain_ftrl(shards, rounds):
    """FTRL from dictionaries: a pass over each shard, then the mean of the states."""
    z, n = Counter(), Counter()
    weight = lambda z, n: 0.0 if abs(z) <= toxicity.L1 else -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)
    for _ in range(rounds):
        sum_z, sum_n = Counter(), Counter()
        for rows in shards:
            own_z, own_n = Counter(z), Counter(n)
            for features, label in rows:
                w = {f: weight(own_z[f], own_n[f]) for f in features}
                g = 1 / (1 + math.exp(-sum(w.values()))) - label
                for f in features:
                    own_z[f] += g - (math.sqrt(own_n[f] + g * g) - math.sqrt(own_n[f])) / toxicity.ALPHA * w[f]
                    own_n[f] += g * g
            for total, now in ((sum_z, own_z), (sum_n, own_n)):
                for f, x in now.items():
                    total[f] += x
        z, n = ({f: x / len(shards) for f, x in t.items()} for t in (sum_z, sum_n))
        z, n = Counter(z), Counter(n)
    return {f: weight(z[f], n[f]) for f in z}


def text_features(text):
    w = [x.strip("!,.") or x for x in helpers.words((text or "").translate(helpers.LOWER))]
    return {("bias",), *[(1, x) for x in w], *[(gap + 1, a, b) for gap in (1, 2, 3) for a, b in zip(w, w[gap:])]}


def test_ftrl_by_brute_force(spark, monkeypatch):
    """States of three groups, their mean over the rounds, and the scores of all texts, by dictionaries."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 40)
    rows = [(i, helpers.sentence(i, 25, 60) + (" You awful, Fool!" if i % 3 == 0 else " good day."), "en", "s") for i in range(120)]
    docs = helpers.documents(spark, helpers.awkward(rows))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["_score"] for r in toxicity.score(docs, toxicity.train(docs, labels), "text", "doc_id").collect()}
    order = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    shards = [[] for _ in range(3)]
    for i in sorted(order, key=order.get):
        shards[order[i] % 3].append((text_features(rows[i][1]), int(i % 3 == 0)))
    weights = plain_ftrl(shards, toxicity.ROUNDS)
    assert sum(w != 0 for w in weights.values()) >= 5
    for i, text, *_ in helpers.awkward(rows):
        if i != 9005 and i != 9004:  # other marks than those stripped here; a text that meets other texts' slots
            total = sum(weights.get(f, 0.0) for f in text_features(text))
            assert math.isclose(got[i], 1 / (1 + math.exp(-total)), abs_tol=2e-6), i
