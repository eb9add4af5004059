import math
import zlib
from collections import Counter

import corpus_pipeline
import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, mixing, suffix_tree


def targets(sizes):
    """Water filling, one source at a time."""
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: 1 + i % 3 for i, k in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in full]
        left = total - sum(full.values())
        at = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if at[k] > 3 * sizes[k]]
        if not over:
            return full | at
        full |= {k: 3.0 * sizes[k] for k in over}


def test_targets_and_copies(spark):
    rows = []
    for s, (name, n) in enumerate([("b", 300), ("a", 100), ("é", 5), ("", 40), (None, 60), ("c", 200)]):
        rows += [(1000 * s + i, helpers.sentence(i, 5 + (i * 37) % 90), None, name) for i in range(n)]
    rows += [(9001, None, None, "a"), (9002, "", None, "zero"), (5, helpers.sentence(5, 40), None, "b")]
    docs = helpers.documents(spark, rows).repartition(4)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, longest, want = Counter(), Counter(), Counter(), {}
    for r in got:
        n = len(helpers.words(r["text"]))
        assert r["_size"] == n and 0 <= r["_copies"] <= 3
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["_copies"]
        longest[r["source"]] = max(longest[r["source"]], n)
        want[r["source"]] = r["_target"]
    expected = targets(sizes)
    for k in sizes:
        assert math.isclose(want[k], expected[k], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[k] - want[k]) <= longest[k] + 1
    again = mixing.mix_sources(docs.repartition(9)).select("doc_id", "_copies").collect()
    assert Counter((r[0], r[1]) for r in again) == Counter((r["doc_id"], r["_copies"]) for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_rates_solve_the_dual_and_copies_follow_from_them(spark):
    """Rates by bisection, and copies by one running sum over each source, as the docstring says."""
    import xxhash

    rows = [(i, helpers.sentence(i, 1 + (i * 31) % 70), None, "abc"[i % 3]) for i in range(300)] + [(7, "a b", None, "a")]
    docs = helpers.documents(spark, rows).selectExpr("*", "1 as _salt", "2 as _rank", "3 as _before", "4 as _size", "5 as `x.y`")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all((r["_salt"], r["_rank"], r["_before"], r["x.y"]) == (1, 2, 3, 5) for r in got)
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        target, mean = own[0]["_target"], sum(r["_size"] for r in own) / len(own)
        lo, hi = -60.0, 60.0
        for _ in range(200):
            m = (lo + hi) / 2
            words = sum(r["_size"] * 3 / (1 + 2 * math.exp(-m * r["_size"] / mean)) for r in own)
            lo, hi = (m, hi) if words < target else (lo, m)
        for r in own:
            assert math.isclose(r["_rate"], 3 / (1 + 2 * math.exp(-m * r["_size"] / mean)), rel_tol=1e-4)
        signed = lambda i: (xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), 42).intdigest() ^ (1 << 63)) - (1 << 63)
        total, want = 0.0, Counter()
        for r in sorted(own, key=lambda r: (-r["_size"], signed(r["doc_id"]) % 64, signed(r["doc_id"]), r["doc_id"])):
            after = total + r["_rate"]
            want[(r["doc_id"], r["_size"])] += math.floor(after + 0.5) - math.floor(total + 0.5)
            total = after
        have = Counter()
        for r in own:
            have[(r["doc_id"], r["_size"])] += r["_copies"]
        assert sum(abs(have[k] - want[k]) for k in want) <= 2  # a sum of floats may fall on the other side of a half


def test_sources_that_cannot_be_balanced_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    rows = [(i, helpers.sentence(i, 1 + i % 40), None, "ab"[i % 2]) for i in range(50)]
    with pytest.raises(RuntimeError):
        mixing.mix_sources(helpers.documents(spark, rows))


def test_suffix_tree_base_and_gain(spark):
    rows = [(i, helpers.sentence(i % 40, 60, 50).replace("w1", "W1")) for i in range(140)]
    rows = [r[:2] for r in helpers.awkward(rows)]
    docs = helpers.documents(spark, rows)
    got = suffix_tree.score(docs, common.crc_mod("doc_id", 7) == 2).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*helpers.words((t or "").translate(helpers.LOWER)), None] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-6, abs_tol=1e-5)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tree_sums_to_one(spark):
    docs = helpers.documents(spark, [(i, helpers.sentence(i, 100, 30)) for i in range(60)])
    tree = suffix_tree.train(docs)
    assert sum(map(len, tree.contexts)) > 10
    for context in (0x2077317732, 0xFFFFFFFFFF, 0x6161616161):
        total = (10.0 ** tree.score((context << 8) + np.arange(256))).sum()
        assert math.isclose(total, 1, rel_tol=1e-6)


def test_tree_grows_with_the_corpus_and_scores_as_in_one_piece(spark):
    """A rare passage keeps its contexts however much other text there is; buckets give what one tree gives."""
    rare = " ".join(["aqqqq1 bqqqq2"] * 40)
    rows = [(i, helpers.sentence(i, 4000)) for i in range(60)] + [(7000 + i, rare) for i in range(2)]
    docs = helpers.documents(spark, rows)
    tree = suffix_tree.train(docs.filter("doc_id <> 7001"))
    longest = {int(x).to_bytes(5, "big") for x in tree.contexts[5]}
    assert {b"aqqqq", b"bqqqq"} <= longest  # seen 40 times each in 1.2 million symbols
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, F.col("doc_id") == 7001).collect()}
    data = np.frombuffer(f"{rare} ".encode() + b"\xff", np.uint8)
    logs = tree.score(suffix_tree.grams(data, np.array([0, len(data)])).astype(np.int64))
    assert math.isclose(got[7001]["score"], logs.sum(), abs_tol=1e-4)


def plain_tree(texts):
    """Counts of every context, which contexts are retained, and the probability of a symbol after a history."""
    depth, end = suffix_tree.DEPTH, 0xFF
    seen = {}
    for text in texts:
        data = bytes([end] * depth) + spelt(text)
        for at in range(depth, len(data)):
            for k in range(depth + 1):
                seen.setdefault(data[at - k : at], Counter())[data[at]] += 1
    kept = {c for c in seen if len(c) <= suffix_tree.TRUNK}
    for c, next_ in seen.items():
        total, below = sum(next_.values()), seen[c[1:]]
        if len(c) > suffix_tree.TRUNK and total >= suffix_tree.LEAST_COUNT:
            gain = sum(n * math.log(n / total * sum(below.values()) / below[x]) for x, n in next_.items())
            if gain >= suffix_tree.LEAST_DIVERGENCE:
                kept |= {c[i:] for i in range(len(c) + 1)}

    def probability(history, symbol):
        p = 1 / 256
        for k in range(depth + 1):
            c = history[len(history) - k :]
            if c not in kept:
                break
            total, kinds = sum(seen[c].values()), len(seen[c])
            p = (seen[c][symbol] + kinds * p) / (total + kinds)
        return p

    return kept, probability


def spelt(text):
    return "".join(w + " " for w in helpers.words((text or "").translate(helpers.LOWER))).encode() + b"\xff"


def plain_score(probability, text):
    data = bytes([0xFF] * suffix_tree.DEPTH) + spelt(text)
    return sum(math.log10(probability(data[i - suffix_tree.DEPTH : i], data[i])) for i in range(suffix_tree.DEPTH, len(data)))


@pytest.mark.parametrize("spread", [2048, 1])
def test_scores_are_those_of_a_plain_suffix_tree(spark, monkeypatch, spread):
    """Also where each bucket is dealt over as many salts as there are bundles."""
    monkeypatch.setattr(suffix_tree, "SPREAD", spread)
    rows = [(i, helpers.sentence(i % 30, 40, 60)) for i in range(90)] + [(200, None), (201, ""), (202, "é 漢字 W1 w1"), (203, "zz " * 30)]
    docs = helpers.documents(spark, rows).repartition(5)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, F.col("doc_id") % 5 == 0).collect()}
    kept, probability = plain_tree([t for i, t in rows if i % 5])
    assert sum(len(c) > suffix_tree.TRUNK for c in kept) > 10 and len(got) == len(rows)
    for i, text in rows:
        assert math.isclose(got[i], plain_score(probability, text), rel_tol=1e-6, abs_tol=1e-5), i
    for history in (b"w1 w2 ", b"\xff\xff\xff\xff\xffw", b"qqqqqq"):
        assert math.isclose(sum(probability(history, x) for x in range(256)), 1, rel_tol=1e-9)


def test_longer_words_cost_more(spark):
    """Words that training never saw are spelt by the tree: a longer one is less likely than its beginning."""
    rows = [(i, helpers.sentence(i, 50)) for i in range(30)] + [(100, "xkcdqjvzwm" * 500), (101, "xkcdqjvzwm")]
    got = {r["doc_id"]: r for r in suffix_tree.score(helpers.documents(spark, rows), F.col("doc_id") >= 100).collect()}
    assert got[100]["score"] < 100 * got[101]["score"] < 0 and got[100]["base_score"] == got[101]["base_score"]


def test_scoring_without_training_texts(spark):
    got = suffix_tree.score(helpers.documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in sorted(got)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert suffix_tree.score(helpers.documents(spark, [(1, "a")]).limit(0), F.lit(False)).count() == 0


def test_pipeline_on_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    english = [(i, helpers.sentence(i, 80), "en", f"s{i % 3}") for i in range(40)]
    passage = helpers.sentence(900, 60)
    english += [(50 + i, helpers.sentence(50 + i, 60) + " " + passage, "en", "s1") for i in range(3)]
    item = helpers.sentence(700, 40)
    english += [(60, helpers.sentence(60, 50) + " " + item, "en", "s2"), (61, english[0][1], "en", "s0"), (62, "12 34", "en", "s0")]
    docs = helpers.documents(spark, helpers.awkward(english))
    docs = docs.withColumns({"_id": F.lit(1), "_score": F.lit("x"), "c0": F.lit(2), "a b.c": F.lit(3), "_copies": F.lit(4)})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = docs
    ids = {}
    for name, step in corpus_pipeline.STAGES:
        before = out
        out = common.stage(step(spark, out, folder), "test")
        if name != "mixing":
            assert out.columns == before.columns and out.dtypes == before.dtypes
        ids[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 62 not in ids["language_id"] and 9001 not in ids["language_id"] and 9002 not in ids["language_id"]
    shared = helpers.documents(spark, [(1, english[1][1]), (1, english[2][1]), (1, english[1][1]), (2, english[1][1]), (None, english[2][1]), (None, None)])
    kept = corpus_pipeline.one_of_each_group(spark, shared, folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, english[1][1]), (1, english[2][1]), (None, None)], key=str)
    assert 61 not in ids["jaccard_join"] and 0 in ids["jaccard_join"] and None in ids["jaccard_join"]
    assert 60 in ids["substring_dedup"] and 60 not in ids["decontamination"]
    assert set(range(40)) | {50, 51, 52, 9004} <= ids["decontamination"]
    assert corpus_pipeline.run(spark, folder).count() == out.count()
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0
