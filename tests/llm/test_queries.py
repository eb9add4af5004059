"""The registered queries of the ten operators on the smallest tables: columns, types, ranges, and the contracts' formulas."""

import hashlib
import math
import os
import zlib
from collections import Counter

import helpers
import pytest
from test_dedup import kept, linked
from test_mixing_and_scoring import targets
from test_quality import base

from tesserae.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are missing")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}


def run(spark, name, schema):
    found = QUERIES[name](spark, FOLDER)
    types = dict(found.dtypes)
    assert {k: types[k] for k in schema} == schema
    return found.collect()


def test_language(spark, docs):
    got = run(spark, "op1_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    learnt = {d["lang"] for i, d in docs.items() if crc(i) % 3 != 1 and d["lang"]}
    for r in got:
        letters = any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")
        assert r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in (learnt if letters else {"und"})
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_urls(spark, pages):
    got = run(spark, "op2_url_filter", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        url, host, path = pages[r["page_id"]], "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:end].translate(helpers.LOWER), rest[end:].split("?")[0].split("#")[0]
        fit = [(rule, v) for v, rule in URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, r["verdict"]))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best) and r["verdict"] in ("allow", "block")


def test_quality(spark, docs):
    schema = {"doc_id": "bigint", "base_failed": "boolean", "kept": "boolean"} | {k: "bigint" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    got = run(spark, "op3_kneser_ney", schema)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n_words, chars, symbols, lines, repeats = want = base(docs[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n_words < 50 or 100 * repeats > 50 * n_words) and not (r["kept"] and r["base_failed"])
    passed = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) >= 0.8 * len(passed)


def test_toxicity(spark, docs):
    got = run(spark, "op5_ftrl_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_sites(spark, docs):
    got = run(spark, "op6_site_quality", {"doc_id": "bigint", "host": "string", "path": "string", "score": "double", "kept": "boolean"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got if abs(r["score"] - 0.5) > 1e-6)


def test_links(spark, docs):
    got = run(spark, "op7_grouped_prefix_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked([(i, d["text"]) for i, d in docs.items()])


def test_mixing(spark, docs):
    got = run(spark, "op8_entropy_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(helpers.words(docs[r["doc_id"]]["text"])) and r["taken"] <= 3 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    want = targets(sizes)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], want[source], rel_tol=1e-9)
    assert all(abs(taken[k] - want[k]) <= longest[k] / 2 + 1 for k in sizes)
    again = {(r["doc_id"], r["taken"]) for r in run(spark, "op8_entropy_mixing", {})}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_repeats(spark, docs):
    got = run(spark, "op9_super_kmer_dedup", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    want = [(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in kept([(i, d["text"]) for i, d in docs.items()])]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_scoring(spark, docs):
    schema = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    got = run(spark, "op10_suffix_tree", schema)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    tokens = {i: [*helpers.words((d["text"] or "").translate(helpers.LOWER)), None] for i, d in docs.items()}
    c = Counter(w for i, t in tokens.items() if crc(i) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-6, abs_tol=1e-5)
        # a byte costs less than one of 256 equally likely ones; whether the tree beats the base depends on the size: README
        spelt = sum(len(w.encode()) + 1 for w in t if w is not None) + 1
        assert -math.log10(256) * spelt < r["score"] < 0
