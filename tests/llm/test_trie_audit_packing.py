"""Prefix trie, source audit and packing against plain versions of them."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import packing, prefix_trie, source_audit
from tesserae.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))

# ---- conversations


def name(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{len(text):08X}"


def plain_trie(rows):
    """All nodes of rows (conv_id, turn, role, text), from sets of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(np.fmod(c, 100))
        paths[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) > len(x) and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string"


def nodes(spark, rows, parts=5):
    table = spark.createDataFrame(rows, CONVERSATION).withColumns({"path": F.lit(1), "n": F.lit("x"), "name": F.lit(2.0)}).repartition(parts)
    return sorted(map(tuple, prefix_trie.prefix_trie(table).collect()), key=repr)


def test_trie_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 140), *range(250, 260), -3, -150, 10**12 + 7]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "漢😀", "", "common"])) for t in range(rng.randrange(1, 9))]
    rows += [(300 + c, t, "user", f"same {t}") for c in range(30) for t in range(3)]  # copies
    rows += [(401, t, "user", f"deep {t % 7}") for t in range(77)]  # deeper than any other
    rows += [(402, t, "user", f"deep {t % 7}") for t in range(70)]
    rows += [(500, None, None, None), (500, 0, None, ""), (500, 0, "user", None), (500, 0, "user", None)]  # nulls, ties, a repeated row
    rows += [(None, 0, "user", "of no conversation"), (501, 3, "user", "x" * 200_000), (501, 3, "assistant", "tie")]
    assert nodes(spark, rows) == plain_trie(rows) == nodes(spark, rows[::-1], 2)


def test_trie_of_one_turn_and_of_none(spark):
    for rows in ([(7, 0, "user", "a")], [(100, 0, "u", "a"), (101, 0, "u", "b"), (103, 5, "u", "a")], []):
        assert nodes(spark, rows) == (plain_trie(rows) if rows else [])


def test_digest_of_ids_over_many_rows(spark, monkeypatch):
    """Ids of one node that fill several rows and tasks are hashed in order."""
    paths = spark.range(-5, 20_000).select(F.col("id").alias("conv_id"), F.lit(b"").alias("path")).repartition(6)
    got = prefix_trie.end_digests(paths).collect()
    assert [(r["name"], r["digest"]) for r in got] == [(b"", hashlib.sha256(",".join(map(str, range(-5, 20_000))).encode()).hexdigest())]


# ---- divergences of sources


def plain_audit(rows, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(helpers.LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def audit_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("re", "É", "漢", "Zz", "q") for b in "abcdefgh"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words[: 40 if i % 3 else 12]) + rng.choice(["", ",", "-X", "'s", "9"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", None, "ç"]) if i % 4 else "hot"))
    rows += [(200, "only here", "xx", "a"), (201, None, "xx", "b"), (202, "", "yy", None), (203, "only here " * 3000, "en", "b")]
    return rows + rows[:20]


@pytest.mark.parametrize("shard", [200_000, 7])
def test_audit_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(source_audit, "SHARD", shard)
    rows = audit_rows()
    docs = helpers.documents(spark, rows).withColumns({"n": F.lit(1), "term": F.lit("t"), "value": F.lit(0)}).repartition(4)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == plain_audit(rows)


def test_audit_ranks_and_empty_tables(spark):
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"), "en", "x") for i in range(3)]
    rows += [(9, "aa zz zz zz zz", "en", "y")]
    got = sorted(map(tuple, source_audit.audit(helpers.documents(spark, rows)).collect()))
    assert got == plain_audit(rows) and sum(r[2] == "term" and r[1] == "x" for r in got) == 200
    assert source_audit.audit(helpers.documents(spark, [])).collect() == []


def test_shares_beyond_64_bits():
    n = np.array([0, 5, 10**12, 3 * 10**13 - 1])
    total = np.array([3 * 10**13])
    assert source_audit._share(n, total).tolist() == [1 + 10**9 * (x + 1) // (3 * 10**13) for x in n.tolist()]


# ---- packing


def test_words_are_encoded_as_whole_texts_are():
    rng = random.Random(1)
    plain, own = Tokenizer.from_file(VOCABULARY), packing.Vocabulary(open(VOCABULARY, "rb").read())
    letters = "abzAZ'stmdrevlSTREVL019 \t\n\r\x0b.,<|>é̱́hHßİKſ   \u0085漢😀\x00\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b <|EndOfText|>", "", " \n", "x" * 5000, "it's don't we'll 'tis ''s '5's"]
    assert own.split
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    other = packing.Vocabulary(open(str(public_tokenizers.path("byte_bpe_50k.json")), "rb").read())
    assert not other.split


@pytest.mark.parametrize("totals", [[5000, 3000, 1, 700, 20], [1], [4096], [3], [100] * 30 + [7], [10**6, 2]])
def test_rounds_by_counters(totals):
    """Places are those that counters give which are served round by round."""
    rng, size = random.Random(2), 64
    rounds = packing.Rounds(totals, size)
    counter, left, stream = [0] * len(totals), list(totals), []
    while any(left):
        for k in range(len(totals)):
            counter[k] += rounds.quanta[k]
            whole = min(left[k], counter[k] >> rounds.shift)
            counter[k] -= whole << rounds.shift
            stream += [(k, totals[k] - left[k] + i) for i in range(whole)]
            left[k] -= whole
    got = [None] * len(stream)
    for k, n in enumerate(totals):
        cuts = sorted({0, n, *[rng.randrange(n) for _ in range(5)]})
        lo, many = np.array(cuts[:-1]), np.diff(cuts)
        for doc, start, length, sequence, offset in zip(*rounds.pieces(np.full(len(lo), k), lo, many)):
            at = int(rounds.start(np.array([sequence]))[0]) + offset
            for i in range(length):
                assert got[at + i] is None
                got[at + i] = (k, int(lo[doc] + start + i))
    assert got == stream
    for w in range(min(500, sum(totals) // size)):
        have = Counter(k for k, _ in stream[w * size : w * size + size])
        assert all(abs(have[k] - size * n / sum(totals)) <= len(totals) + 2 for k, n in enumerate(totals))


def checked(rows, docs, size):
    """Whether pieces tile documents and sequences and carry the right ids; the tokens of each sequence by source."""
    plain, texts = Tokenizer.from_file(VOCABULARY), Counter((r[0], r[1], r[3]) for r in docs)
    packed = defaultdict(list)
    for r in rows:
        packed[r["_sequence"]].append(r)
    tokens = {k: [*plain.encode(k[1] or "", add_special_tokens=False).ids, 1] for k in texts}
    want, got = Counter(), Counter()
    for (i, text, source), n in texts.items():
        for t in range(len(tokens[i, text, source])):
            want[i, t, tokens[i, text, source][t]] += n
    for r in rows:
        assert r["_length"] == len(r["_ids"]) > 0
        assert zlib.crc32(np.array(r["_ids"], "<u4").tobytes()) == r["_ids_crc32"]
        got.update((r["doc_id"], r["_start"] + t, x) for t, x in enumerate(r["_ids"]))
    assert got == want
    assert sorted(packed) == list(range(len(packed)))
    for pieces in packed.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["_offset"]):
            assert r["_offset"] == at
            at += r["_length"]
        assert at == size or at < size and at & (at - 1) == 0
    return packed


@pytest.mark.parametrize("most", [1024, 3])
def test_packing_by_round_trip(spark, most):
    rng = random.Random(3)
    rows = [(i, helpers.sentence(i, rng.randrange(1, 150)), "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(90)]
    rows = helpers.awkward(rows) + [(1, "repeated id", "en", "s1"), (0, rows[0][1], "en", "hot"), (95, "rare", "en", "rare")]
    docs = helpers.documents(spark, rows).withColumns({"_length": F.lit("x"), "_n": F.lit(1), "kind": F.col("source")}).repartition(6)
    found = packing.pack(docs, VOCABULARY, size=128, with_ids=True, most=most)
    assert found.columns == ["doc_id", "lang", "n_chars", "_n", "kind", *packing._NEW, "_ids"]
    got = found.collect()
    packed = checked(got, rows, 128)
    every = sum(r["_length"] for r in got)
    assert sum(sum(r["_length"] for r in p) < 128 for p in packed.values()) <= 7
    total = Counter()
    for r in got:
        total[r["kind"]] += r["_length"]
    large = [k for k, n in total.most_common(2 if most == 3 else 100)]
    for p in packed.values():
        if sum(r["_length"] for r in p) == 128:
            have = Counter()
            for r in p:
                have[r["kind"]] += r["_length"]
            assert all(abs(have[k] - 128 * total[k] / every) <= min(len(total), most) + 2 for k in large)
    whole = packing.sequences(found, 128, 7).collect()
    for r in whole:
        n = r["_tokens"]
        assert len(r["_ids"]) == (n if n & (n - 1) == 0 else 128) and set(r["_ids"][n:]) <= {7}
        assert r["_ids"][:n] == [x for q in sorted(packed[r["_sequence"]], key=lambda q: q["_offset"]) for x in q["_ids"]]


def test_packing_by_joined_queues_and_nothing(spark, monkeypatch):
    """Too many sources and parts for a broadcast go by a join; an empty table gives nothing."""
    docs = helpers.documents(spark, [(i, helpers.sentence(i, 40), "en", f"s{i % 4}") for i in range(40)]).repartition(4)
    want = sorted(map(tuple, packing.pack(docs, VOCABULARY, size=256).collect()))
    monkeypatch.setattr(packing, "checked_broadcast", lambda df: df)
    assert sorted(map(tuple, packing.pack(docs, VOCABULARY, size=256).collect())) == want
    assert packing.pack(helpers.documents(spark, []), VOCABULARY).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are missing")
def test_registered_packing(spark):
    found = QUERIES["op13_mixture_packing"](spark, FOLDER)
    assert dict(found.dtypes) == {k: "bigint" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    plain = Tokenizer.from_file(VOCABULARY)
    docs = {r["doc_id"]: np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    own, packed = defaultdict(list), defaultdict(list)
    for r in found.collect():
        assert r["doc_tokens"] == len(docs[r["doc_id"]])
        assert zlib.crc32(docs[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        own[r["doc_id"]].append((r["start"], r["length"]))
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, end in [(own[i], len(d)) for i, d in docs.items()] + [(p, None) for p in packed.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end or end is None and at <= 2048 and at & (at - 1) == 0
