"""The registered query of each operator: the operator over its whole table, reduced to the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, jaccard_join, langid, mixing, packing, prefix_trie, quality_rules, site_quality, source_audit, substring_dedup, suffix_tree, toxicity, url_filter


def _read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return common.tuned(spark).read.parquet(f"{folder}/{table}.parquet").select(*columns)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False))
    languages, bundles = langid.prototypes(docs.filter(~held_out))
    found = langid.predict(docs, languages, bundles, "text", "doc_id")
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


#: The rules of the contract.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.filter_urls(_read(spark, folder, "pages", "page_id", "url"), URL_RULES)
    return judged.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
        F.round("_score", 6).alias("score"),
    )


def op3_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text", "lang")
    judged = quality_rules.judge(docs, "text", "lang", "doc_id")
    return judged.select(
        "doc_id",
        *[F.col(f"_{k}").alias(k) for k in quality_rules.BASE],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_perplexity").alias("log10_perplexity"),
    )


def op4_minhash_containment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.find_leaks(docs, _read(spark, folder, "benchmark", "item_id", "text"), "text", "doc_id")
    return found.select(
        "doc_id",
        F.col("_item_id").alias("item_id"),
        F.col("_n_shingles").cast("long").alias("n_shingles"),
        F.col("_n_matched").cast("long").alias("n_matched"),
    )


_OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT item_id, w, least(5, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0
), q AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)
), s AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
)
SELECT s.doc_id, q.item_id, n.n AS n_shingles, count(*) AS n_matched
FROM q JOIN s USING (k, s) JOIN (SELECT item_id, count(*) AS n FROM q GROUP BY item_id) n ON n.item_id = q.item_id
GROUP BY s.doc_id, q.item_id, n.n HAVING 100 * count(*) >= 75 * n.n
"""


def op5_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    held_out = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False))
    labels = _read(spark, folder, "labels", "doc_id", "toxic").filter(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels), "text", "doc_id")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text", "source")
    labels = _read(spark, folder, "labels", "doc_id", "quality")
    evidence = site_quality.document_evidence(docs, labels, "text", "quality", "doc_id", "source")
    placed = common.stage(site_quality.site_of(evidence, _read(spark, folder, "pages", "page_id", "url")), "site-docs")
    return site_quality.combine(placed).select(
        "doc_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_p").alias("document_p"),
        F.round("_host_mean", 6).alias("host_mean"),
        F.round("_path_mean", 6).alias("path_mean"),
        F.round("_score", 6).alias("score"),
        F.col("_kept").alias("kept"),
    )


_OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id
"""


def op7_grouped_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    linked = jaccard_join.link_components(_read(spark, folder, "documents", "doc_id", "text"))
    known = lambda c: F.when(F.col(c) < jaccard_join.NO_ID, F.col(c))
    return linked.select(
        known("_id").alias("doc_id"), F.col("_n_shingles").alias("n_shingles"), known("_component").alias("component_id")
    )


def op8_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("_size"))
    mixed = mixing.mix_sources(common.stage(sized, "mix-documents"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_rate").alias("rate"),
    )


_OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)
), y AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM y WHERE r > 1),
k AS (
  SELECT z.doc_id, string_agg(z.w[z.p], ' ' ORDER BY z.p) AS kept
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) z ANTI JOIN g ON g.doc_id = z.doc_id AND g.p = z.p
  GROUP BY z.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


def op9_super_kmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    return substring_dedup.kept_words(docs).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op10_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    return suffix_tree.score(docs, common.crc_mod("doc_id", 7) == 2)


_OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS donor, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), s AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY o, r) AS d FROM (
    SELECT c, 0 AS o, r, role, text FROM i JOIN t ON t.conv_id = donor AND r <= h
    UNION ALL SELECT c, 1, r, role, text FROM i JOIN t ON t.conv_id = c AND r > h)
), p AS (
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS k, length(text) AS chars FROM s
  UNION ALL SELECT c, 0, [], 0 FROM i
), n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY d, k),
z AS (
  SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM p) WHERE d = last GROUP BY d, k
), b AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
x AS (
  SELECT up AS d, k[1:up] AS k, sum((n_children IS NULL)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(0, n.d + 1)) AS up FROM n LEFT JOIN b ON b.d = n.d AND b.k = n.k) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children,
  CAST(x.n_leaves AS BIGINT) AS n_leaves, CAST(x.saved_tokens AS BIGINT) AS saved_tokens, coalesce(z.digest, sha256('')) AS ends_sha256
FROM n JOIN x ON x.d = n.d AND x.k = n.k LEFT JOIN b ON b.d = n.d AND b.k = n.k LEFT JOIN z ON z.d = n.d AND z.k = n.k
LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]
"""


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


_OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p FROM n JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY 1, 2) JOIN v USING (lang)
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT y.lang, y.source, z.source AS item, sum((y.p - z.p) * (y.p - z.p) // z.p) AS f
    FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY 1, 2, 3
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM x)
WHERE part = 'pair' OR r <= 200
"""


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(_read(spark, folder, "documents", "text", "lang", "source"))


def op13_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text", "source")
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json"))).select(
        "doc_id",
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        F.col("_ids_crc32").alias("ids_crc32"),
        F.col("_doc_tokens").alias("doc_tokens"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_minhash_containment": op4_minhash_containment,
    "op5_ftrl_toxicity": op5_ftrl_toxicity,
    "op6_site_quality": op6_site_quality,
    "op7_grouped_prefix_join": op7_grouped_prefix_join,
    "op8_entropy_mixing": op8_entropy_mixing,
    "op9_super_kmer_dedup": op9_super_kmer_dedup,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_mixture_packing": op13_mixture_packing,
}
ORACLES: dict[str, str] = {
    "op4_minhash_containment": _OP4_SQL,
    "op7_grouped_prefix_join": _OP7_SQL,
    "op9_super_kmer_dedup": _OP9_SQL,
    "op11_prefix_trie": _OP11_SQL,
    "op12_source_divergence": _OP12_SQL,
}
