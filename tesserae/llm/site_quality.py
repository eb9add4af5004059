"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression on rates of a text (marks, capitals, digits, repeated words and lines, length) gives each document
a probability p of good quality. It is fitted on labelled rows, at most ``MOST_LABELLED`` of them (those of least hash).

The p of all documents of a path (first segment of the url's path, under its host) and of a host are pooled by grouped
aggregation. A host's mean is shrunk toward the global mean, a path's toward its host's posterior; how strongly follows
from the variance within and between groups (empirical Bayes by moments), so a sparse site stays near its prior. A
document's own p is taken out of its path's pool. The odds of p, times the odds of the path's posterior over the global
odds, give the score; it is kept from ``THRESHOLD`` on.

Documents without a url have their source as host; without a source too, they share one site. Paths of one document
have the host's posterior. Null and empty texts have p from their zero rates. Labels that are null or without a document
are not learnt from; without both labels p is 0.5. Rows that repeat a doc_id each count and each get a row; of several
urls of a doc_id the least is taken. Very long texts are measured whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import shield, stage
from tesserae.llm.quality_rules import measure
from tesserae.llm.url_filter import host_of, path_of

MOST_LABELLED = 20_000
THRESHOLD = 0.5
SALTS = 32
LEAST_STRENGTH = 1.0
_INPUTS = ["_marks", "_capitals", "_digits", "_repeats", "_doubled", "_symbols", "_length", "_word"]


def _rates(df: DataFrame) -> DataFrame:
    words, size = F.greatest(F.lit(1), F.col("_n_words")), F.greatest(F.lit(1), F.col("_n_bytes"))
    return df.withColumns(
        {
            "_marks": F.sqrt(F.col("_n_marks") / size),
            "_capitals": F.sqrt(F.col("_n_upper") / size),
            "_digits": F.sqrt(F.col("_n_digits") / size),
            "_repeats": F.sqrt(F.col("_n_repeat_words") / words),
            "_doubled": F.log1p(F.col("_n_dup_lines").cast("double")),
            "_symbols": F.sqrt(F.col("_n_symbols") / words),
            "_length": F.log1p(F.col("_n_words").cast("double")),
            "_word": F.col("_n_bytes") / words,
        }
    )


def document_evidence(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", *keep: str) -> DataFrame:
    """``keep`` columns (``doc_id`` among them) and ``_p`` of every whole text."""
    measured = stage(_rates(measure(docs, None, text, *keep)).select(*keep, *_INPUTS), "site-rates")
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MOST_LABELLED)
    )
    assembler = VectorAssembler(inputCols=_INPUTS, outputCol="_features")
    rows = stage(measured.select("doc_id", *_INPUTS).join(F.broadcast(chosen), "doc_id"), "site-sample")
    if rows.select("label").distinct().count() < 2:
        return measured.select(*keep, F.lit(0.5).alias("_p"))
    fitted = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.001, maxIter=50).fit(
        assembler.transform(rows)
    )
    fitted = fitted.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("")
    scored = fitted.setPredictionCol("").transform(assembler.transform(measured))
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), vector_to_array("_probability")[1]))
    return scored.select(*keep, F.round(p, 6).alias("_p"))


def _strength(groups: DataFrame, n: str, s: str, q: str, prior: Column | None = None) -> tuple[float, float]:
    """Mean of all, and how many documents the prior weighs: variance within over variance between groups, but one
    document at least, as groups of one document have no variance within."""
    total = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s")).first()
    if not total["n"]:
        return 0.5, 1.0
    mean = total["s"] / total["n"]
    prior = F.lit(mean) if prior is None else prior
    x = groups.agg(
        F.count("*").alias("groups"),
        F.sum(F.col(q) - F.col(s) * F.col(s) / F.col(n)).alias("within"),
        F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)).alias("between"),
        F.sum(F.col(n) * F.col(n)).alias("squares"),
    ).first()
    within = max(x["within"], 1e-9) / max(total["n"] - x["groups"], 1)
    spread = (x["between"] - (x["groups"] - 1) * within) / max(total["n"] - x["squares"] / total["n"], 1.0)
    return mean, min(1e6, max(LEAST_STRENGTH, within / max(spread, within / 1e6)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def combine(evidence: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows with ``_host``, ``_path`` and ``_p`` get ``_host_mean``, ``_path_mean``, ``_score`` and ``_kept``; their other
    columns may have any names but these."""
    inside, name, back = shield(evidence)
    evidence = inside.withColumns({c: F.col(name(c)) for c in ("_host", "_path", "_p")})
    paths = stage(
        evidence.groupBy("_host", "_path").agg(
            F.count("*").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")
        ),
        "site-paths",
    )
    hosts = stage(paths.groupBy("_host").agg(*[F.sum(c).alias(f"h{c}") for c in "nsq"]), "site-hosts")
    mean, of_host = _strength(hosts, "hn", "hs", "hq")
    host_mean = (F.col("hs") + of_host * mean) / (F.col("hn") + of_host)
    nested = stage(paths.join(hosts.select("_host", host_mean.alias("_host_mean")), "_host"), "site-nested")
    _, of_path = _strength(nested, "n", "s", "q", F.col("_host_mean"))
    # each path's row goes to every salt, so that the documents of a hot site are spread
    sites = nested.select("_host", "_path", "n", "s", "_host_mean").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    dealt = evidence.withColumn("_salt", F.pmod(F.xxhash64(name(doc_id)), F.lit(SALTS)).cast("int"))
    found = dealt.join(sites, ["_host", "_path", "_salt"])
    own = (F.col("s") - F.col("_p") + of_path * F.col("_host_mean")) / (F.col("n") - 1 + of_path)
    own = F.greatest(F.lit(0.001), F.least(F.lit(0.999), own))
    odds = _logit(F.col("_p")) + _logit(own) - _logit(F.lit(min(0.999, max(0.001, mean))))
    scored = found.withColumns({"_path_mean": own, "_score": 1 / (1 + F.exp(-odds))}).withColumn("_kept", F.col("_score") >= THRESHOLD)
    return back(scored, new=["_host_mean", "_path_mean", "_score", "_kept"])


def site_of(docs: DataFrame, pages: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``docs`` (doc_id, source, ...) with ``_host`` and ``_path``."""
    urls = pages.filter(F.col(page_id).isNotNull()).groupBy(F.col(page_id).alias("doc_id")).agg(F.min(url).alias("_url"))
    host = F.nullif(host_of(F.col("_url")), F.lit(""))
    return (
        docs.join(urls, "doc_id", "left")
        .withColumns(
            {
                "_host": F.coalesce(host, F.col("source"), F.lit("")),
                "_path": F.when(host.isNotNull(), F.regexp_extract(path_of(F.col("_url")), "^(/[^/]*)", 1)).otherwise(""),
            }
        )
        .drop("_url")
    )
