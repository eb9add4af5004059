"""URL filter: logistic regression on hashed character n-grams of host and path, under explicit rules.

All of it is DataFrame functions and Spark ML. The model is trained from a small labelled table of host and path; the
built-in one is ``LABELLED``, and another of at most ``MOST_LABELLED`` rows can be given. A url is then one map-only
pass: host and path are cut out, character n-grams are hashed to ``FEATURES`` slots and scored.

Rules come first. A rule such as ``block example.com/en/`` fits its host and all subdomains where the path starts with
the rule's path; the longest rule that fits decides (of equally long ones the one with the longer host, then block).
Up to ``INLINE_RULES`` rules are part of the expression; more are joined on the suffixes of the host.

A very long url is scored whole. A url that is null or has no ``://`` has empty host and path; it matches no rule and the model sees no n-gram.
Repeated rows each give their own row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import shield

FEATURES = 1 << 14
WIDTHS = (3, 4, 5)
MOST_LABELLED = 20_000
INLINE_RULES = 1_000
THRESHOLD = 0.5

#: Words of the small labelled table: those that are common in the names of unwanted sites (games of chance, adult, drugs, theft
#: of software and data, mass mail and tracking, promises of money), those of other sites, and what stands beside either.
UNWANTED = (
    "casino poker roulette slots jackpot gambling bookmaker betting bets lottery wager blackjack "
    "porn sex xxx adult escort hentai nude erotic webcam fetish strip "
    "viagra cialis pills steroids weightloss dietpill botox "
    "warez crack keygen torrent malware phishing spyware trojan exploit botnet hacked "
    "spam bulkmail doorway clickbait popup ads adserver tracker tracking "
    "payday loans doubler forex getrich earnfast ponzi counterfeit replica fakeid cheap free win prize claim bonus giveaway"
).split()
WANTED = (
    "news library garden weather museum history school university recipes kitchen cycling farmers winery travel railway hospital "
    "pharmacology science data council bookshop poetry orchestra painting chess football architecture photography linguistics "
    "astronomy philosophy carpentry theatre translation geology forest river bridge castle church village market bakery "
    "physics chemistry biology medicine nursing law justice parliament statistics economics energy engine bicycle tractor airport "
    "ferry hotel campsite hiking climbing sailing swimming tennis rugby cricket dance opera film radio magazine journal "
    "encyclopedia dictionary grammar spelling archive gallery sculpture pottery weaving knitting sewing furniture lighting plumbing "
    "insulation masonry gardening botany zoology ornithology fishery dairy orchard vineyard cookbook restaurant cafe teahouse"
).split()
BESIDE = "club center world online zone hub portal today home group place plus room house point line street park".split()
PLAIN = [("", "/fr/31"), ("www.", "/en/4"), ("m.", "/es/55"), ("", "/de/7")]


def labelled() -> list[tuple[str, str, int]]:
    """Rows of host, path, 1 for unwanted: invented hosts under ``.test``, each word alone, beside others, and in the path of a
    host without it. First labels of hosts and plain paths go with the place of a row, not with the word's kind, so they tell
    nothing. Wanted words have twice the rows, so a name without any known part is allowed, and few chance parts aren't
    enough to block one."""
    rows = []
    for words, label, rounds in ((UNWANTED, 1, 1), (WANTED, 0, 2)):
        for i, word in enumerate(words):
            for r in range(rounds):
                one, two = BESIDE[(i + 5 * r) % len(BESIDE)], BESIDE[(7 * i + 5 + 3 * r) % len(BESIDE)]
                names = (f"{word}{one}" if r else word, f"{word}-{one}", f"{two}{word}", f"{two}-{word}")
                rows += [(f"{first}{name}.test", path, label) for (first, path), name in zip(PLAIN, names, strict=True)]
                rows.append((f"blog.{two}-{one}.test", f"/{word}/", label))
    return rows


#: The small labelled table.
LABELLED = labelled()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its side; the ends of the host are marked too."""

    def of(text: Column, mark: str, width: int) -> Column:
        last = F.length(text) - (width - 1)
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(width)))),
        ).otherwise(F.array().cast("array<string>"))

    marked = F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.concat(*[of(marked, "h", w) for w in WIDTHS], *[of(path, "p", w) for w in WIDTHS])


def _vectors(df: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashing.transform(df.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def train(spark: SparkSession, labelled: DataFrame | None = None) -> LogisticRegressionModel:
    """Fit on rows (host, path, label); at most ``MOST_LABELLED`` of them, those of least hash if there are more."""
    if labelled is None:
        labelled = spark.createDataFrame(LABELLED, "host string, path string, label int")
    rows = labelled.select(
        F.coalesce("host", F.lit("")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), "label"
    ).filter("label is not null")
    rows = rows.orderBy(F.xxhash64("_host", "_path"), "_host", "_path").limit(MOST_LABELLED)
    vectors = _vectors(rows).select("_features", F.col("label").cast("double").alias("label"))
    return LogisticRegression(
        featuresCol="_features", labelCol="label", regParam=0.01, maxIter=60, standardization=False
    ).fit(vectors)


def _fits(host: Column, path: Column, rule_host: Column | str, rule_path: Column | str) -> Column:
    rule_host = F.lit(rule_host) if isinstance(rule_host, str) else rule_host
    rule_path = F.lit(rule_path) if isinstance(rule_path, str) else rule_path
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def apply_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add ``_rule`` and ``_rule_verdict``, null where no rule fits. ``rules``: (allow or block, host/path)."""
    ordered = sorted(
        {(verdict, rule) for verdict, rule in rules},
        key=lambda x: (-len(x[1]), -len(_split(x[1])[0]), x[0] != "block", x[1]),
    )
    host, path = F.col("_host"), F.col("_path")
    if len(ordered) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for v, r in reversed(ordered):
            fits = _fits(host, path, *_split(r))
            rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return df.withColumns({"_rule": rule, "_rule_verdict": verdict})
    table = df.sparkSession.createDataFrame(
        [(*_split(r), r, v, i) for i, (v, r) in enumerate(ordered)],
        "_at string, _prefix string, _rule string, _rule_verdict string, _order int",
    )
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = df.select("_host", "_path").distinct()
    best = (
        pairs.withColumn("_at", F.explode(suffixes))
        .join(table, "_at")
        .filter(F.startswith("_path", "_prefix"))
        .groupBy("_host", "_path")
        .agg(F.min_by(F.struct("_rule", "_rule_verdict"), "_order").alias("_best"))
        .select("_host", "_path", "_best.*")
    )
    return df.join(best, ["_host", "_path"], "left")


def filter_urls(
    urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", model: LogisticRegressionModel | None = None
) -> DataFrame:
    """``urls`` (columns of these names are replaced) with ``_host``, ``_path``, ``_rule``, ``_score`` (of being unwanted) and ``_verdict``."""
    inside, name, back = shield(urls)
    url = name(url)
    model = model or train(urls.sparkSession)
    cut = apply_rules(inside.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))}), rules)
    model = model.setFeaturesCol("_features").setProbabilityCol("_probability")
    model = model.setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(_vectors(cut)).withColumn("_score", vector_to_array("_probability")[1])
    judged = scored.withColumn(
        "_verdict",
        F.coalesce("_rule_verdict", F.when(F.col("_score") >= THRESHOLD, "block").otherwise("allow")),
    )
    return back(judged, new=["_host", "_path", "_rule", "_score", "_verdict"])
