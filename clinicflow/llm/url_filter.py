"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules of host and path decide the URLs they fit. The others are judged by Spark's gradient-boosted
trees, which learn from labelled URLs: length, depth, digit ratio, entropy, parameter counts and
how often suffixes of the host were blocked. Labels may be given, or come from a list of words
in hosts. Everything is DataFrame expressions and Spark ML; no URL leaves the executors.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight, in URLs, of the overall rate in the rate of a suffix.
PRIOR = 10.0
# Words of hosts that label a URL as one to block, for `labelled_by_words`.
WORDS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 11
# Probability from which on a URL without a rule is blocked.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and how the path must start."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "symbols", "entropy",
    "host_entropy", "parameters", "value_length",
)
SUFFIXES = ("top", "domain")
FEATURES = (*LEXICAL, *(f"{s}_rate" for s in SUFFIXES))


def features(rows: DataFrame) -> DataFrame:
    """Rows with _url, _host and _path, and their lexical features and suffixes."""
    url, host, path = F.coalesce("_url", F.lit("")), F.col("_host"), F.col("_path")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    length = F.length(url).cast("double")
    top = F.regexp_extract(host, r"([^.]*)$", 1)
    domain = F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)
    return rows.withColumns(
        {
            "url_length": length,
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": _count(path, "/[^/]"),
            "labels": _count(host, "[^.]+"),
            "digit_ratio": F.when(length > 0, _count(url, "[0-9]") / length).otherwise(0.0),
            "hyphens": _count(host, "-"),
            "symbols": _count(url, "[^A-Za-z0-9]"),
            "entropy": _entropy(url),
            "host_entropy": _entropy(host),
            "parameters": _count(query, "[^&]+"),
            "value_length": F.length(query).cast("double"),
            "top": top,
            "domain": domain,
        }
    )


def labelled_by_words(pages: DataFrame, url: str = "url", words: tuple[str, ...] = WORDS) -> DataFrame:
    """url and label of every page: 1 if a part of its host, cut at dots and hyphens, is a listed word."""
    host, _ = parts(F.col(url))
    found = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))
    return pages.select(F.col(url).alias("url"), found.cast("int").alias("label"))


class Filter:
    """A fitted model. Without blocked or without allowed URLs to learn from it always says the other."""

    def __init__(self, labelled: DataFrame):
        """`labelled`: _url, _host, _path and _label (1 to block, 0 to allow)."""
        self.share = labelled.agg(F.avg("_label")).first()[0]
        if self.share in (None, 0.0, 1.0):
            return
        rows = features(labelled)
        self.counts = {
            s: rows.groupBy(s).agg(F.sum("_label").alias(f"{s}_blocked"), F.count(F.lit(1)).alias(f"{s}_seen"))
            for s in SUFFIXES
        }
        # In training a URL's own label is left out of the rates of its suffixes.
        trained = self._with_rates(rows, F.col("_label"), 1)
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        trees = GBTClassifier(
            featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED
        )
        self.model = trees.fit(self.assembler.transform(trained).select("_features", F.col("_label").cast("double")))
        self.model.setFeaturesCol("_features")

    def _with_rates(self, rows: DataFrame, own_label: Column, own: int) -> DataFrame:
        for s in SUFFIXES:
            rows = rows.join(self.counts[s], s, "left")
            seen = F.coalesce(f"{s}_seen", F.lit(own)) - own
            blocked = F.coalesce(f"{s}_blocked", own_label) - own_label
            rows = rows.withColumn(f"{s}_rate", (blocked + PRIOR * self.share) / (seen + PRIOR))
        return rows

    def probability(self, rows: DataFrame) -> DataFrame:
        """The rows with _p, the probability that a URL is to be blocked."""
        columns = rows.columns
        if self.share in (None, 0.0, 1.0):
            return rows.withColumn("_p", F.lit(float(self.share or 0)))
        ready = self.assembler.transform(self._with_rates(features(rows), F.lit(0), 0))
        return self.model.transform(ready).select(*columns, vector_to_array("probability")[1].alias("_p"))


def judge(
    pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, probability (null where a rule decides).

    `labelled` has url and label (1 to block, 0 to allow) to learn from, all of them; without it
    `labelled_by_words` labels the pages. The longest rule wins, of equally long ones the last by
    name. Null URLs and URLs without :// have an empty host and path, fit no rule and are judged
    by the model. Rows are judged alone; null ids and repeated rows stay; other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    host, path = parts(F.col("_url"))
    rows = rows.withColumns({"_host": host, "_path": path})
    name, verdict = ruled(rules, F.col("_host"), F.col("_path"))
    rows = rows.withColumns({"_rule": name, "_ruled": verdict})
    if labelled is None:
        labelled = labelled_by_words(pages, url)
    known = labelled.select(F.col("url").alias("_url"), F.col("label").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1)).withColumns({"_host": host, "_path": path})
    model = Filter(known.select("_url", "_host", "_path", "_label"))
    judged = model.probability(rows)
    free = F.col("_rule").isNull()
    return judged.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.when(~free, F.col("_ruled")).otherwise(F.when(F.col("_p") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"),
        F.when(free, F.col("_p")).alias("probability"),
    )
