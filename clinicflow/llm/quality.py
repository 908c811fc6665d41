"""Document quality by hierarchical empirical Bayes.

A document's score joins two things: what its text says (a classifier's log-likelihood ratio), and
what is known of the place it comes from. Places are hosts and paths below them. The rate of good
documents of a host is shrunk toward the global rate, that of a path toward its host's, the more
the fewer labels it has; how strongly is estimated from the spread between the groups. All of it is
grouped aggregation; texts are read once for learning and once for scoring and never shuffled.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.shared import fold, text_of

# Signals are cut into so many bins; a bin's ratio is smoothed by SMOOTH documents of each class.
BINS, SMOOTH = 20, 2.0
# Correlated signals say the same thing more than once.
DAMPING = 0.7
# The weight of a prior, in documents, is kept between these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1_000.0
THRESHOLD = 0.5


def signals(text: Column) -> dict[str, Column]:
    """Numbers from 0 to 1 that tell prose from junk; all 0 for an empty text."""
    size = F.length(text)
    words = F.split(F.trim(text), r"\s+")
    n_words = F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(0.0)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "distinct": share(F.size(F.array_distinct(words)), n_words),
        "signs": share(count(r"[^\p{L}\p{N}\s.,]"), size),
        "upper": share(count(r"\p{Lu}"), size),
        "digits": share(count(r"[0-9]"), size),
        "bars": share(count(r"\|"), n_words),
        "stops": share(count(r"[.?!]"), n_words),
        "words": F.least(F.log10(n_words + 1) / 6, F.lit(1.0)),
        "length": share(size / F.greatest(n_words, F.lit(1)), F.lit(20)),
    }


NAMES = ("distinct", "signs", "upper", "digits", "bars", "stops", "words", "length")


def _bins(docs: DataFrame, text: str, *kept: str) -> DataFrame:
    """The kept columns and one bin number per signal. Small shares get finer bins."""
    found = signals(F.col("_text"))
    rows = docs.select(*kept, text_of(text).alias("_text"))
    return rows.select(
        *kept, *(F.least(F.floor(F.sqrt(found[name]) * BINS), F.lit(BINS - 1)).cast("int").alias(name) for name in NAMES)
    )


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence, host_rate, path_rate.

    Learns from labelled rows (doc_id, quality 0 or 1) whose crc32 of the id modulo 3 is not 1; of
    repeated labels of an id the higher counts, other labels and null ids are passed over. `path` is a
    column for the place below the host. Null hosts and paths are groups of their own. Without
    labels every score is one half. Repeated rows are judged alike; null texts count as empty.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & (fold("doc_id") != 1))
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(F.max("quality").cast("double").alias("good"))
    )
    docs = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
    )
    rows = _bins(docs, "text", "doc_id", "host", "path")
    learnt = rows.join(known, F.col("doc_id") == F.col("_labelled"))

    # Document evidence: the log-ratio of each bin between good and bad documents.
    bins = learnt.select("good", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("bin")) for n in NAMES))).alias("s"))
    by_bin = bins.groupBy("s.signal", "s.bin").agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    # At most BINS rows for each signal come to the driver.
    found = by_bin.collect()
    n_good = sum(r.n_good for r in found if r.signal == NAMES[0])
    n_bad = sum(r.n_bad for r in found if r.signal == NAMES[0])
    evidence = F.lit(0.0)
    if n_good and n_bad:
        for name in NAMES:
            ratios = [0.0] * BINS
            for r in found:
                if r.signal == name:
                    good = (r.n_good + SMOOTH) / (n_good + SMOOTH * BINS)
                    bad = (r.n_bad + SMOOTH) / (n_bad + SMOOTH * BINS)
                    ratios[r.bin] = log(good / bad)
            evidence = evidence + F.element_at(F.array(*map(F.lit, ratios)), F.col(name) + 1)
    evidence = evidence * DAMPING

    # Places: counts by path, summed up to hosts and to everything.
    paths = learnt.groupBy("host", "path").agg(F.sum("good").alias("k"), F.count(F.lit(1)).alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("host_k"), F.sum("n").alias("host_n"))
    total = (n_good + 1) / (n_good + n_bad + 2)
    weight = _weight(hosts.select(F.col("host_k").alias("k"), F.col("host_n").alias("n"), F.lit(total).alias("prior")))
    hosts = hosts.withColumn("host_rate", (F.col("host_k") + weight * total) / (F.col("host_n") + weight))
    nested = paths.join(hosts.select("host", "host_rate"), "host")
    inner = _weight(nested.select("k", "n", F.col("host_rate").alias("prior")))
    nested = nested.select(
        "host", "path", ((F.col("k") + inner * F.col("host_rate")) / (F.col("n") + inner)).alias("path_rate")
    )
    placed = (
        rows.select("doc_id", "host", "path", evidence.alias("evidence"))
        .join(hosts.select("host", "host_rate"), "host", "left")
        .join(nested, ["host", "path"], "left")
        .withColumn("host_rate", F.coalesce("host_rate", F.lit(total)))
        .withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    )
    score = 1 / (1 + F.exp(-(_logit(F.col("path_rate")) + F.col("evidence"))))
    return placed.select(
        "doc_id",
        (fold("doc_id") == 1).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        "evidence",
        "host_rate",
        "path_rate",
    )


def _weight(groups: DataFrame) -> float:
    """How many documents a prior weighs, from groups with k good of n and their prior rate.

    The method of moments: the spread of the groups' rates beyond what chance gives says how much
    groups differ; the prior weighs much if they hardly do.
    """
    p = F.col("prior")
    own = F.pow(F.col("k") / F.col("n") - p, 2) * F.col("n")
    r = groups.agg(
        F.sum(own).alias("spread"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum((F.col("n") - 1) * p * (1 - p)).alias("room"),
    ).first()
    if not r.room or r.spread is None:
        return MOST_WEIGHT
    # spread = sum of p (1 - p) (1 + (n - 1) rho), rho = 1 / (weight + 1)
    rho = max(0.0, (r.spread - r.chance) / r.room)
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / rho - 1)) if rho > 0 else MOST_WEIGHT
