"""Toxicity scores from bags of subwords.

A word is the bag of its character n-grams and itself, each hashed to a row of an embedding
table; a text is the average of its words, and a linear softmax over that average gives the score.
Table and softmax are trained together in numpy, so a misspelling never seen in training shares
the vectors of the n-grams it has in common with words that were.

Training uses a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN, chosen by a
hash of the id). Scoring is one pass over all whole texts without a shuffle: averaging and the
softmax are linear, so every word has one number, and a text the mean of its words' numbers.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.arrays import texts_of
from clinicflow.llm.shared import fold, give_back, held, text_of, whole

# Labelled documents of each kind that the model is fitted on, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 3_000
SAMPLE_PARTS = 12
BUCKETS, DIMENSIONS = 1 << 18, 4
SHORTEST, LONGEST = 3, 5
# A subword must occur in so many texts of the sample to have a vector.
LEAST_TEXTS = 5
NEUTRAL = 5
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 0.05, 1e-5, 7
# Score from which on a text is predicted toxic.
THRESHOLD = 0.7

WORD = re.compile(r"\w+")
WORDS, WORD_CHARS = 300_000, 80


def subwords(word: str) -> list[int]:
    """The table rows of a word: itself and its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode()) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        out += [zlib.crc32(marked[k : k + n].encode()) % BUCKETS for k in range(len(marked) - n + 1)]
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of a text: the average over its words of the average over their subwords.

    A word that comes n times weighs sqrt(n), and NEUTRAL words without a vector are averaged in,
    so that neither one repeated word nor a text of three words decides by itself.
    """
    counts = Counter(WORD.findall(text.lower()))
    rows, weights = [], []
    for word, count in counts.items():
        own = subwords(word)
        rows += own
        weights += [count**0.5 / len(own)] * len(own)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, place = np.unique(np.array(rows), return_inverse=True)
    return distinct, np.bincount(place, weights) / (sum(c**0.5 for c in counts.values()) + NEUTRAL)


@dataclass
class Model:
    """One number per subword and a bias: the difference of the two softmax inputs."""

    values: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.values[subwords(word)].mean())


class WordScores(dict):
    """Scores of words, computed when first asked for; starts anew beyond WORDS."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        value = self.model.word(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = value
        return value


def train(rows: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit table and softmax together by Adam on the cross-entropy, both classes weighted alike.

    With labels of one kind only, every text gets the share of that kind; with none, score 0.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 40.0 if share else -40.0)
    texts = np.zeros(BUCKETS, np.int64)
    for own in rows:
        texts[own] += 1
    common = texts >= LEAST_TEXTS
    for k, own in enumerate(rows):
        rows[k], weights[k] = own[common[own]], weights[k][common[own]]
    random = np.random.default_rng(SEED)
    table = np.where(common[:, None], random.normal(0, 0.1, (BUCKETS, DIMENSIONS)), 0)
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, bias)]
    weight_of = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            at = np.concatenate([rows[i] for i in chosen]).astype(np.int64)
            share_of = np.concatenate([weights[i] for i in chosen])
            text = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            used, place = np.unique(at, return_inverse=True)
            mean = np.stack(
                [np.bincount(text, share_of * table[at, d], len(chosen)) for d in range(DIMENSIONS)], axis=1
            )
            logits = mean @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= (weight_of[chosen] / len(chosen))[:, None]
            back = p @ softmax.T
            grad = np.stack(
                [np.bincount(place, share_of * back[text, d], len(used)) for d in range(DIMENSIONS)], axis=1
            )
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            # Only the table rows that the batch uses move.
            for (first, second), parameter, gradient, where in zip(
                state, (table, softmax, bias), (grad, mean.T @ p, p.sum(axis=0)), (used, ..., ...), strict=True
            ):
                g = gradient + DECAY * parameter[where]
                first[where] = 0.9 * first[where] + 0.1 * g
                second[where] = 0.999 * second[where] + 0.001 * g * g
                parameter[where] -= rate * first[where] / (np.sqrt(second[where]) + 1e-8)
    difference = softmax[:, 1] - softmax[:, 0]
    return Model(table @ difference, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id") != 1))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    chosen = None
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.filter(F.col("_toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows of an id and a label are broadcast.
    texts = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").cast(pa.string()),
                    batch.column("_toxic"),
                    pa.array([r.astype(np.int32).tobytes() for r, _ in found], pa.binary()),
                    pa.array([w.astype(np.float32).tobytes() for _, w in found], pa.binary()),
                ],
                ["id", "toxic", "rows", "weights"],
            )

    # The sample is of bounded size, so are its parts. One after the other comes to the driver, as
    # packed numbers.
    bags = sample.coalesce(SAMPLE_PARTS).mapInArrow(run, "id string, toxic int, rows binary, weights binary")
    found = [(r.id, r.toxic, bytes(r.rows), bytes(r.weights)) for r in bags.toLocalIterator(prefetchPartitions=True)]
    # Sorted, because the model must not depend on the order of the tasks.
    found.sort(key=lambda bag: bag[0])
    toxic = np.array([bag[1] for bag in found], np.int64)
    rows = [np.frombuffer(bag[2], np.int32) for bag in found]
    weights = [np.frombuffer(bag[3], np.float32) for bag in found]
    del found  # train lets go of rare subwords text by text
    model = train(rows, weights, toxic)
    del rows, weights
    give_back()  # the driver goes on with the model alone
    return model


def average(known: WordScores, text: str) -> float:
    """The average of a text's words, weighted as in training."""
    counts = Counter(WORD.findall(text.lower()))
    shares = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    values = np.fromiter(map(known.__getitem__, counts), float, len(counts))
    return float(shares @ values / (shares.sum() + NEUTRAL))


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """_doc (struct of all columns of `docs`) and _score (0 to 1) of every row.

    A text without words, null and empty ones included, has the score of the bias alone.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = docs.select(whole(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(key, lambda: WordScores(shared.value))
        bias = known.model.bias
        for batch in batches:
            logits = np.empty(batch.num_rows)
            for k, value in enumerate(texts_of(batch, text)):
                logits[k] = average(known, value.as_py() or "") + bias
            score = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(score)], ["_doc", "_score"])

    schema = rows.select("_doc", F.lit(0.0).alias("_score")).schema
    return rows.mapInArrow(run, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled rows (doc_id, toxic 0 or 1) whose crc32 of the id modulo 3 is not 1;
    other labels, null ids and rows of ids without a text are passed over, and of repeated ids the
    higher label counts. held_out is null for a null id. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = scored(docs, fit(docs, labels), "text")
    return rows.select(
        F.col("_doc.doc_id").alias("doc_id"),
        (fold("_doc.doc_id") == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    rows = scored(docs, fit(docs, labels, doc_id, text), text)
    return rows.filter(F.col("_score") < threshold).select("_doc.*")
