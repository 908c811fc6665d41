"""Benchmark decontamination with an FM-index per shard of the corpus.

The test phrases (windows of benchmark words) are the query set; every shard of documents is
indexed and searched inside the task that holds it, so nothing of the corpus is shuffled. A
shard is a few MB of texts. Its words are numbered by the benchmark's vocabulary; stretches of
other words, which no phrase can touch, become one separator. A suffix array of these numbers
gives the Burrows-Wheeler transform; a wavelet matrix over it answers ranks; backward search runs
for all phrases at once; sampled suffix positions locate the occurrences. Located words are
compared with the phrase, because words are numbered by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.llm.arrays import Words, slices, text_bytes, texts_of, words
from clinicflow.llm.shared import held, text_of, whole

WINDOW = 13
# A document is contaminated if at least one in SHARE of its words is hit.
SHARE = 20
# Bytes of benchmark text held by a task at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20
# Every so many positions of the indexed text one is kept for locating.
SAMPLE = 8


@dataclass
class Phrases:
    """A block of distinct test phrases, longest last in no particular order."""

    vocabulary: np.ndarray  # sorted hashes of the words
    numbers: np.ndarray  # phrases x longest phrase: word numbers from 1, aligned at the end, 0 before
    lengths: np.ndarray
    texts: list[bytes]  # words joined by a zero byte
    items: list[list[str]]  # the items that have the phrase


def phrases(rows: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """The phrases of benchmark items (item id, text): windows of `window` words, or the whole item."""
    texts = pa.array([text for _, text in rows], pa.string())
    w = words(*text_bytes(texts))
    hashes = w.hashes()
    vocabulary = np.unique(hashes)
    owners: dict[bytes, set[str]] = {}
    where: dict[bytes, tuple[int, int]] = {}
    for k, (item, _) in enumerate(rows):
        begin, end = int(w.first[k]), int(w.first[k + 1])
        size = min(window, end - begin)
        for at in range(begin, end - size + 1) if size else ():
            text = b"\0".join(w.codes[w.starts[i] : w.ends[i]].tobytes() for i in range(at, at + size))
            owners.setdefault(text, set()).add(item)
            where[text] = (at, at + size)
    keys = list(owners)
    lengths = np.array([where[t][1] - where[t][0] for t in keys], np.int64)
    numbers = np.zeros((len(keys), int(lengths.max(initial=1))), np.int64)
    numbered = np.searchsorted(vocabulary, hashes) + 1
    for k, text in enumerate(keys):
        begin, end = where[text]
        numbers[k, numbers.shape[1] - (end - begin) :] = numbered[begin:end]
    return Phrases(vocabulary, numbers, lengths, keys, [sorted(owners[t]) for t in keys])


class FMIndex:
    """Full-text index of a sequence of numbers from 1; 0 is for the end mark."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE):
        text = np.append(sequence, 0)
        order = suffix_order(text)
        self.transform = text[order - 1]
        self.marked = order % sample == 0
        self.samples = order[self.marked]
        self.sampled_before = np.cumsum(self.marked) - self.marked
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        row = self.transform
        for level in reversed(range(self.levels)):
            bit = row >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low = np.zeros_like(upto)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
        return upto - low

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence; patterns are aligned at the end."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.transform))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for back in range(1, patterns.shape[1] + 1):
            symbol = patterns[which, -back]
            known = symbol < len(self.before) - 1
            which, low, high, symbol = which[known], low[known], high[known], symbol[known]
            start = self.before[symbol]
            low, high = start + self.rank(symbol, low), start + self.rank(symbol, high)
            found = low < high
            full = found & (lengths[which] == back)
            done.append((which[full], low[full], high[full]))
            more = found & ~full
            which, low, high = which[more], low[more], high[more]
            if not len(which):
                break
        which, low, high = (np.concatenate(x) for x in zip(*done, strict=True))
        counts = high - low
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
        return np.repeat(which, counts), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk left to a sampled position and count the steps."""
        at, out, open_ = rows.copy(), np.zeros_like(rows), np.arange(len(rows))
        steps = 0
        while len(open_):
            here = self.marked[at]
            out[open_[here]] = self.samples[self.sampled_before[at[here]]] + steps
            at, open_ = at[~here], open_[~here]
            symbol = self.transform[at]
            at = self.before[symbol] + self.rank(symbol, at)
            steps += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose last number is the only smallest, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[:-step or None] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def occurrences(w: Words, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence of a phrase in the words of a shard."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(known.texts) or not len(w.starts):
        return nothing
    hashes = w.hashes()
    place = np.searchsorted(known.vocabulary, hashes)
    place[place == len(known.vocabulary)] = 0
    inside = known.vocabulary[place] == hashes
    # Stretches of known words of one text; shorter ones than the shortest phrase hold none.
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[w.first[:-1][w.first[:-1] < len(inside)]] = True
    opens &= inside
    begin = np.flatnonzero(opens)
    stretch = np.cumsum(opens)[inside] - 1
    length = np.bincount(stretch, minlength=len(begin))
    long = length >= known.lengths.min()
    kept = np.flatnonzero(inside)[long[stretch]] if len(begin) else nothing[0]
    if not len(kept):
        return nothing
    # Numbers from 2 are words; 1 separates stretches.
    firsts = np.flatnonzero(opens[kept])
    sequence = np.insert(place[kept] + 2, firsts, 1)
    origin = np.insert(kept, firsts, -1)
    which, at = FMIndex(sequence).find(np.where(known.numbers > 0, known.numbers + 1, 0), known.lengths)
    first = origin[at]
    right = np.zeros(len(first), bool)
    for k, (phrase, word) in enumerate(zip(which.tolist(), first.tolist(), strict=True)):
        last = word + int(known.lengths[phrase]) - 1
        raw = w.codes[w.starts[word] : w.ends[last]].tobytes()
        right[k] = b"\0".join(filter(None, raw.split(b"\0"))) == known.texts[phrase]
    return which[right], first[right]


def _search(batches: Iterator[pa.RecordBatch], known: Phrases, text: str) -> Iterator[pa.RecordBatch]:
    """Add the hits of one block of phrases to the hits of the blocks before."""
    held(None)
    for batch in slices(batches, text):
        w = words(*text_bytes(texts_of(batch, text)))
        which, first = occurrences(w, known)
        n_rows = batch.num_rows
        spans: list[list[dict]] = batch.column("_hits").to_pylist()
        items: list[list[str]] = batch.column("_items").to_pylist()
        owner = np.searchsorted(w.first, first, "right") - 1
        found: dict[int, tuple[set, set]] = {}
        for row, phrase, word in zip(owner.tolist(), which.tolist(), first.tolist(), strict=True):
            inner = word - int(w.first[row])
            hit, named = found.setdefault(row, (set(), set()))
            hit.add((inner, inner + int(known.lengths[phrase])))
            named.update(known.items[phrase])
        for row, (hit, named) in found.items():
            old = [(x["start"], x["end"]) for x in spans[row]]
            spans[row] = [{"start": a, "end": b} for a, b in merged(sorted([*old, *hit]))]
            items[row] = sorted({*items[row], *named})
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_doc"),
                pa.array(spans, SPANS),
                pa.array(items, pa.list_(pa.string())),
                pa.array(np.diff(w.first) if n_rows else [], pa.int64()),
            ],
            ["_doc", "_hits", "_items", "_n_words"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, window: int) -> DataFrame:
    """_doc (all columns), _hits (spans of words), _items and _n_words of every document."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(
        whole(docs),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("_hits"),
        F.array().cast("array<string>").alias("_items"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("_n_words", T.LongType())])
    for block in range(n_blocks):
        # The blocks are cut by a hash, so that one holds about BLOCK_BYTES of the query set.
        part = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).distinct()
        known = spark.sparkContext.broadcast(
            phrases([(str(r.item), r.text) for r in part.toLocalIterator()], window)
        )
        rows = rows.select("_doc", "_hits", "_items").mapInArrow(
            lambda batches, known=known: _search(batches, known.value, text), schema
        )
    n_hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return rows.withColumn("_n_hit", n_hit).withColumn(
        "_contaminated", (F.col("_n_hit") > 0) & (SHARE * F.col("_n_hit") >= F.col("_n_words"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. A phrase is
    `window` words of a benchmark item in a row, or a whole item that has fewer. Words inside an
    occurrence of a phrase are hit; `spans` (start, end in words, end exclusive) are the merged
    spans to remove, `items` the items that own the phrases. Null texts and items without words
    have no words and no phrases; an empty benchmark hits nothing. Repeated rows are judged
    alike, null ids stay null, other columns are not read. A null item_id counts as "None".
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _hits(docs, benchmark, "text", window)
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
        F.col("_items").alias("items"),
        F.col("_hits").alias("spans"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    found = _hits(docs, benchmark, text, window)
    return found.filter(~F.col("_contaminated")).select("_doc.*")
