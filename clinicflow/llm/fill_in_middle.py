"""Fill-in-middle: texts cut into prefix, middle and suffix at token boundaries, and reordered.

A token is a run of other characters with the white space before it, or white space at the end.
So its end is the last character of a run, and how many tokens end before a place is how many
such characters stand before it. A wavelet matrix over the classes of all bytes of a slice of
texts answers ranks of a class; two ranks together count the boundaries before any place, and two
others the bytes that begin no character. Bisection on the boundary counts finds both cuts of
all texts of the slice at once; the counts of characters come from ranks at the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.arrays import slices, text_bytes
from clinicflow.llm.shared import text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
# Of a hundred texts, how many stay plain, and how many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 50, 80

# Classes of bytes: white space; bytes inside a run, and last bytes of a run, each of them either
# the first byte of a character or a later one.
WHITE, FIRST, LATER, LAST_FIRST, LAST_LATER = range(5)
# Bits between two stored counts.
STEP = 512


class Bits:
    """A row of bits with counts of ones before every STEP-th place."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.packbits(bits, bitorder="little")
        padded = np.concatenate([self.packed, np.zeros(-len(self.packed) % (STEP // 8) + STEP // 8, np.uint8)])
        self.rows = padded.reshape(-1, STEP // 8)
        counts = np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, upto: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        row, rest = np.divmod(upto, STEP)
        whole = np.clip(rest[:, None] - np.arange(0, STEP, 8), 0, 8)
        masks = ((1 << whole) - 1).astype(np.uint8)
        return self.before[row] + np.bitwise_count(self.rows[row] & masks).sum(axis=1, dtype=np.int64)


class WaveletMatrix:
    """Ranks of small numbers in a sequence: one row of bits a level, the highest bit first."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels = levels
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(levels)):
            one = (sequence >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(len(sequence) - int(np.count_nonzero(one)))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank(self, symbol: int, upto: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each place."""
        low = np.zeros(1, np.int64)
        for level, bits, zeros in zip(reversed(range(self.levels)), self.bits, self.zeros, strict=True):
            if symbol >> level & 1:
                low, upto = zeros + bits.rank(low), zeros + bits.rank(upto)
            else:
                low, upto = low - bits.rank(low), upto - bits.rank(upto)
        return upto - low


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that lie side by side; a run never goes beyond its text."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    last = np.ones(len(data), bool)
    last[:-1] = white[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    classes = np.where(last, np.uint8(LAST_FIRST), np.uint8(FIRST)) + ((data & 0xC0) == 0x80)
    classes[white] = WHITE
    return classes


class Cuts:
    """Token counts and places of token ends in texts that lie side by side."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.begin, self.end = offsets[:-1], offsets[1:]
        self.classes = WaveletMatrix(byte_classes(data, offsets), 3)
        self.ended = self.boundaries(self.begin)
        self.runs = self.boundaries(self.end) - self.ended
        # White space at the end of a text is a token without a run.
        filled = self.end > self.begin
        tail = np.zeros(len(self.end), bool)
        closing = data[self.end[filled] - 1]
        tail[filled] = (closing == 0x20) | ((closing >= 0x09) & (closing <= 0x0D))
        self.tokens = self.runs + tail

    def boundaries(self, upto: np.ndarray) -> np.ndarray:
        """The number of runs that end before each place, from the beginning of the slice."""
        return self.classes.rank(LAST_FIRST, upto) + self.classes.rank(LAST_LATER, upto)

    def characters(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of characters from `low` to `high`."""
        later = [self.classes.rank(c, high) - self.classes.rank(c, low) for c in (LATER, LAST_LATER)]
        return high - low - later[0] - later[1]

    def after(self, count: np.ndarray) -> np.ndarray:
        """Where the first `count` tokens of each text end, by bisection on boundary counts."""
        low, high = self.begin.copy(), self.end.copy()
        wanted = self.ended + count
        open_ = np.flatnonzero((count > 0) & (count <= self.runs))
        high[count == 0] = self.begin[count == 0]
        # Of the places with `wanted` boundaries before them, the first.
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            enough = self.boundaries(middle) >= wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
            open_ = open_[low[open_] < high[open_]]
        return high


def restored(output: bytes, form: str) -> bytes:
    """The text again, from the transformed text and its form."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one = output.index(second)
    two = output.index(MIDDLE, one)
    left, right, middle = output[3:one], output[one + 3 : two], output[two + 3 :]
    return left + middle + right if form == "psm" else right + middle + left


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the first groups of the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


FIELDS = {
    "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
    "output": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string(),
}
TYPES = {pa.int64(): "bigint", pa.string(): "string"}


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    fields: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"),
    seed: int = SEED,
    plain: int = PLAIN,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """doc_id and the asked `fields` of every row: n, form, prefix_chars, middle_chars, output and hashes.

    `output` is the text with sentinels, prefix and suffix before the middle (`psm`), suffix
    first (`spm`), or unchanged (`plain`: `plain` of a hundred texts, and those that are empty or
    hold a sentinel). `output_sha256` and `restored_sha256` are hashes of it and of the text
    rebuilt from it. Everything random comes from a hash of seed and id, so equal ids are treated
    alike, and rows without id as one id. A null text counts as empty: no tokens, plain. Repeated
    rows stay; no rows give no rows; other columns of `docs` are not read.
    """
    own = F.col(doc_id)
    columns = docs.select(
        own.alias("doc_id"), text_of(text).alias("_text"), *(d.alias(f"h{k}") for k, d in enumerate(draws(own, seed), 1))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("_text"))
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            cuts = Cuts(data, offsets)
            one, two = h1 % (cuts.tokens + 1), h2 % (cuts.tokens + 1)
            low, high = cuts.after(np.minimum(one, two)), cuts.after(np.maximum(one, two))
            chars = cuts.characters(cuts.begin, low), cuts.characters(low, high)
            made: dict[str, list] = {f: [] for f in FIELDS}
            for k in range(batch.num_rows):
                begin, end = offsets[k], offsets[k + 1]
                whole = data[begin:end].tobytes()
                form = "spm" if h4[k] % 100 < suffix_first else "psm"
                if not whole or h3[k] % 100 >= 100 - plain or any(s in whole for s in (PREFIX, SUFFIX, MIDDLE)):
                    form, output = "plain", whole
                else:
                    a, b = low[k] - begin, high[k] - begin
                    parts = (PREFIX, whole[:a]), (SUFFIX, whole[b:])
                    first, second = parts if form == "psm" else parts[::-1]
                    output = b"".join([*first, *second, MIDDLE, whole[a:b]])
                made["form"].append(form)
                made["n"].append(int(cuts.tokens[k]))
                made["prefix_chars"].append(None if form == "plain" else int(chars[0][k]))
                made["middle_chars"].append(None if form == "plain" else int(chars[1][k]))
                if "output" in fields:
                    made["output"].append(output.decode())
                if "output_sha256" in fields:
                    made["output_sha256"].append(hashlib.sha256(output).hexdigest())
                if "restored_sha256" in fields:
                    made["restored_sha256"].append(hashlib.sha256(restored(output, form)).hexdigest())
            arrays = [batch.column("doc_id")] + [pa.array(made[f], FIELDS[f]) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *fields])

    id_type = columns.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{f} {TYPES[FIELDS[f]]}" for f in fields)])
    return columns.mapInArrow(run, schema)
