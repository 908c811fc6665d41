"""Numpy views of Arrow text columns: slices of bounded size, words, and hashes of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The column `_text`, or where it is not sent apart, the field `text` of `_doc`."""
    return batch.column("_text") if "_text" in batch.schema.names else batch.column("_doc").field(text)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "_text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have at most `size` bytes, or are one text."""
    for batch in batches:
        yield from pieces(batch, texts_of(batch, text), size)


def pieces(batch: pa.RecordBatch, texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """One batch, cut in the same way."""
    ends = text_bytes(texts)[1]
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets at which texts start and end. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice in order: where each starts and ends in the bytes, and each text's first word."""

    codes: np.ndarray  # the bytes, lower-cased, 0 where they belong to no word
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n + 1 word numbers: text i has words first[i] to first[i + 1]

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        width = int((self.ends - self.starts).max())
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(width, GOLDEN | np.uint64(1)))
            inside = np.flatnonzero(self.codes)
            lengths = self.ends - self.starts
            place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = BYTE_VALUES[self.codes[inside]] * powers[place]
            return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def _ascii_words() -> np.ndarray:
    """0-9, a-z and all bytes of characters beyond ASCII are word bytes; A-Z are lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:48] = table[58:65] = table[91:97] = table[123:128] = 0
    return table


WORD_BYTES = _ascii_words()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> Words:
    """Maximal runs of the bytes that `table` keeps; a word never goes beyond its text."""
    codes = table[data]
    edge = np.zeros(len(codes) + 1, np.int8)
    inside = (codes != 0).view(np.int8)
    edge[:-1] = inside
    edge[1:] -= inside
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Texts lie side by side: where one ends inside a run, the run is two words.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(codes))])
    cuts = cuts[(inside[cuts] & inside[cuts - 1]).astype(bool)] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return Words(codes, starts, ends, np.searchsorted(starts, offsets))
