"""Removal of repeated byte strings with an enhanced suffix array.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier in the corpus. Equal
strings have equal anchors (the piece of PIECE bytes with the least hash), so strings are dealt
out by their anchor, in runs of neighbours that share it. Runs with the same bytes need no
comparison: all but the first occurrence are repeats. Of the runs that share an anchor but not
all their bytes, the first occurrence of each enters a suffix array with common-prefix lengths. A
stack scan over it builds the tree of common-prefix intervals; an interval whose occurrences differ
in the byte before (left-extension diversity) is a maximal repeat, output with all its occurrences,
of which the first stays. Where an anchor has too many runs for one array, its strings are dealt out
by their digests instead, and all but the first of equal ones are repeats.

Texts are shuffled twice, compressed; else only hashes and places are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from clinicflow.llm.arrays import BYTE_VALUES, GOLDEN, mix, slices, text_bytes
from clinicflow.llm.shared import held, text_of, written

# Length of the strings that may not repeat, and of the pieces whose least hash stands for a string.
LENGTH, PIECE = 100, 32
# Strings looked at together; their places fit into 24 bits. Working memory is some hundred bytes for each.
BLOCK = 1 << 19
# Bytes of texts in whose runs repeats are found before anything is shuffled.
SLICE_BYTES = 4 << 20
# Bytes of runs that enter one suffix array, unless a single anchor has more.
ARRAY_BYTES = 2 << 20
# Different runs, of at most 168 bytes each, of one anchor that enter a suffix array.
ANCHOR_RUNS = 1 << 14
# Runs that leave a task, or have their strings named, at once.
RUN_ROWS = 1 << 13


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the PIECE bytes from each place on."""
    with np.errstate(over="ignore"):
        out, size, factor = BYTE_VALUES[data], 1, GOLDEN | np.uint64(1)
        while size < PIECE:
            out = out[:-size] * factor + out[size:]
            factor = factor * factor
            size *= 2
        return mix(out)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, number of strings, key) of runs of strings that share their anchor.

    The anchor of a string of LENGTH bytes is the piece in it with the least hash, the leftmost of
    equal ones. It depends on the string's bytes only, so equal strings have equal anchors, and
    strings next to each other mostly share one. Strings never go beyond a text.
    """
    starts, counts, keys = [], [], []
    n_pieces = LENGTH - PIECE + 1
    for begin in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[begin : begin + BLOCK + LENGTH - 1]
        hashes = piece_hashes(part)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes & ~np.uint64((1 << 24) - 1)) | place
        size = 1
        while size * 2 <= n_pieces:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (n_pieces - size)], least[n_pieces - size :])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        inside = np.ones(len(anchor) + 1, bool)
        inside[-1] = False
        for end in offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, begin + len(part), "left")]:
            inside[max(0, end - begin - LENGTH + 1) : end - begin] = False
        new = inside[:-1].copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-2]
        at = np.flatnonzero(new)
        stop = np.flatnonzero(inside[:-1] & ~np.append(inside[1:-1] & ~new[1:], False))
        starts.append(at + begin)
        counts.append(stop - at + 1)
        keys.append(hashes[anchor[at]])
    if not starts:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def run_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run, from prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        factor = GOLDEN | np.uint64(1)
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        out = []
        # Prefix sums of a block reach over the longest run.
        for begin in range(0, int(starts[-1]) + 1 if len(starts) else 0, BLOCK):
            chosen = slice(*np.searchsorted(starts, (begin, begin + BLOCK)))
            part = data[begin : begin + BLOCK + 3 * LENGTH]
            powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(part), factor))])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[part] * powers[:-1])])
            back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(part), inverse))])
            s, e = starts[chosen] - begin, ends[chosen] - begin
            out.append(mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _ranks(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """The order of the texts of a slice or chunk: by id, nulls last, then by hash. Equal rows rank alike."""
    names = [(x is None, x or 0, h) for x, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
    ranked = {name: k for k, name in enumerate(sorted(set(names)))}
    return np.array([ranked[n] for n in names], np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of strings: the text it is in, where it starts, how many strings, key and digest.

    Runs that occur earlier in the same slice are known repeats. They come as merged spans (`known`)
    with a key of their own, so a common passage has one row for each slice that holds it.
    """
    held(None)
    for batch in slices(batches, size=SLICE_BYTES):
        yield _runs_of(batch)
    held(None)


def _runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("_text"))
    starts, counts, keys = segments(data, offsets)
    digests = run_digests(data, starts, starts + counts + LENGTH - 1)
    owner = np.searchsorted(offsets, starts, "right") - 1
    starts = starts - offsets[owner]
    place = _ranks(batch.column("doc_id"), batch.column("h"))[owner] << 32 | starts
    order = np.lexsort((place, digests, keys))
    again = np.zeros(len(order), bool)
    again[1:] = (keys[order[1:]] == keys[order[:-1]]) & (digests[order[1:]] == digests[order[:-1]])
    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    repeat = np.zeros(len(order), bool)
    repeat[order] = again & (place[order] != place[first])
    fresh = np.zeros(len(order), bool)
    fresh[order] = ~again
    # Runs of a text are in order, and so are their ends.
    at = np.flatnonzero(repeat)
    ends = starts[at] + counts[at] + LENGTH - 1
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (starts[at[1:]] > ends[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    lengths = ends[tail] - starts[at[head]] - LENGTH + 1
    rows = np.concatenate([np.flatnonzero(fresh), at[head]])
    known = np.arange(len(rows)) >= int(fresh.sum())
    hashes = batch.column("h").to_numpy()[owner[rows]]
    with np.errstate(over="ignore"):
        own = mix(hashes.view(np.uint64) + mix(starts[rows].astype(np.uint64) + GOLDEN))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(known, own, keys[rows]).view(np.int64)),
            pa.array(np.where(known, mix(own), digests[rows]).view(np.int64)),
            batch.column("doc_id").take(pa.array(owner[rows])),
            pa.array(hashes),
            pa.array(starts[rows].astype(np.int32)),
            pa.array(np.concatenate([counts[fresh], lengths]).astype(np.int32)),
            pa.array(known),
        ],
        ["key", "digest", "doc_id", "h", "start", "n", "known"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("_text"))
        raw = data.tobytes()
        packed = [pack(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(packed, pa.binary())], ["doc_id", "h", "packed"]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        out: list[tuple] = []
        for doc, h, packed, asked in zip(*(batch.column(c) for c in ("doc_id", "h", "packed", "asked")), strict=True):
            raw = unpack(packed.as_py())
            doc, h = doc.as_py(), h.as_py()
            for run in asked.as_py():
                start, n = run["start"], run["n"]
                out.append((run["key"], doc, h, start, raw[start : start + n + LENGTH - 1]))
                if len(out) >= RUN_ROWS:
                    yield _run_rows(out, id_type)
                    out = []
        if out:
            yield _run_rows(out, id_type)


def _run_rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), id_type, pa.int64(), pa.int32(), pa.binary())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "h", "start", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the runs as a digest of 16 bytes."""
    digest = hashlib.blake2b
    for batch in (b.slice(at, RUN_ROWS) for b in batches for at in range(0, b.num_rows, RUN_ROWS)):
        runs = batch.column("bytes").to_pylist()
        counts = np.array([len(r) - LENGTH + 1 for r in runs], np.int64)
        at = np.repeat(np.arange(len(runs)), counts)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        names = [digest(r[k : k + LENGTH], digest_size=16).digest() for r in runs for k in range(len(r) - LENGTH + 1)]
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()),
                batch.column("doc_id").take(rows),
                batch.column("h").take(rows),
                pa.array((batch.column("start").to_numpy()[at] + inner).astype(np.int32)),
            ],
            ["string", "doc_id", "h", "start"],
        )


def _repeated_strings(cut: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, h, start, end) of the strings that occur earlier in the runs."""
    strings = written(cut.mapInArrow(_strings, f"string binary, doc_id {id_type}, h bigint, start int"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = strings.join(first, "string").filter(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "h", F.col("start").cast("bigint"), (F.col("start") + LENGTH).cast("bigint").alias("end"))


def _pairs(values: np.ndarray, apart: int, bits: int) -> np.ndarray:
    """Each value of at most `bits` bits and the one `apart` places on, as one number."""
    out = values[:-apart].astype(np.uint64)
    out <<= np.uint64(bits)
    out |= values[apart:]
    return out


def _ranked(values: np.ndarray) -> np.ndarray:
    """The order of each value among the distinct ones."""
    order = np.argsort(values)
    values = values[order]
    new = np.zeros(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    del values
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return rank


class SuffixArray:
    """Suffixes of the runs of a chunk that are at least LENGTH long, in order, with common prefixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """Run i is data[offsets[i] : offsets[i + 1]]. An end mark follows each run, less than any byte,
        so a suffix comes before the longer ones that it begins, and prefixes end with their run.
        """
        runs = np.arange(len(offsets) - 1)
        symbols = np.zeros(len(data) + len(runs) + 2 * LENGTH, np.uint16)
        symbols[np.arange(len(data)) + np.repeat(runs, np.diff(offsets))] = data.astype(np.uint16) + 1
        begins, ends = offsets[:-1] + runs, offsets[1:] + runs
        counts = ends - begins - LENGTH + 1
        owner = np.repeat(runs, counts)
        places = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - begins, counts)
        # rank[s]: the order of the 64 symbols from each place, by doubling; only the last order is kept.
        rank = _ranked(_pairs(_pairs(symbols, 1, 9), 2, 18))
        for size in (4, 8, 16, 32):
            rank = _ranked(_pairs(rank, size, 32))
        whole = _pairs(rank, LENGTH - 64, 32)[places]
        # Suffixes with the same LENGTH bytes are told apart by what follows in their run, up to 68 bytes.
        last = len(rank) - 1
        tails = [rank[np.minimum(places + LENGTH + k, last)] for k in (LENGTH - PIECE - 64, 0)]
        order = np.lexsort([*tails, whole])
        del rank, tails
        same = np.diff(whole[order]) == 0
        del whole
        self.places, self.owner = places[order], owner[order]
        del places, owner, order
        # common[i]: bytes shared with the suffix before, up to the end of either run; 0 if fewer than LENGTH.
        self.common = np.zeros(len(self.places) + 1, np.int64)
        self.common[1:-1][same] = LENGTH
        at = np.flatnonzero(same) + 1
        shared = LENGTH
        while len(at):
            follows = symbols[self.places[at] + shared]
            at = at[(follows == symbols[self.places[at - 1] + shared]) & (follows > 0)]
            shared += 1
            self.common[at] = shared
        inside = self.places > begins[self.owner]
        self.before = np.where(inside, symbols[self.places - 1].astype(np.int64), -1 - self.owner)
        # From now on: where a suffix begins in its run.
        self.places -= begins[self.owner]

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of every maximal repeat: occurrences are the suffixes first to last.

        The stack holds the open common-prefix intervals; an interval closes when the common prefix
        falls below its own. It is maximal if not all its occurrences follow the same byte; at
        the start of a run nothing is before, which differs from everything.
        """
        edges = np.diff((self.common >= LENGTH).astype(np.int8), prepend=0)
        for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            # Suffixes begin - 1 to end - 1 share at least LENGTH bytes.
            at = begin - 1
            lengths = self.common[begin:end].tolist()
            left = self.before[at : at + len(lengths) + 1].tolist()
            stack: list[list] = []
            for k, length in enumerate([*lengths, 0]):
                begin, byte = k, left[k]
                while stack and stack[-1][0] > length:
                    closed, begin, own = stack.pop()
                    byte = own if own == byte else None
                    if byte is None:
                        yield closed, at + begin, at + k
                if not length:
                    break
                if stack and stack[-1][0] == length:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
                else:
                    stack.append([length, begin, byte])


def repeats(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, start, end in the text) of the parts of each run that occur earlier in the other runs.

    Run i is data[offsets[i] : offsets[i + 1]]. `order` ranks the texts of the runs; runs of the same
    text go by their start.
    """
    array = SuffixArray(data, offsets)
    rank = order[array.owner].astype(np.int64) << 32 | (array.places + starts[array.owner])
    # Of a suffix only its longest repeat matters that another occurrence comes before.
    reach = np.zeros(len(rank), np.int64)
    for length, first, last in array.maximal_repeats():
        keep = first + int(rank[first : last + 1].argmin())
        for own in (reach[first:keep], reach[keep + 1 : last + 1]):
            np.maximum(own, length, out=own)
    at = np.flatnonzero(reach)
    at = at[np.lexsort((array.places[at], array.owner[at]))]
    run = array.owner[at]
    begin = starts[run] + array.places[at]
    # Ends so far, those of later runs beyond all of the runs before.
    far = np.maximum.accumulate(run << 32 | (begin + reach[at]))
    new = np.ones(len(at), bool)
    new[1:] = (run[1:] << 32 | begin[1:]) > far[:-1]
    head = np.flatnonzero(new)
    return run[head], begin[head], far[np.append(head[1:], len(at))[: len(head)] - 1] & 0xFFFFFFFF


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs with their bytes, a chunk of whole anchors at a time, through suffix arrays.

    A chunk has at most ARRAY_BYTES bytes of runs, unless it is a single anchor.
    """
    held(None)
    for chunk in _chunks(batches):
        yield _found(chunk)
    held(None)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*rest, batch]) if rest else batch
        filled = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
        # A chunk may end where the anchor changes; the last anchor may go on in the next batch.
        edges = np.flatnonzero(np.diff(rows.column("key").to_numpy())) + 1
        at = 0
        while len(edges) and edges[-1] > at and filled[-1] - (filled[at - 1] if at else 0) > ARRAY_BYTES:
            most = ARRAY_BYTES + (filled[at - 1] if at else 0)
            fit = edges[(edges > at) & (filled[edges - 1] <= most)]
            upto = int(fit[-1] if len(fit) else edges[edges > at][0])
            yield rows.slice(at, upto - at)
            at = upto
        rest = [rows.slice(at)] if at < rows.num_rows else []
    yield from rest


def _found(rows: pa.RecordBatch) -> pa.RecordBatch:
    ids = rows.column("doc_id")
    order = _ranks(ids, rows.column("h"))
    runs, begins, ends = repeats(*text_bytes(rows.column("bytes")), order, rows.column("start").to_numpy().astype(np.int64))
    at = pa.array(runs)
    return pa.RecordBatch.from_arrays(
        [ids.take(at), rows.column("h").take(at), pa.array(begins), pa.array(ends)], ["doc_id", "h", "start", "end"]
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ids, first, size = batch.column("doc_id"), 0, 0
        out: list[tuple] = []
        for packed, spans, again in zip(*(batch.column(c) for c in ("packed", "spans", "again")), strict=True):
            raw = unpack(packed.as_py())
            merged = joined([(s["start"], s["end"]) for s in spans.as_py() or []])
            if again.as_py() and len(raw) >= LENGTH:
                merged = [(0, len(raw))]
            kept, at = [], 0
            for start, end in merged:
                kept.append(raw[at:start])
                at = end
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
            size += len(rest)
            if size >= SLICE_BYTES:
                yield _what_is_left(ids.slice(first, len(out)), out)
                first, size, out = first + len(out), 0, []
        if out:
            yield _what_is_left(ids.slice(first), out)


def _what_is_left(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(
        [ids, *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes) if asked.

    Texts are UTF-8 bytes, null is empty. "Earlier" is a smaller doc_id, or an earlier start in
    the same document; null ids come last, rows of the same id go by a hash of their text, and of
    rows equal in id and text one counts as the first. Texts shorter than LENGTH stay whole. Other
    columns are not read. No rows give no rows. doc_id must be of an integer type.
    """
    value = text_of(text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("h"), value.alias("_text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = docs.mapInArrow(
        _runs, f"key bigint, digest bigint, doc_id {id_type}, h bigint, start int, n int, known boolean"
    )
    # Where an anchor comes more than once, its runs are sorted so that equal ones follow each other.
    by_bytes = Window.partitionBy("key").orderBy("digest", F.col("doc_id").asc_nulls_last(), "h", "start")
    whole = Window.partitionBy("key").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct(F.col("doc_id"), F.col("h"), F.col("start"))
    # same: an earlier run has these bytes. mixed: the anchor has other runs as well. crowded: too
    # many for one suffix array.
    judged = written(
        runs.withColumn("_last", F.lag("digest").over(by_bytes))
        .withColumn("_next", F.lead("digest").over(by_bytes))
        .withColumn("again", F.lag(at).over(by_bytes).eqNullSafe(at))
        .filter("known or _next is not null or _last is not null")
        .withColumn("mixed", F.min("digest").over(whole) != F.max("digest").over(whole))
        .withColumn("different", F.sum(F.when(F.col("_last") == F.col("digest"), 0).otherwise(1)).over(whole))
        .select(
            "key", "doc_id", "h", "start", "n", "again",
            (F.col("different") > ANCHOR_RUNS).alias("crowded"),
            (F.col("known") | F.coalesce(F.col("_last") == F.col("digest"), F.lit(False))).alias("same"),
            (F.col("mixed") & ~F.col("known")).alias("mixed"),
        )
        .filter("same or mixed")
    )
    # A repeated run whose occurrence is that of a repeated row is not a repeat of itself.
    plain = judged.filter("same and not again").select(
        "doc_id", "h", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end")
    )
    packed = docs.mapInArrow(_packed, f"doc_id {id_type}, h bigint, packed binary")
    same_row = ["doc_id", "h"]
    on = lambda left, right: left.doc_id.eqNullSafe(right.doc_id) & (left.h == right.h)

    def cut(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "start", "n")).alias("asked"))
        return (
            packed.join(asked, on(packed, asked))
            .select(packed.doc_id, packed.h, "packed", "asked")
            .dropDuplicates(same_row)
            .mapInArrow(_cut, f"key bigint, doc_id {id_type}, h bigint, start int, bytes binary")
        )

    different = judged.filter("mixed and not same")
    crowded = different.filter("crowded")
    ordered = cut(different.filter("not crowded")).repartition("key").sortWithinPartitions("key")
    compared = ordered.mapInArrow(_scan_arrays, f"doc_id {id_type}, h bigint, start bigint, end bigint")
    if not crowded.isEmpty():
        compared = compared.unionByName(_repeated_strings(cut(crowded), id_type))
    spans = (
        plain.unionByName(compared)
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    numbered = packed.join(spans, on(packed, spans), "left").select(packed.doc_id, packed.h, "packed", "spans")
    once = Window.partitionBy("doc_id", "h").orderBy(F.lit(0))
    numbered = numbered.withColumn("again", F.row_number().over(once) > 1)
    out = numbered.select("doc_id", "packed", "spans", "again").mapInArrow(
        _remove, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    return out if kept_bytes else out.drop("kept")
