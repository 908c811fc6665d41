"""Language identification by compression.

Every language has a zstandard raw-content dictionary: text of that language, chosen by hash
from the learning folds. A text is compressed with each dictionary and belongs to the language
that makes it smallest. Long texts are compressed in pieces, each with the fresh dictionary, so that
what the text says itself does not take the dictionary's place. The margin between the best two
sizes gives the score; below MARGIN the answer is marked as rejected.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.shared import fold, written

# A dictionary is made of at most so many documents of a language (one of each hash bucket), of
# each PART characters from a hashed place, and has at most DICTIONARY bytes, taken evenly from them.
DOCUMENTS, PART, DICTIONARY = 64, 4_000, 96 * 1024
# Every language is learnt. All dictionaries together have at most so many bytes: with many languages
# each gets an even share instead of DICTIONARY.
DICTIONARIES = 64 << 20
# Languages whose prepared dictionaries a task holds at once.
BLOCK = 128
# Rows of chosen ids that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
LEVEL, PIECE = 6, 4_096
# Relative difference of the best two sizes under which the language is not certain.
MARGIN = 0.02
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, with single spaces: signs and case say nothing of the language."""
    return OTHER.sub(" ", text.lower()).strip().encode()


def evenly(parts: list[bytes], size: int) -> list[bytes]:
    """The parts cut so that they have `size` bytes together: short ones whole, of the others the same number."""
    left, cut = size, {}
    for k, n in enumerate(sorted(range(len(parts)), key=lambda n: len(parts[n]))):
        cut[n] = min(len(parts[n]), left // (len(parts) - k))
        left -= cut[n]
    return [part[: cut[n]] for n, part in enumerate(parts)]


def dictionaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw dictionary contents by language, from rows with a language outside the held-out fold."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != 1)).select(
        F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.col(doc_id), F.lit(5)).alias("place"),
        F.col(text).alias("text"),
    )
    # The choice is made on numbers, so that only the chosen texts move.
    chosen = written(
        known.withColumn("bucket", F.pmod("place", F.lit(DOCUMENTS)))
        .groupBy("lang", "bucket")
        .agg(F.min("place").alias("place"))
        .select("lang", "place")
    )
    languages, rows = chosen.agg(F.count_distinct("lang"), F.count("*")).first()
    # A window of PART characters, whose place is a hash too. Rows of a repeated id count once.
    shift = F.pmod(F.xxhash64("place"), F.greatest(F.length("text") - PART + 1, F.lit(1)))
    texts = (
        known.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, ["lang", "place"])
        .groupBy("lang", "place")
        .agg(F.min(F.substring("text", (shift + 1).cast("int"), F.lit(PART))).alias("text"))
    )
    size = min(DICTIONARY, DICTIONARIES // max(languages, 1))
    made: dict[str, bytes] = {}
    ordered = ((r.lang, r.text) for r in texts.orderBy("lang", "place").toLocalIterator())
    for name, found in itertools.groupby(ordered, key=lambda r: r[0]):
        parts = [letters(part) for _, part in found]
        made[name] = b" ".join(evenly(parts, size - len(parts) + 1))
    return made


class Identifier:
    """Compressors with the dictionaries of all languages, in the order of their names, in blocks."""

    def __init__(self, contents: dict[str, bytes]):
        self.contents = contents
        self.names = sorted(contents)
        self.blocks = [self.names[at : at + BLOCK] for at in range(0, len(self.names), BLOCK)]
        self.held = [self.compressors(block) for block in self.blocks[:1]]

    def compressors(self, names: list[str]) -> list[Callable[[bytes], bytes]]:
        made = []
        for name in names:
            raw = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )
        return made

    def smallest(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of the best two languages of each text, and the places of their names."""
        best = np.zeros((len(raws), 0), np.int64)
        which = best.copy()
        for k, block in enumerate(self.blocks):
            compress = self.held[0] if k == 0 else self.compressors(block)
            sizes = np.array([[sum(map(len, map(c, pieces(raw)))) for c in compress] for raw in raws], np.int64)
            best = np.hstack([best, sizes.reshape(len(raws), len(block))])
            which = np.hstack([which, np.broadcast_to(np.arange(len(block)) + k * BLOCK, (len(raws), len(block)))])
            # Stable: of equal sizes the first by name stays first.
            order = np.argsort(best, axis=1, kind="stable")[:, :2]
            best, which = (np.take_along_axis(a, order, axis=1) for a in (best, which))
        return best, which

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        asked = [k for k, t in enumerate(texts) if t is not None and self.names and any(map(str.isalpha, t))]
        if len(self.names) == 1:
            for k in asked:
                out[k] = (self.names[0], 1.0, False)
        elif asked:
            sizes, places = self.smallest([letters(texts[k]) for k in asked])
            for k, (best, second), place in zip(asked, sizes, places[:, 0], strict=True):
                margin = (second - best) / second
                out[k] = (self.names[place], float(margin / (margin + MARGIN)), bool(margin < MARGIN))
        return out


def pieces(raw: bytes) -> list[bytes]:
    """The bytes in pieces of PIECE; a short rest goes with the piece before it."""
    cuts = [*range(0, max(1, len(raw) - PIECE // 2), PIECE), len(raw)]
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Learns from `text` and the non-null `lang` of rows whose crc32 of the id modulo 3 is not 1 (rows
    with a null id are not learnt from). A text that is null or has no letter is `und` with score 0,
    as every text is if nothing was learnt. Of languages that compress alike the first by name
    is taken, with score 0. The score is m / (m + MARGIN) of the relative margin m: one half at the
    limit of rejection. Repeated rows are judged alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, doc_id, text, lang))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in batches:
            found = identifier.judge(batch.column("text").to_pylist())
            names, scores, rejected = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score", "rejected")
