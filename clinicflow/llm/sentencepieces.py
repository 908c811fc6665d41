"""SentencePiece encoding by backtracking, and decoding.

The encoder reproduces merge-type (BPE) models exactly without running merges over the text.
A sequence of pieces is the encoding of a text if and only if merging the text of each two
neighbours gives those two neighbours again: a merge never looks beyond the two symbols it
joins, and merges inside a piece come in the same order wherever it stands. So the encoder
takes the longest piece at a position (from an Aho-Corasick pass), checks it against the piece
before, tries shorter ones when they do not agree, and steps back when none is left; a bitfield
marks positions from which no encoding continues, so each is given up only once.

No piece has a space mark after another character, so a text falls into words, and words fall
into parts where no piece has the two characters side by side. Words and parts are encoded one
by one and remembered. Characters outside the vocabulary are parts of their own, given as bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.arrays import pieces
from clinicflow.llm.shared import held, text_of

SPACE = "▁"
# Words and pairs of pieces remembered by a Python worker, and the longest word remembered.
WORDS, PAIRS, WORD_CHARS = 400_000, 150_000, 80

SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Remembered(dict):
    """Ids of words, encoded when first asked for. At most `most` are held; then it starts anew."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = WORDS):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode(word))
        if len(word) <= WORD_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one SentencePiece model of the merge type.

    Models that normalise texts, have user-defined or unused pieces, or have pieces with inner
    space marks are refused, because they would need more than this encoder does.
    """

    def __init__(self, model_file: str, remembered: int = WORDS):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        refuse(model)
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.end_id = model.eos_id()
        # The library is asked for the vocabulary only; texts are encoded here.
        self.byte_ids = {int(pieces[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [
            i for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any(model.is_unused(i) for i in plain) or any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model has unused pieces or pieces with inner spaces")
        self.score = {pieces[i]: model.get_score(i) for i in plain}
        self.ids = {pieces[i]: i for i in plain}
        self.out = [b""] * n
        for i in plain:
            self.out[i] = pieces[i].replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.out[i] = bytes([byte])
        # Single characters count as pieces even if they only appear inside others.
        self.valid = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in self.valid:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(self.valid)
        self.shorter = {
            p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in self.valid
        }
        self.agree = lru_cache(PAIRS)(self._agree)
        # Two characters that no piece has side by side are never merged: a text can be cut there.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.parts = Remembered(self.stretch, remembered)
        self.words = Remembered(lambda word: self.segment(SPACE + word), remembered)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, then leftmost."""
        symbols, score = list(text), self.score
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                pair = symbols[left] + symbols[right]
                if pair in score:
                    heapq.heappush(heap, (-score[pair], left, pair))

        for k in range(len(symbols)):
            offer(k)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left] if symbols[left] else len(symbols)
            if right >= len(symbols) or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [s for s in symbols if s]

    def _agree(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def stretch(self, text: str) -> list[int]:
        """The ids of a text whose characters are all in the vocabulary, or of one that is not."""
        n = len(text)
        if n == 1:
            return [self.ids[text]] if text in self.ids else [self.byte_ids[b] for b in text.encode()]
        # Matches come by their end, so a later one with the same start is the longer one.
        longest = [""] * n
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece
        failed = bytearray(n // 8 + 1)
        path: list[str] = []
        agree = self.agree
        at, piece = 0, longest[0]
        while at < n:
            end = at + len(piece)
            open_end = not failed[end >> 3] >> (end & 7) & 1
            if open_end and (not path or agree(path[-1], piece)):
                path.append(piece)
                at = end
                piece = longest[at] if at < n else ""
            elif shorter := self.shorter[piece]:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
        ids = self.ids
        return [ids[p] for p in path]

    def segment(self, text: str) -> list[int]:
        """The ids of a text in which space marks stand only at the start."""
        out: list[int] = []
        start, pairs, parts = 0, self.pairs, self.parts
        for end, pair in enumerate(map(operator.add, text, text[1:]), 1):
            if pair not in pairs:
                out += parts[text[start:end]]
                start = end
        out += parts[text[start:]]
        return out

    def encode(self, text: str, end: bool = False) -> list[int]:
        """The ids of a text, with the end id on request."""
        if not text:
            ids = []
        elif "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            ids = []
            for segment in SEGMENTS.findall(SPACE + text.replace(" ", SPACE)):
                word = segment[1:]
                if segment[0] == SPACE and word and word[0] != SPACE:
                    ids += self.words[word]
                else:
                    ids += self.segment(segment)
        else:
            ids = list(itertools.chain.from_iterable(map(self.words.__getitem__, text.split(" "))))
        if end:
            ids.append(self.end_id)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; one space at the start of the text is not part of it."""
        ids = list(ids)
        raw = b"".join(map(self.out.__getitem__, ids))
        if raw[:1] == b" " and ids[0] != self.byte_ids[32]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> str:
    """Text in which every byte that belongs to no character is a replacement character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


# Fixed values of the model file's format: what kind the model and its pieces are of, and field numbers.
BPE, USER_DEFINED = 2, 4
PIECES, PIECE_TYPE, TRAINER, NORMALIZER = 1, 3, 2, 3
MODEL_TYPE, TREAT_AS_SUFFIX, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPED = 3, 24, 2, 3, 4, 5


def refuse(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise ValueError unless the model merges, and leaves texts as they are but for space marks."""
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in message(model.serialized_model_proto()):
        if number == PIECES and dict(message(value)).get(PIECE_TYPE) == USER_DEFINED:
            raise ValueError("the model has user-defined pieces")
        if number == TRAINER:
            trainer |= dict(message(value))
        if number == NORMALIZER:
            normalizer |= dict(message(value))
    if trainer.get(MODEL_TYPE) != BPE or trainer.get(TREAT_AS_SUFFIX):
        raise ValueError("the model does not encode by merging with space marks in front")
    marks = normalizer.get(DUMMY_PREFIX, 1) and normalizer.get(ESCAPED, 1)
    if normalizer.get(CHARSMAP) or normalizer.get(EXTRA_SPACES, 1) or not marks:
        raise ValueError("the model normalises texts")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the format of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield field, data[at : at + size]
        at += size


FIELDS = {
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
TYPES = {
    "ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string",
}


def tokenize(
    docs: DataFrame,
    model_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    fields: tuple[str, ...] = ("ids", "decoded"),
    end: bool = True,
    remembered: int = WORDS,
) -> DataFrame:
    """doc_id and the asked `fields` for every row: ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    `decoded` is decoded from the ids, not copied from the text. A null text counts as empty and
    has the end id alone. Rows are handled one by one, so repeated rows and null ids stay as they
    are; no rows give no rows. Other columns of `docs` are not read. The model file must be at
    the same path on all machines. A Python worker remembers at most `remembered` words and as many
    parts of words: fewer take less of its memory and more time.
    """
    columns = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held(("codec", model_file, remembered), lambda: Codec(model_file, remembered))
        digits = [str(i) for i in range(len(c.out))]
        # The ids of a large batch would take many times its size as Python objects.
        cut = (piece for batch in batches for piece in pieces(batch, batch.column("text")))
        for batch in cut:
            made: dict[str, list] = {f: [] for f in fields}
            for value in batch.column("text"):
                ids = c.encode(value.as_py(), end)
                decoded = c.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                if "ids" in made:
                    made["ids"].append(ids)
                if "decoded" in made:
                    made["decoded"].append(decoded)
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids))
                if "ids_sha256" in made:
                    joined = " ".join(map(digits.__getitem__, ids))
                    made["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            arrays = [batch.column("doc_id")] + [pa.array(made[f], FIELDS[f]) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *fields])

    id_type = columns.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{f} {TYPES[f]}" for f in fields)])
    return columns.mapInArrow(run, schema)
