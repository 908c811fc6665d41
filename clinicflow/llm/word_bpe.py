"""BPE encoding of whole words through a trie of prefixes, and decoding.

A sequence of tokens is the encoding of a word if and only if merging the symbols of each two
neighbours gives those two neighbours again, because a merge never looks beyond the symbols it
joins. So the encoding of a prefix is that of a shorter prefix and one last token, and exactly
one last token fits: it ends the prefix, and agrees with the last token of what is before it.

Distinct words go into a trie, whose edges are runs of symbols. A depth-first walk carries the
last token of every prefix on the way, so a prefix that many words share is computed once; a
word's tokens are read back from its leaf. The last symbol of a word is a symbol of its own (the
byte with the word's end), so leaves are words and no word is another one's prefix.

White space belongs to no word, so texts fall into chunks between white space, which are
normalised and split into words one by one and remembered.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from clinicflow.llm.arrays import slices
from clinicflow.llm.shared import held, text_of

# A Python worker forgets the chunks, words and pairs of tokens it knows when there are more than
# this before a block, and longer chunks and words after each block.
CHUNKS, WORDS, PAIRS, LONG = 350_000, 350_000, 400_000, 80
# Characters of text whose words share a trie, and endings of prefixes remembered.
BLOCK_CHARS, ENDINGS = 8_000_000, 300_000

# Characters with Unicode's property White_Space, and how the tokenizer splits words.
WHITE = (
    "\t-\r \x85\xa0\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}"
    "\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}"
)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]

BETWEEN = re.compile(f"[^{WHITE}]+")
SPACE = re.compile(f"[{WHITE}]")
# No character before this one is changed by composing it with its neighbours.
COMBINING = "\N{COMBINING GRAVE ACCENT}"
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# The symbol of a byte at the end of a word is the byte's character, moved up.
ENDS = 0x1000


class Trie:
    """Words by their prefixes; an edge is a run of symbols and what comes after it, or the word."""

    def __init__(self):
        self.root: dict[str, list] = {}

    def insert(self, word: str) -> None:
        edges, at = self.root, 0
        while True:
            edge = edges.get(word[at])
            if edge is None:
                edges[word[at]] = [word[at:], word]
                return
            label, after = edge
            if not word.startswith(label, at):
                k = 1
                while label[k] == word[at + k]:
                    k += 1
                rest = word[at + k :]
                edge[:] = label[:k], {label[k]: [label[k:], after], rest[0]: [rest, word]}
                return
            if after is word or isinstance(after, str):
                return
            edges, at = after, at + len(label)


class Endings:
    """What prefixes end with, found when first asked for; at most ENDINGS are held.

    An ending is the longest token beginning that ends a prefix, as a tuple of the tokens
    that end the prefix, longest first, the endings after one more symbol, and its text.
    """

    def __init__(self, tokens: Iterable[str]):
        self.tokens = {t: t for t in tokens}
        self.beginnings = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.start()

    def start(self) -> None:
        self.nothing: tuple = ((), {}, "")
        self.by_text = {"": self.nothing}

    def after(self, ending: tuple, symbol: str) -> tuple:
        """The ending of a prefix that goes on with `symbol`."""
        text = ending[2] + symbol
        tails = [text[k:] for k in range(len(text))]
        longest = next(t for t in tails if t in self.beginnings)
        found = self.by_text.get(longest)
        if found is None:
            found = tuple((self.tokens[t], len(t)) for t in tails if t in self.tokens), {}, longest
            self.by_text[longest] = found
        ending[1][symbol] = found
        return found


class Characters:
    """Splits chunks of characters that never combine, by what the library does with each of them."""

    def __init__(self, normal: Callable[[str], str], split: Callable[[str], list]):
        self.normal, self.split = normal, split
        self.lowered = Table(normal)
        self.symbols = Table(lambda c: split(c)[0][0])
        # A character that takes its place in the patterns: itself, a letter, a digit, or a mark.
        self.kinds = Table(lambda c: c if c.isascii() else self.kind(c))

    def kind(self, character: str) -> str:
        return next(k for k in "x!0" if k == "0" or len(self.split(k + character)) == 1)

    def words(self, chunk: str) -> list[str]:
        lower = chunk.translate(self.lowered)
        kinds = lower.translate(self.kinds)
        return [lower[m.start() : m.end()].translate(self.symbols) for m in ASCII_WORDS.finditer(kinds)]


class Table(dict):
    """For str.translate: what each character becomes, found when first asked for."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, code: int) -> str:
        self[code] = self.make(chr(code))
        return self[code]


class Codec:
    """Encoder and decoder of one tokenizer file of the kind BPE with word ends.

    Refused are files that would need more than this encoder does: other models, unknown
    tokens, other ways to normalise and split, missing bytes, and added tokens that take
    neighbouring space or only match whole words.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        options = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not self.suffix or any(model.get(o) for o in options):
            raise ValueError("the model is not a plain BPE with word ends")
        steps = (stated["normalizer"] or {}).get("normalizers")
        ways = (stated["pre_tokenizer"] or {}).get("pretokenizers")
        split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        if steps != NORMAL or ways != [split, as_bytes]:
            raise ValueError("the tokenizer normalises or splits texts in another way")
        if stated.get("decoder"):
            raise ValueError("the tokenizer has a decoder of its own")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        added = {t["content"]: t["id"] for t in stated["added_tokens"]}
        if any(t[f] for t in stated["added_tokens"] for f in flags) or any(SPACE.search(t) for t in added):
            raise ValueError("the tokenizer has added tokens with conditions")
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

        self.ids = {self._symbols(token): i for token, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {}
        for order, (left, right) in enumerate(merges):
            self.rank[self._symbols(left), self._symbols(right)] = order
        alphabet = ByteLevel.alphabet()
        if any(c not in self.ids or chr(ord(c) + ENDS) not in self.ids for c in alphabet):
            raise ValueError("the model lacks bytes")
        # The library normalises and splits single chunks; words are encoded here.
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.out = {i: token for token, i in model["vocab"].items()} | {i: token for token, i in added.items()}
        self.ends = {c: chr(ord(c) + ENDS) for c in alphabet}
        self.characters = Characters(self.normal, self.split)
        self.endings = Endings(self.ids)
        self.fits: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _symbols(self, token: str) -> str:
        """A token as symbols: one for each byte, the last one marked if a word ends there."""
        if not token.endswith(self.suffix) or token == self.suffix:
            return token
        token = token.removesuffix(self.suffix)
        return token[:-1] + chr(ord(token[-1]) + ENDS)

    def merged(self, symbols: str) -> list[str]:
        """The tokens of a few symbols by merging: lowest rank first, then leftmost."""
        parts, rank = list(symbols), self.rank
        never = len(rank)
        while len(parts) > 1:
            ranks = [rank.get(pair, never) for pair in itertools.pairwise(parts)]
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether two tokens can be neighbours: merging their symbols gives them again."""
        if self.pairs >= PAIRS:
            self.fits.clear()
            self.pairs = 0
        self.pairs += 1
        fits = self.merged(left + right) == ([left, right] if left else [right])
        self.fits[left][right] = fits
        return fits

    def split_chunk(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space, as symbols, and ids of added tokens in it."""
        out: list[str | int] = []
        at = 0
        for found in self.special.finditer(chunk) if self.special else ():
            out += self.split_plain(chunk[at : found.start()])
            out.append(self.added[found.group()])
            at = found.end()
        return out + self.split_plain(chunk[at:]) if at else self.split_plain(chunk)

    def split_plain(self, part: str) -> list[str]:
        ends = self.ends
        if part.isascii() and part.isprintable():
            part = part.lower()
            if part.isalpha():
                return [part[:-1] + ends[part[-1]]]
            return [w[:-1] + ends[w[-1]] for w in ASCII_WORDS.findall(part)]
        if part and max(part) < COMBINING:
            words = self.characters.words(part)
        else:
            words = [w for w, _ in self.split(self.normal(part))]
        return [w[:-1] + ends[w[-1]] for w in words]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct words, given as symbols."""
        trie = Trie()
        for word in words:
            trie.insert(word)
        found: dict[str, tuple[int, ...]] = {}
        if len(self.endings.by_text) > ENDINGS:
            self.endings.start()
        ids, fits, after_symbol = self.ids, self.fits, self.endings.after
        # last[d]: the last token of the first d symbols; tail[d]: what they end with.
        last, tail = [""], [self.endings.nothing]
        waiting = [(0, edge) for edge in trie.root.values()]
        while waiting:
            depth, (label, after) = waiting.pop()
            del last[depth + 1 :], tail[depth + 1 :]
            ending = tail[depth]
            for end, symbol in enumerate(label, depth + 1):
                ending = ending[1].get(symbol) or after_symbol(ending, symbol)
                for token, size in ending[0]:
                    left = last[end - size]
                    good = fits[left].get(token)
                    if good or good is None and self.agree(left, token):
                        break
                else:
                    raise AssertionError(f"no last token after {ending[2]!r}")
                last.append(token)
                tail.append(ending)
            if not isinstance(after, str):
                depth = len(last) - 1
                waiting += [(depth, edge) for edge in after.values()]
                continue
            word, end = [], len(last) - 1
            while end:
                token = last[end]
                word.append(ids[token])
                end -= len(token)
            word.reverse()
            found[after] = tuple(word)
        return found

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of all given chunks; those of new words are found together."""
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.words) > WORDS:
            self.words.clear()
        fresh = {c: self.split_chunk(c) for c in chunks if c not in self.chunks}
        new = {w for found in fresh.values() for w in found if isinstance(w, str) and w not in self.words}
        self.words |= self.encode_words(new)
        ids, known = self.words, self.chunks
        for chunk, found in fresh.items():
            if len(found) == 1 and isinstance(found[0], str):
                known[chunk] = ids[found[0]]
            else:
                known[chunk] = tuple([i for w in found for i in ((w,) if isinstance(w, int) else ids[w])])
        for word in [w for w in new if len(w) > LONG]:
            del self.words[word]

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        """The ids of each text."""
        # Millions of small objects without cycles come and go here; looking for cycles would
        # cost a third of the time.
        gc.disable()
        try:
            cut = [BETWEEN.findall(text) for text in texts]
            chunks = set(itertools.chain.from_iterable(cut))
            self.learn(chunks)
            ids = self.chunks
            made = [list(itertools.chain.from_iterable(map(ids.__getitem__, part))) for part in cut]
            for chunk in [c for c in chunks if len(c) > LONG]:
                del ids[chunk]
            return made
        finally:
            gc.enable()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their tokens as the vocabulary writes them, with a space between."""
        return " ".join([self.out[i] for i in ids if i in self.out])


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK_CHARS, cut at white space; a longer word is not cut."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        space = SPACE.search(text, at + BLOCK_CHARS)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def blocks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Parts of texts with the number of the text, together about BLOCK_CHARS at a time."""
    block, size = [], 0
    for k, text in enumerate(texts):
        for piece in pieces(text):
            if block and size + len(piece) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((k, piece))
            size += len(piece)
    if block:
        yield block


class Digest:
    """The hash of values joined by spaces, which come in parts."""

    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, joined: str) -> None:
        self.hash.update((f" {joined}" if self.begun else joined).encode())
        self.begun = True


FIELDS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "decoded": (pa.string(), "string"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def tokenize(
    docs: DataFrame,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    fields: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """doc_id and the asked `fields` for every row: ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    Ids are those of the whole text without tokens added around it; added tokens that a text
    spells out are found in it. `decoded` is decoded from the ids, not copied from the text. A
    null text counts as empty and has no ids. Rows are handled one by one, so repeated rows and
    null ids stay as they are; no rows give no rows. Long texts are encoded in parts, cut at white
    space. Other columns of `docs` are not read. The tokenizer file must be at the same path on
    all machines.
    """
    columns = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("words", tokenizer_file), lambda: Codec(tokenizer_file))
        digits = {i: str(i) for i in codec.out}
        for batch in slices(batches, size=BLOCK_CHARS):
            texts = batch.column("_text").to_pylist()
            made = {
                "ids": [[] for _ in texts], "decoded": [[] for _ in texts], "n_tokens": [0] * len(texts),
                "ids_sha256": [Digest() for _ in texts], "decoded_sha256": [Digest() for _ in texts],
            }
            for block in blocks(texts):
                for (k, _), ids in zip(block, codec.encode_all(piece for _, piece in block), strict=True):
                    if not ids:
                        continue
                    made["n_tokens"][k] += len(ids)
                    if "ids" in fields:
                        made["ids"][k] += ids
                    if "ids_sha256" in fields:
                        made["ids_sha256"][k].add(" ".join(map(digits.__getitem__, ids)))
                    if "decoded" in fields or "decoded_sha256" in fields:
                        decoded = codec.decode(ids)
                        made["decoded_sha256"][k].add(decoded)
                        if "decoded" in fields:
                            made["decoded"][k].append(decoded)
            made["decoded"] = [" ".join(parts) for parts in made["decoded"]]
            for name in ("ids_sha256", "decoded_sha256"):
                made[name] = [digest.hash.hexdigest() for digest in made[name]]
            arrays = [batch.column("doc_id")] + [pa.array(made[f], FIELDS[f][0]) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *fields])

    id_type = columns.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{f} {FIELDS[f][1]}" for f in fields)])
    return columns.mapInArrow(run, schema)
