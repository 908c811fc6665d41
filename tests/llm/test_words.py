"""Word tokens against the library, on odd texts and whole tables."""

import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clinicflow.llm import word_bpe
from clinicflow.llm.queries import LLM_QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
DATA = Path("/root/testdata/sf0.001")
ODD = list("  aAbeEst'’.,!?019éÉİΣςßǅ漢\n\t\x0b\x1c\x85\xa0́​ 😀½Ⅷ") + [
    "'s", "'LL", "the", "ing", "</w>", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "é", "가", "가",
]


@pytest.fixture(scope="module")
def codec():
    return word_bpe.Codec(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def by_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@settings(max_examples=600, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD), max_size=40).map("".join)))
def test_words_are_the_librarys(codec, library, text):
    ids, decoded = by_library(library, text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == decoded


def test_white_space_is_the_librarys(library):
    normal = library.normalizer.normalize_str
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        assert bool(word_bpe.SPACE.match(chr(code))) == (normal(f"a{chr(code)}b") == "a b")


def test_every_character_is_split_as_by_the_library(codec, library):
    for code in range(1, 0x300):
        for text in (f"x{chr(code)}Y'S", f"!{chr(code)}?", f"1{chr(code)}2"):
            assert codec.encode(text) == by_library(library, text)[0]


def test_long_texts(codec, library, monkeypatch):
    texts = [
        "a" * 30_000, "abcde" * 9_000, "漢" * 5_000, "=" * 20_000, "<|endoftext|>" * 3_000,
        "the end " * 20_000, "x " + "lo" * 9_000 + " y", " " * 9_000, "há" * 4_000,
    ]
    for text in texts:
        assert codec.encode(text) == by_library(library, text)[0]
    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 50)
    for text in texts:
        assert "".join(word_bpe.pieces(text)) == text
        assert sum(map(codec.encode, word_bpe.pieces(text)), []) == by_library(library, text)[0]


def test_forgetting_changes_nothing(library, monkeypatch):
    for name in ("CHUNKS", "WORDS", "ENDINGS", "PAIRS"):
        monkeypatch.setattr(word_bpe, name, 20)
    codec = word_bpe.Codec(FILE)
    draw = random.Random(4)
    for _ in range(200):
        texts = [" ".join("".join(draw.choices("aeinrst", k=draw.randrange(1, 9))) for _ in range(30)) for _ in range(3)]
        assert codec.encode_all(texts) == [by_library(library, t)[0] for t in texts]
        assert len(codec.chunks) <= 20 + 90 and len(codec.words) <= 20 + 90


def test_shared_prefixes_are_walked_once(codec):
    words = ["in", "inter", "internal", "international"]
    marked = [w[:-1] + chr(ord(w[-1]) + word_bpe.ENDS) for w in words]
    trie = word_bpe.Trie()
    for word in [*marked, *marked]:
        trie.insert(word)

    def symbols(edges):
        return sum(len(label) + (0 if isinstance(after, str) else symbols(after)) for label, after in edges.values())

    assert symbols(trie.root) == len("international") + 3
    assert set(codec.encode_words(marked)) == set(marked)


def test_ids_without_tokens_are_left_out(codec, library):
    ids = [320, 49407, 10**6, 5]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def changed(tmp_path, change):
    with open(FILE, encoding="utf-8") as file:
        stated = json.load(file)
    change(stated)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(stated), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t["model"].update(end_of_word_suffix=None),
        lambda t: t["model"].update(unk_token="!"),
        lambda t: t["normalizer"]["normalizers"].pop(),
        lambda t: t["pre_tokenizer"]["pretokenizers"].pop(0),
        lambda t: t["added_tokens"][0].update(lstrip=True),
        lambda t: t["model"]["vocab"].pop("!</w>"),
        lambda t: t.update(decoder={"type": "BPEDecoder", "suffix": "</w>"}),
    ],
)
def test_other_tokenizers_are_refused(tmp_path, change):
    with pytest.raises(ValueError):
        word_bpe.Codec(changed(tmp_path, change))


def test_words_of_a_table(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 200)
    rows = [(1, "One  two\nthree", "x"), (None, None, "y"), (1, "One  two\nthree", "x"), (4, "", None)]
    rows += [(5, "wörter und <|endoftext|> " * 200, None), (6, " \t ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = word_bpe.tokenize(docs, FILE, fields=tuple(word_bpe.FIELDS)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        ids, decoded = by_library(library, texts[r.doc_id])
        assert (list(r.ids), r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert word_bpe.tokenize(docs.limit(0), FILE).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="test data not there")
def test_word_query(spark, library):
    expected = Counter()
    for doc, text in duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall():
        ids, decoded = by_library(library, text or "")
        joined = " ".join(map(str, ids))
        hashes = (hashlib.sha256(t.encode()).hexdigest() for t in (joined, decoded))
        expected[doc, len(ids), *hashes] += 1
    found = LLM_QUERIES["op13_word_bpe"](spark, str(DATA)).collect()
    assert Counter(map(tuple, found)) == expected
