"""Tokens, personal data and contamination against libraries and plain loops."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clinicflow.llm import decontamination, personal_data, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("  ▁▁abcdefghié漢\n\t0123.,<>😀") + ["    ", "the", "ing", "<0x0A>", "<s>", "</s>", "zzzz"]


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.Codec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)))
def test_encoding_is_the_librarys(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


def field(number, value):
    """A field of a model file; numbers here are below 128."""
    data = value if isinstance(value, bytes) else bytes([value])
    head = [number << 3 | 2, len(data)] if isinstance(value, bytes) else [number << 3]
    return bytes(head[:1] if head[0] < 128 else [head[0] & 127 | 128, head[0] >> 7]) + bytes(head[1:]) + data


@pytest.mark.parametrize(
    "change",
    [
        field(2, field(3, 1)),  # the public model as one of the unigram kind
        field(2, field(24, 1)),  # space marks behind the words
        field(1, field(1, b"<x>") + field(3, 4)),  # with a user-defined piece
        field(3, field(4, 1)),  # without extra spaces
        field(3, field(3, 0)),  # without a mark in front
        field(3, field(5, 0)),  # without marks
    ],
)
def test_models_that_need_more_are_refused(tmp_path, change):
    with open(MODEL, "rb") as file:
        data = file.read()
    path = tmp_path / "changed.model"
    path.write_bytes(data + change)
    sentencepiece.SentencePieceProcessor(model_file=str(path))
    with pytest.raises(ValueError):
        sentencepieces.Codec(str(path))


def test_normalising_models_are_refused():
    class Normalising:
        def serialized_model_proto(self):
            return field(2, field(3, 2)) + field(3, field(2, b"table") + field(4, 0))

    with pytest.raises(ValueError, match="normalises"):
        sentencepieces.refuse(Normalising())


def test_long_texts_without_spaces(codec, library):
    for text in ("a" * 30_000, "abcde" * 9_000, "漢" * 5_000, "=" * 20_000):
        assert codec.encode(text) == library.encode(text)


def test_decoding_any_ids(codec, library):
    draw = random.Random(3)
    for _ in range(500):
        ids = [draw.randrange(3, 259) if draw.random() < 0.5 else draw.randrange(32_000) for _ in range(9)]
        ids = [i for i in ids if i not in (0, 1, 2)]
        assert codec.decode(ids) == library.decode(ids)


def test_tokens_of_a_table(spark, library):
    rows = [(1, "one two  three", "x"), (None, None, "y"), (1, "one two  three", "x"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    fields = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    found = sentencepieces.tokenize(docs, MODEL, fields=fields).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == ["1", "1", "4", "None"]
    for r in found:
        text = "one two  three" if r.doc_id == 1 else ""
        ids = [*library.encode(text), library.eos_id()]
        assert (list(r.ids), r.decoded, r.n_tokens) == (ids, library.decode(ids), len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sentencepieces.tokenize(docs.limit(0), MODEL).count() == 0


def by_pattern(text):
    """The base spans by searching with the patterns as they are stated."""

    def digits(found):
        return re.sub(r"\D", "", found)

    def spans(pattern, good):
        return [m.span() for m in re.finditer(pattern, text) if good(m.group())]

    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": spans(
            r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and personal_data.luhn(digits(s))
        ),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }


def test_base_spans_follow_the_patterns():
    draw = random.Random(5)
    alphabet = "0123456789" * 2 + "  ..--++@@ab()é"
    for _ in range(20_000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        if draw.random() < 0.3:
            text = text.replace("é", "4111 1111 1111 1111").replace("a", "10.2.3")
        assert personal_data.base_spans(text) == by_pattern(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 300_000):
        personal_data.base_spans(text)


def test_personal_data_of_a_table(spark):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(i, f"word {secret} and more") for i in range(30)]
    rows += [(100, "mail a.b@example.com now"), (None, None), (102, "no data"), (102, "no data")]
    rows += [(103, "é 4111 1111 1111 1111 or +1 (651) 555-8500 or 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    assert found[100].spans == "email:5:20"
    assert found[100].base_sha256 == hashlib.sha256(b"email:5:20").hexdigest()
    assert found[None].spans == found[102].spans == ""
    assert found[103].spans == "ip:46:54,card:2:21,phone:25:42"
    assert found[3].spans == "secret:14:54" and found[3].n_secret == 1
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def contaminated(docs, items, window=13):
    """Contamination by looking at every window of every document."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(text):
        return pattern.findall((text or "").translate(lower))

    owners = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for k in range(len(found) - size + 1) if size else ():
            owners.setdefault(tuple(found[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        found, hit, named = words(text), set(), set()
        for size in {len(p) for p in owners}:
            for k in range(len(found) - size + 1):
                if tuple(found[k : k + size]) in owners:
                    hit.update(range(k, k + size))
                    named |= owners[tuple(found[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(found)))
    return out


def test_contamination_against_all_windows(spark, monkeypatch):
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)] + ["Äö", "漢字", "x9"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 3, 13, 20])))) for k in range(25)]
    items += [(90, None), (91, "..."), (7, "only here")]
    docs = [(k, ", ".join(draw.choices(vocabulary, k=draw.randrange(150))).upper()) for k in range(80)]
    docs += [(k, f"{items[3][1]} - {items[k % 20][1]}") for k in range(100, 130)]
    docs += [(None, None), (200, ""), (201, "!!"), (201, "!!"), (202, "Only\nHERE")]
    expected = Counter(contaminated(docs, items))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        found = decontamination.contamination(frame, bench)
        assert Counter(tuple(r)[:6] for r in found.collect()) == expected
    kept = decontamination.drop_contaminated(frame.withColumnRenamed("doc_id", "_doc"), bench)
    assert kept.columns == ["_doc", "text"]
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(e[0]) for e in expected.elements() if not e[5])
    assert decontamination.contamination(frame, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(frame.limit(0), bench).count() == 0


def test_fm_index_finds_all_occurrences():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(60):
        text = draw.integers(1, 5, draw.integers(1, 200))
        patterns = np.zeros((8, 6), np.int64)
        lengths = draw.integers(1, 7, 8)
        for k, n in enumerate(lengths):
            patterns[k, 6 - n :] = draw.integers(1, 6, n)
        which, at = decontamination.FMIndex(text).find(patterns, lengths)
        expected = {
            (k, i)
            for k, n in enumerate(lengths)
            for i in range(len(text) - n + 1)
            if (text[i : i + n] == patterns[k, 6 - n :]).all()
        }
        assert set(zip(which.tolist(), at.tolist(), strict=True)) == expected
        assert len(which) == len(expected)


def test_pieces_remember_no_more_words_than_asked(monkeypatch):
    codec = sentencepieces.Codec(MODEL, 40)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in range(200):
        text = f"word{n} and.{n}, the {n * n}!"
        assert codec.encode(text) == library.encode(text)
        assert len(codec.words) <= 40 and len(codec.parts) <= 40
    asked = {}
    monkeypatch.setattr(sentencepieces, "tokenize", lambda docs, model, **more: asked.update(more))
    corpus_pipeline.tokenize(None, None, "")
    assert asked["remembered"] == corpus_pipeline.REMEMBERED < sentencepieces.WORDS
