"""Fill-in-middle against cutting with the token pattern."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from clinicflow.llm import fill_in_middle
from clinicflow.llm.arrays import text_bytes

TOKENS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = list("  \n\t\x0b\x1c\x85\xa0aé漢😀") + ["<P>", "<S>", "<M>", "<", ">", "word"]


def by_pattern(doc_id, text):
    """(doc_id, n, form, prefix, middle, output, restored) by slow and plain means."""
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), max_size=6))
def test_cuts_at_all_tokens(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    cuts = fill_in_middle.Cuts(data, offsets)
    tokens = [TOKENS.findall(t) for t in texts]
    assert cuts.tokens.tolist() == [len(t) for t in tokens]
    for count in range(max(map(len, tokens), default=0) + 1):
        counts = np.minimum(count, cuts.tokens)
        ends = cuts.after(counts)
        heads = ["".join(t[:k]) for t, k in zip(tokens, counts, strict=True)]
        assert (ends - cuts.begin).tolist() == [len(h.encode()) for h in heads]
        assert cuts.characters(cuts.begin, ends).tolist() == [len(h) for h in heads]


def test_ranks():
    draw = np.random.default_rng(3)
    for size in (0, 1, 511, 512, 513, 4000):
        sequence = draw.integers(0, 5, size).astype(np.uint8)
        matrix = fill_in_middle.WaveletMatrix(sequence, 3)
        places = np.arange(size + 1)
        for symbol in range(5):
            expected = np.concatenate([[0], np.cumsum(sequence == symbol)])
            assert matrix.rank(symbol, places).tolist() == expected.tolist()


def test_texts_come_back():
    for text in ("a b c", "<P", "P>", "a <", "S> b", "<<", "M>"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                p, m, s = text[:a], text[a:b], text[b:]
                assert fill_in_middle.restored(f"<P>{p}<S>{s}<M>{m}".encode(), "psm") == text.encode()
                assert fill_in_middle.restored(f"<S>{s}<P>{p}<M>{m}".encode(), "spm") == text.encode()


def test_a_table(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices(ODD[:-6] + ["word", "ein"], k=draw.randrange(40))) for _ in range(300)]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    rows += [(None, "null id  here ", "x", 1), (400, None, None, None), (401, "", "x", 1), (402, " \n ", "x", 2)]
    rows += [(403, "twice over", "x", 1)] * 2 + [(k, f"has {s} in it", "x", 1) for k, s in enumerate(("<P>", "<S>", "<M>"), 500)]
    rows += [(600 + k, "long text é " * 30_000 + "end" * k, "x", 3) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, h1 long")
    expected = Counter(by_pattern(r[0], r[1])[:6] for r in rows)
    assert Counter(map(tuple, fill_in_middle.transform(docs).collect())) == expected
    assert {r[2] for r in expected} == {"plain", "spm", "psm"}
    hashed = fill_in_middle.transform(docs, fields=("output_sha256", "restored_sha256")).collect()
    digests = Counter()
    for r in rows:
        output, restored = by_pattern(r[0], r[1])[5:]
        digests[(r[0], *(hashlib.sha256(t.encode()).hexdigest() for t in (output, restored)))] += 1
    assert Counter(map(tuple, hashed)) == digests
    assert fill_in_middle.transform(docs.limit(0)).count() == 0
    assert fill_in_middle.transform(docs, plain=100).filter("form <> 'plain'").count() == 0
