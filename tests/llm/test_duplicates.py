"""Exact, near and substring duplicates against plain loops."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clinicflow.llm import exact_dedup, near_dedup, substring_dedup
from clinicflow.llm.shared import forget


def test_exact_duplicates_with_a_hot_text(spark):
    rows = [(i, "hot") for i in range(300)] + [(i, f"text {i % 90}") for i in range(300, 600)]
    rows += [(None, "hot"), (None, None), (1000, ""), (7, "hot"), (None, "alone"), (2000, "twice"), (2000, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    for support in (0.001, 0.2):
        found = exact_dedup.exact_duplicates(docs, text="body", support=support).collect()
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
        groups = {}
        for doc, text in rows:
            groups.setdefault(text or "", []).append(doc)
        expected = {}
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            expected[hashlib.sha256(text.encode()).hexdigest()] = (max(known) if known else None, len(ids))
        assert all((r.keep_id, r.group_size) == expected[r.text_sha256] for r in found)
        kept = [r for r in found if r.kept]
        assert sorted(r.text_sha256 for r in kept) == sorted(expected)
        assert all(r.doc_id == r.keep_id for r in kept)
    rest = exact_dedup.drop_exact_duplicates(docs.withColumnRenamed("doc_id", "_doc"), doc_id="_doc", text="body")
    assert rest.columns == ["_doc", "body"]
    assert sorted((r.body or "") for r in rest.collect()) == sorted(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0), text="body").count() == 0


def shingled(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def near_classes(docs):
    """Class of every row by comparing all pairs."""
    bags = [shingled(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            either = sum((bags[i] | bags[j]).values())
            if (either and both >= 0.8 * either) or (docs[i][1] or "") == (docs[j][1] or ""):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = {}
    for k, (doc, _) in enumerate(docs):
        classes.setdefault(root(k), []).append(doc)
    return Counter((d, min(c), len(c)) for c in classes.values() for d in c)


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(4)
    vocabulary = [f"word{k}" for k in range(400)]
    docs = []
    for k in range(60):
        words = draw.choices(vocabulary, k=draw.randrange(1, 160))
        docs.append((10 * k, " ".join(words)))
        for copy in range(draw.randrange(4)):
            changed = list(words)
            for _ in range(draw.randrange(0, 4)):
                changed[draw.randrange(len(changed))] = draw.choice(vocabulary)
            docs.append((10 * k + copy + 1, ", ".join(changed).upper()))
    # A common passage with little around it, repeated words, and texts without words.
    passage = " ".join(draw.choices(vocabulary, k=80))
    docs += [(1000 + k, f"{passage} {' '.join(draw.choices(vocabulary, k=k % 25))}") for k in range(40)]
    docs += [(2000 + k, "again and " * (40 + k)) for k in range(8)]
    docs += [(3000, None), (3001, ""), (3002, "..."), (3003, "..."), (3003, "...")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_dedup.near_duplicates(frame).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == near_classes(docs)
    kept = Counter(r.class_id for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.class_id for r in found}
    rest = near_dedup.drop_near_duplicates(frame.withColumnRenamed("text", "h1"), text="h1")
    assert rest.columns == ["doc_id", "h1"]
    assert Counter(r.doc_id for r in rest.collect()) == kept
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_with_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "A B C D E F"), (None, "q"), (None, "q")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in found) == [
        ("5", "5", 3), ("None", "5", 3), ("None", "5", 3), ("None", "None", 2), ("None", "None", 2),
    ]
    assert sum(r.kept for r in found) == 2


def edited_copies(seed, n, edits=4, size=200):
    """Copies that are alike to a text given after them, but not to each other."""
    draw = random.Random(seed)
    words = [f"s{seed}w{draw.randrange(10**6)}" for _ in range(size)]
    docs = []
    for k in range(n):
        copy = list(words)
        for e in range(edits):
            copy[draw.randrange(5 + e * size // edits, (e + 1) * size // edits - 5)] = f"s{seed}new{k}x{e}"
        docs.append(" ".join(copy))
    return [*docs, " ".join(words)]


def test_near_duplicates_of_edited_copies(spark):
    texts = [t for seed in range(6) for t in edited_copies(seed, 60)]
    docs = list(enumerate(texts))
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == near_classes(docs)


def test_broadcasts_of_finished_steps_are_forgotten(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore()
    docs = list(enumerate(t for seed in range(3) for t in edited_copies(seed, 20)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    forget(spark)
    time.sleep(2)  # Spark drops them in the background
    before = blocks.memoryUsed()
    near_dedup.near_duplicates(frame)
    time.sleep(2)
    kept = (blocks.memoryUsed() - before) / 1e6
    assert kept < 2, f"{kept:.1f} MB"


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        element = draw.integers(1, 1 << 62, 60).astype(np.uint64)
        a = draw.integers(0, 14, 60)
        b = np.where(draw.random(60) < 0.7, a, draw.integers(0, 14, 60))
        owner = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
        counts = np.concatenate([a[a > 0], b[b > 0]])
        s = near_dedup.signatures(owner, np.concatenate([element[a > 0], element[b > 0]]), counts, 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.06


def without_repeats(docs):
    """What is left of each text, by a set of all strings of 100 bytes seen so far."""
    seen, out = set(), []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcdeé \n", k=draw.randrange(60, 400))) for _ in range(8)]
    docs = []
    for k in range(n):
        parts = [draw.choice(pool)[draw.randrange(40) :] for _ in range(draw.randrange(3))]
        parts.append("".join(draw.choices("abcdeé \n", k=draw.randrange(150))))
        draw.shuffle(parts)
        docs.append((k, "".join(parts)))
    docs += [(n, "x" * 500), (n + 1, "ab" * 300), (n + 2, "x" * 99), (n + 3, ""), (n + 4, None), (n + 5, docs[0][1])]
    docs += [(n + 6, "word " * 200), (n + 7, "word " * 200 + pool[0]), (n + 8, "x" * 100)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_all_strings(spark, seed, monkeypatch):
    docs = corpus(seed, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    if seed == 2:
        monkeypatch.setattr(substring_dedup, "ARRAY_BYTES", 500)
    found = substring_dedup.remove_repeats(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == without_repeats(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_repeats_with_many_surroundings(spark, monkeypatch):
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    passage, texts = noise(300), []
    for _ in range(80):
        texts += [noise(80) + passage + noise(80)] * draw.randrange(1, 3)
        texts.append(texts[-1][:350] + noise(40))
    docs = [*enumerate(texts), (None, passage + noise(90))]
    limit, scan = 10, substring_dedup._scan_arrays

    def watched(batches):
        runs = Counter()
        for batch in batches:
            runs.update(batch.column("key").to_pylist())
            assert max(runs.values(), default=0) <= limit, "one anchor has too many runs for an array"
            yield from scan(iter([batch]))

    monkeypatch.setattr(substring_dedup, "ANCHOR_RUNS", limit, raising=False)
    monkeypatch.setattr(substring_dedup, "_scan_arrays", watched)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = substring_dedup.remove_repeats(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == without_repeats(docs)


def test_repeats_of_repeated_rows(spark):
    long = "".join(random.Random(1).choices("abcdef", k=300))
    rows = [(5, long), (5, long), (None, long + "zz"), (None, None), (6, "short"), (6, "short")]
    frame = spark.createDataFrame(rows, "h long, key string")
    found = substring_dedup.remove_repeats(frame, doc_id="h", text="key", kept_bytes=False)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in found.collect()) == [
        ("5", 300, 0), ("5", 300, 300), ("6", 5, 0), ("6", 5, 0), ("None", 0, 0), ("None", 302, 300),
    ]
    assert substring_dedup.remove_repeats(frame.limit(0), doc_id="h", text="key").count() == 0


def test_repeats_that_differ_before_and_in_the_last_bytes(spark):
    draw, runs = random.Random(7), []
    while not runs:
        text = "".join(draw.choices("abcdefgh", k=5_000))
        starts, counts, _ = substring_dedup.segments(np.frombuffer(text.encode(), np.uint8), np.array([0, 5_000]))
        runs = [text[s : s + 168] for s in starts[counts == 69].tolist()]
    # The longest runs: they share 166 bytes, and with some others the last as well.
    docs = [*enumerate(a + runs[0][1:167] + z for a in "abcdefgh" for z in "hgfedcba")]
    draw.shuffle(docs)
    found = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == without_repeats(
        sorted(docs)
    )


def anchors(n, each, draw):
    """Batches of sorted runs, `each` (at most 256) of an anchor, which share all but their first 14 bytes."""
    rows = []
    for key in range(n):
        common = draw.randbytes(120)
        rows += [(key, len(rows) + k, 0, 0, draw.randbytes(13) + bytes([k]) + common) for k in range(each)]
    names = ("key", "doc_id", "h", "start", "bytes")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.Table.from_arrays(columns, list(names)).to_batches(max_chunksize=999)


def test_arrays_are_bounded(monkeypatch):
    sizes, array = [], substring_dedup.SuffixArray

    def watched(data, offsets):
        sizes.append((len(data), len(offsets) - 1))
        return array(data, offsets)

    monkeypatch.setattr(substring_dedup, "SuffixArray", watched)
    # Within a batch, over two batches, and anchors that are larger than the bound by themselves.
    for limit, each in ((20_000, 5), (100_000, 5), (20_000, 250)):
        monkeypatch.setattr(substring_dedup, "ARRAY_BYTES", limit)
        sizes.clear()
        batches = anchors(3_000 // each, each, random.Random(each))
        found = [r for b in substring_dedup._scan_arrays(iter(batches)) for r in b.to_pylist()]
        assert Counter((r["doc_id"], r["start"], r["end"]) for r in found) == Counter(
            (d, 14, 134) for d in range(3_000) if d % each
        )
        assert sum(n for _, n in sizes) == 3_000
        assert all(size <= limit or n == each for size, n in sizes)


def test_memory_of_an_array():
    batches = anchors(1_500, 5, random.Random(1))
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in substring_dedup._scan_arrays(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 6_000
    # A megabyte of runs in one array; 75 bytes of working memory for each of theirs.
    assert peak < 75 * 7_500 * 134


def test_long_text_in_blocks(monkeypatch):
    draw = random.Random(3)
    data = np.frombuffer("".join(draw.choices("abcd", k=5_000)).encode(), np.uint8)
    offsets = np.array([0, 1_200, 1_250, 1_250, 4_000, 5_000])
    whole = substring_dedup.segments(data, offsets)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    blocks = substring_dedup.segments(data, offsets)

    def strings(found):
        return {(s + k, key) for s, n, key in zip(*(x.tolist() for x in found), strict=True) for k in range(n)}

    assert strings(whole) == strings(blocks)
    inside = {p for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in range(a, b - 99)}
    assert {s for s, _ in strings(whole)} == inside
