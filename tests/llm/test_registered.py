"""The registered corpus queries and the pipeline on given tables, against SQL and slow twins."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import sentencepiece
from test_duplicates import near_classes, without_repeats
from test_tokens_and_spans import MODEL, by_pattern, contaminated

import corpus_pipeline
from clinicflow.llm import toxicity
from clinicflow.llm.queries import LLM_ORACLE, LLM_QUERIES
from clinicflow.llm.shared import written

DATA = Path("/root/testdata/sf0.001")
given = pytest.mark.skipif(not DATA.exists(), reason="test data not there")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by 1").fetchall()


@given
@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        duck.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = duck.execute(LLM_ORACLE[name])
    columns = [d[0] for d in expected.description]
    found = LLM_QUERIES[name](spark, str(DATA))
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(columns).collect())) == Counter(expected.fetchall())


@given
def test_sentencepiece_query(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for doc, text in documents:
        ids = [*library.encode(text or ""), library.eos_id()]
        joined = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc, len(ids), joined, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = LLM_QUERIES["op1_sentencepiece"](spark, str(DATA)).collect()
    assert Counter(map(tuple, found)) == Counter(expected)


@given
def test_near_dedup_query(spark, documents):
    found = LLM_QUERIES["op3_near_dedup"](spark, str(DATA)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == near_classes(documents)


@given
def test_substring_query(spark, documents):
    found = LLM_QUERIES["op9_substring_dedup"](spark, str(DATA)).collect()
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert rows == without_repeats(documents)


@given
def test_personal_data_query(spark, documents):
    found = {r.doc_id: r for r in LLM_QUERIES["op7_pii"](spark, str(DATA)).collect()}
    for doc, text in documents:
        spans = by_pattern(text or "")
        joined = ",".join(f"{kind}:{a}:{b}" for kind, own in spans.items() for a, b in own)
        assert found[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert found[doc].spans.startswith(joined)
        assert found[doc].n_email == len(spans["email"]) and found[doc].n_phone == len(spans["phone"])


@given
@pytest.mark.parametrize("name", ["op2_url_filter", "op4_toxicity", "op5_quality", "op8_language"])
def test_learned_queries_have_a_row_for_each(spark, name):
    key, table = ("page_id", "pages") if name.startswith("op2") else ("doc_id", "documents")
    expected = duckdb.sql(f"select {key} from '{DATA}/{table}.parquet'").fetchall()
    assert Counter(LLM_QUERIES[name](spark, str(DATA)).select(key).toPandas()[key]) == Counter(k for (k,) in expected)


def small_tables(spark, folder):
    """Documents with every reason to be dropped, labels and a benchmark, as tables in a folder."""
    draw = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ri", "sto", "fi", "ma", "ho") for b in ("ver", "ne", "eld", "rket", "use", "ls")]
    items = [(k, " ".join(draw.choices(vocabulary, k=30))) for k in range(5)]
    docs, labels = [], []
    for k in range(240):
        words = draw.choices(vocabulary, k=draw.randrange(30, 90))
        toxic = k % 3 == 0
        if toxic:
            for _ in range(5):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "scum"]))
        if k % 10 == 4:
            words[5:5] = items[k % 5][1].split()
        docs.append([k, " ".join(words), "en", f"src{k % 3}", len(words)])
        labels.append((k, 1, int(toxic)))
    docs += [[300 + k, docs[k][1], "en", None, 0] for k in range(0, 200, 7)]
    docs += [[600 + k, docs[k][1].upper() + " end", "en", "src0", None] for k in range(0, 200, 11)]
    docs += [[900, None, None, None, None], [901, "", "de", "src1", 0]]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return items


def test_pipeline_stage_by_stage(spark, tmp_path):
    items = small_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
            judged = toxicity.toxicity(docs, labels)
            expected = {r.doc_id for r in judged.collect() if r.score < 0.7}
        elif name == "exact_dedup":
            last = {}
            for doc, text in sorted(before):
                last[text or ""] = doc
            expected = set(last.values())
        elif name == "near_dedup":
            expected = {c for _, c, _ in near_classes(before)}
        elif name == "decontamination":
            expected = {r[0] for r in contaminated(before, items) if not r[5]}
        else:
            expected = {doc for doc, _ in before}
        docs = written(stage(spark, docs, str(tmp_path)))
        assert {r.doc_id for r in docs.select("doc_id").collect()} == expected
        assert docs.count() == len(expected)
        assert len(expected) < len(before) or name == "sentencepiece"
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = dict(before)
    for r in docs.collect():
        assert list(r.ids) == [*library.encode(texts[r.doc_id] or ""), library.eos_id()]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(str, whole)) == Counter(map(str, docs.collect()))
