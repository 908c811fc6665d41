"""A corpus through five stages: toxicity, exact and near duplicates, contamination, tokens.

Each stage works on what the one before kept; all but the last return the columns of documents.
`run` writes every stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinicflow.llm import decontamination, exact_dedup, near_dedup, sentencepieces, toxicity
from clinicflow.llm.queries import PIECE_MODEL, table
from clinicflow.llm.shared import written

# The executor's JVM has grown in the stages before, so workers remember fewer words than those of op1.
REMEMBERED = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fields = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return sentencepieces.tokenize(docs, PIECE_MODEL, fields=fields, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

# The models, the signatures and the encoder have no SQL; tests/llm/test_registered.py
# has slow twins of all stages but toxicity, whose rows it takes from the operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
