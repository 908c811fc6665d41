"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Frequent digests are found by the Misra-Gries counters behind `freqItems`, verified by a count,
and their winners broadcast, so rows of large groups of copies never meet in one task. The
remaining digests are grouped by an ordinary shuffle of (digest, id), never of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicflow.llm.shared import text_of, whole, written

# Share of the rows from which on a digest counts as frequent. Misra-Gries keeps 1 / SUPPORT
# counters, so at most so many winners are broadcast: 1,000 rows of about 100 bytes.
SUPPORT = 0.001


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, doc_id, text_sha256) of every row, written once so that `_row` stays the same."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(doc_id).alias("doc_id"),
            F.sha2(text_of(text).cast("binary"), 256).alias("text_sha256"),
        )
    )


def judge(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(_row, doc_id, keep_id, group_size, kept, text_sha256) for the rows of `digests`."""
    winner = (
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "_row")).alias("winner"),
    )
    frequent = rows.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    # Misra-Gries may name infrequent digests too; the exact count drops them. The aggregation
    # is partial before its shuffle, so a task sees each frequent digest once per input task.
    hot = (
        rows.join(F.broadcast(frequent), "text_sha256")
        .groupBy("text_sha256")
        .agg(*winner)
        .filter(F.col("group_size") > 1)
        .withColumnsRenamed({"group_size": "hot_size", "winner": "hot_winner"})
    )
    split = rows.join(F.broadcast(hot), "text_sha256", "left")
    columns = ("_row", "doc_id", "text_sha256", "group_size", "winner")
    large = split.filter("hot_size is not null").select(
        "_row", "doc_id", "text_sha256", F.col("hot_size").alias("group_size"), F.col("hot_winner").alias("winner")
    )
    rest = split.filter("hot_size is null").select("_row", "doc_id", "text_sha256")
    small = rest.join(rest.groupBy("text_sha256").agg(*winner), "text_sha256").select(*columns)
    return large.unionByName(small).select(
        "_row",
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("winner._row")).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 is; null counts as empty. Of equal texts the row with the
    largest doc_id stays. Null ids are smaller than all others, and of rows that also share
    the id exactly one is kept. Other columns of `docs` are not read. No rows give no rows.
    """
    return judge(digests(docs, doc_id, text), support).drop("_row")


def drop_exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = judge(digests(docs, doc_id, text), support).filter("kept").select("doc_id", "text_sha256").alias("k")
    tagged = docs.select(
        whole(docs),
        F.col(doc_id).alias("_id"),
        F.sha2(text_of(text).cast("binary"), 256).alias("_sha"),
    )
    same = F.col("_id").eqNullSafe(F.col("k.doc_id")) & (F.col("_sha") == F.col("k.text_sha256"))
    # Repeated rows are equal in id and text; the join has brought them together.
    return tagged.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_doc.*")
