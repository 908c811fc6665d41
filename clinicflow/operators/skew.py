"""Finding keys that hold too many rows for one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that one task may handle in order.
CHUNK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names for checkpoints.

    Only a local session without that setting falls back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="clinicflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/clinicflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positioned(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with `_chunk`, which does not decrease along the sort columns.

    Chunks are the partitions of a range partitioning, so they are about equally large however
    the columns are distributed, and a key with most of the rows has many of them. NULLs come
    first. The rows are written once, because the cut must be the same wherever it is used.
    """
    return written(rows.repartitionByRange(*by).withColumn("_chunk", F.spark_partition_id()))


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """(keys, count) of the keys with more than `limit` rows, or None if there are none.

    The counts are aggregated before they are shuffled, and at most rows / limit keys can
    qualify. The count runs at once, because most tables have no such key and then need no
    special treatment.
    """
    hot = rows.groupBy(*keys).count().filter(F.col("count") > limit)
    if hot.isEmpty():
        return None
    return written(hot)


def split(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys; NULL keys may be hot as well."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    rows, named, on = df.alias("d"), hot.select(*keys).alias("h"), reduce(Column.__and__, same)
    return rows.join(named, on, "left_anti"), rows.join(named, on, "left_semi")


def cut(
    rows: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int
) -> DataFrame:
    """Rows of hot keys with `_chunk`, which grows along a key's order.

    The rows are range-partitioned and sorted by key and order, so a chunk is at most
    `chunk_rows` consecutive rows however the order columns are distributed. They are written
    once, because the cut must not change when a task is repeated.
    """
    n_rows = hot.agg(F.sum("count")).first()[0]
    by = [*keys, *order]
    placed = (
        rows.repartitionByRange(-(-n_rows // chunk_rows), *by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # The id is the partition number, shifted left by 33 bits, plus the place inside it.
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    chunk = F.shiftleft(part, 33) + F.floor(inside / chunk_rows)
    return written(placed.withColumn("_chunk", chunk).drop("_place"))
