"""What the corpus operators share: tables in the cluster's shared folder, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see.

    A session on one machine that names none gets a new temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="clinicflow-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: fixed, computed once, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out from learning. Null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 3


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def whole(docs: DataFrame) -> Column:
    """All columns as one, `_doc`, so that their names cannot clash with an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_doc")


def give_back() -> None:
    """Return freed memory to the machine: a Python process otherwise keeps it for itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def forget(spark: SparkSession) -> None:
    """Let go of what Spark keeps for tables that nothing reads any more.

    It drops their shuffle files and broadcasts when the driver's garbage is collected, which without
    a call may be long after an operator of many tables has gone on.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], T] | None = None) -> T | None:
    """What a Python worker keeps from task to task, made when first asked for.

    Workers serve one operator after another; only what was asked for last is kept, so that the
    memory of one operator is free for the next. Without `make` everything is let go.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)
