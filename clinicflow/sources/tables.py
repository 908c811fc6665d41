"""Reading and writing clinic tables as Parquet, with declared schemas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicflow.functions.scalars import end_seconds, stored
from clinicflow.sources.schemas import NOW, TABLES, TODAY, schema


def generated(table: str, df: DataFrame) -> DataFrame:
    """Add the columns a table derives from its own row."""
    if table == "appointments":
        return df.withColumn(
            "end_time", end_seconds(F.col("appointment_time"), F.col("duration_minutes"))
        )
    if table == "holidays":
        return df.withColumn("year", F.year("date"))
    if table == "inventory_items":
        return df.withColumn(
            "available_stock", stored(F.col("current_stock") - F.col("reserved_stock"))
        )
    if table == "inventory_movements":
        cost = F.abs("quantity") * F.coalesce(F.col("unit_cost"), F.lit(0))
        return df.withColumn("total_cost", stored(cost, 12))
    return df


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one table with its declared schema and derived columns."""
    return generated(table, spark.read.schema(schema(table)).parquet(path))


def fill_defaults(table: str, df: DataFrame, as_of: datetime) -> DataFrame:
    """Add the declared columns the input lacks, with their defaults.

    A column that is present keeps its NULLs: an explicit NULL is a violation, not a gap.
    """
    added: dict[str, Column] = {}
    for name, field in TABLES[table].items():
        if name in df.columns:
            continue
        value = {TODAY: as_of.date(), NOW: as_of}.get(field.default, field.default)
        added[name] = F.lit(value).cast(field.type)
    return df.withColumns(added) if added else df


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a table folder."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_snapshot(
    df: DataFrame, root: str, version: str, partition_by: list[str] | None = None
) -> str:
    """Write the next state of a table to a folder of its own and return that folder.

    An existing version is refused, so readers of the old state are never disturbed and a
    failed write can simply be repeated under the same name after it is cleaned up.
    """
    path = f"{root}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path

