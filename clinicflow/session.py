"""Spark settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution merges small shuffle partitions and splits skewed joins; the operators
# leave both to it. Size the number of shuffle partitions for the cluster, not here.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # JSON text may repeat a key, as the tables allow.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and timing."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clinicflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
