"""Running a stream over what is there and reading back what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicflow.operators.skew import shared_folder


@dataclass(frozen=True)
class Batches:
    """A stream whose rows are judged as one ordered batch per run, with states carried between runs.

    `judge(rows, states)` returns the judged rows and the next states; `states` is None at first.
    """

    source: DataFrame
    judge: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def run_available(
    stream: DataFrame | Batches, folder: str | None = None, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Process all input that is available now, append it as Parquet, and read the output.

    Progress and state live beside the output in `folder`, so a later call with the same
    folder continues where this one ended. Without one, a new folder of the session's shared
    checkpoint folder is used.
    """
    source = stream.source if isinstance(stream, Batches) else stream
    folder = folder or f"{shared_folder(source.sparkSession)}/clinicflow-stream-{uuid.uuid4().hex}"
    if isinstance(stream, Batches):
        return _run_batches(stream, folder, partition_by)
    return _append(stream, f"{folder}/rows", f"{folder}/progress", partition_by)


def _append(stream: DataFrame, path: str, progress: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _run_batches(stream: Batches, folder: str, partition_by: tuple[str, ...]) -> DataFrame:
    """Collect what arrived, judge it, and read all judged rows.

    A run counts as done when its states are there; one that was broken off is judged again from
    the same files of arrivals and replaces what it had written.
    """
    spark = stream.source.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda table: system.exists(paths(f"{folder}/{table}/_SUCCESS"))
    names = lambda n: {r.file for r in spark.read.schema("file string").parquet(f"{folder}/files/{n}").collect()}
    arrived = _append(stream.source, f"{folder}/arrived", f"{folder}/progress")
    run, done, shape = 0, set(), None
    while there(f"states/{run}"):
        done |= names(run)
        run += 1
    while True:
        if not there(f"files/{run}"):
            fresh = sorted({f.rsplit("/", 1)[-1] for f in arrived.inputFiles()} - done)
            if run and not fresh:
                break
            listed = spark.createDataFrame([(f,) for f in fresh], "file string")
            listed.write.mode("overwrite").parquet(f"{folder}/files/{run}")
        new = names(run)
        rows = arrived.limit(0)
        if new:
            rows = spark.read.schema(arrived.schema).parquet(*[f"{folder}/arrived/{f}" for f in sorted(new)])
        states = spark.read.parquet(f"{folder}/states/{run - 1}") if run else None
        judged, following = stream.judge(rows, states)
        tagged = judged.withColumn("_run", F.lit(run))
        output = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        output.partitionBy(*partition_by, "_run").parquet(f"{folder}/rows")
        following.write.mode("overwrite").parquet(f"{folder}/states/{run}")
        shape = tagged.schema
        done |= new
        run += 1
        if not new:
            break
    if shape is None:
        shape = stream.judge(arrived.limit(0), None)[0].withColumn("_run", F.lit(0)).schema
    return spark.read.schema(shape).parquet(f"{folder}/rows").drop("_run")
