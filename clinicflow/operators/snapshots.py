"""Writes as new table states: upsert, conditional update, delete and delete propagation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicflow.sources.schemas import CASCADE, REFERENCES, RESTRICT, SET_NULL


def upsert(
    target: DataFrame, new: DataFrame, key: Sequence[str], update: dict[str, Column]
) -> DataFrame:
    """Insert rows whose key is new; where it exists, set the columns named in `update`.

    Update expressions refer to the stored row as `old` and to the incoming one as `new`.
    Both sides must be unique on the key. Columns the incoming rows lack are NULL on insert.
    """
    old = target.withColumn("_stored", F.lit(True)).alias("old")
    incoming = new.withColumn("_incoming", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    stored = F.col("_stored").isNotNull()
    matched = stored & F.col("_incoming").isNotNull()
    columns = []
    for name, kind in target.dtypes:
        inserted = F.col(f"new.{name}") if name in new.columns else F.lit(None).cast(kind)
        kept = F.when(stored, F.col(f"old.{name}")).otherwise(inserted)
        if name in update:
            kept = F.when(matched, update[name]).otherwise(kept)
        columns.append(kept.cast(kind).alias(name))
    return old.join(incoming, on, "full_outer").select(*columns)


def update_where(df: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows where the predicate holds."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()})


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Remove the rows where the predicate holds; unknown is not a match."""
    return df.filter(F.coalesce(~predicate, F.lit(True)))


def on_delete(
    child: DataFrame, column: str, deleted: DataFrame, action: str
) -> tuple[DataFrame, DataFrame]:
    """What deleting parent ids does to a child table: (child afterwards, blocked ids).

    `deleted` has one column `id`. A restricting key leaves the child as it is and reports
    the parents that are still in use; the caller must not delete those.
    """
    ids = deleted.select(F.col("id").alias(column)).distinct()
    nothing = ids.filter(F.lit(False)).withColumnRenamed(column, "id")
    if action == CASCADE:
        return child.join(ids, column, "left_anti"), nothing
    if action == SET_NULL:
        gone = ids.select(F.col(column), F.lit(True).alias("_gone"))
        kept = [c if c != column else F.when(F.col("_gone").isNull(), F.col(c)).alias(c) for c in child.columns]
        return child.join(gone, column, "left").select(*kept), nothing
    if action == RESTRICT:
        used = child.filter(F.col(column).isNotNull()).select(column).distinct()
        return child, ids.join(used, column, "left_semi").withColumnRenamed(column, "id")
    raise ValueError(f"unknown action {action!r}")


def delete_rows(
    tables: dict[str, DataFrame], table: str, gone: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete rows (`gone`: id) of a table with all that its references ask for.

    `tables` has the tables of the schema by name, each with an `id`; references from tables
    or by columns that are not there are passed over. Returns the tables afterwards and the ids
    that stay because a restricting reference still uses them, or a row that would go with them.
    Cascades go on to the rows that depend on deleted rows; columns that are set to NULL lose
    the references to any row deleted on the way.
    """
    asked = gone.select(F.col("id").alias("_row"), F.col("id").alias("_root")).distinct()
    doomed: list[tuple[str, DataFrame]] = []
    blocking: list[DataFrame] = []
    _follow(tables, table, asked, doomed, blocking)
    nothing = asked.select("_root").filter(F.lit(False))
    blocked = reduce(DataFrame.union, blocking, nothing).distinct()
    deleted: dict[str, DataFrame] = {}
    for name in {name for name, _ in doomed}:
        rows = reduce(DataFrame.union, [found for other, found in doomed if other == name])
        deleted[name] = rows.join(blocked, "_root", "left_anti").select(F.col("_row").alias("id")).distinct()
    after = {
        name: df.join(deleted[name], "id", "left_anti") if name in deleted else df for name, df in tables.items()
    }
    for name, column, parent, action in _references(tables):
        if action == SET_NULL and parent in deleted:
            after[name], _ = on_delete(after[name], column, deleted[parent], SET_NULL)
    return after, blocked.select(F.col("_root").alias("id"))


def _references(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, parent, action) of the references among the tables."""
    return [
        (name, column, parent, action)
        for name, df in tables.items()
        for column, (parent, action) in REFERENCES.get(name, {}).items()
        if column in df.columns and parent in tables
    ]


def _follow(
    tables: dict[str, DataFrame],
    table: str,
    rows: DataFrame,
    doomed: list[tuple[str, DataFrame]],
    blocking: list[DataFrame],
) -> None:
    """Collect the rows that go with `rows` (_row, _root), and the roots that something restricts.

    The schema's cascades have no cycles, so the walk ends.
    """
    doomed.append((table, rows))
    for name, column, parent, action in _references(tables):
        if parent != table or action == SET_NULL:
            continue
        found = tables[name].select(F.col(column).alias("_parent"), F.col("id").alias("_child"))
        hit = found.join(rows, F.col("_parent") == F.col("_row"))
        if action == RESTRICT:
            blocking.append(hit.select("_root").distinct())
        else:
            _follow(tables, name, hit.select(F.col("_child").alias("_row"), "_root").distinct(), doomed, blocking)
