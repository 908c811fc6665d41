"""Declared constraints as violation reports.

Every report has `table_name`, `rule` and the id or key of the offending row. A table is
read once for all its row rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.functions.scalars import collated, fails, folded
from clinicflow.sources.schemas import REFERENCES, TABLES, UNIQUE

NAMES = ("name", "first_name", "last_name")


def violations(df: DataFrame, table: str, broken: dict[str, Column]) -> DataFrame:
    """One row per row and rule it breaks. A NULL verdict is not a violation."""
    named = [F.when(verdict, F.lit(rule)) for rule, verdict in broken.items()]
    verdicts = F.array_compact(F.array(*(named or [F.lit(None).cast("string")])))
    # Sound rows, which are nearly all, go before anything is exploded.
    found = df.select(F.col("id").alias("id"), verdicts.alias("rules")).filter(F.size("rules") > 0)
    return found.select(F.lit(table).alias("table_name"), F.explode("rules").alias("rule"), "id")


def stack(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def _declared(df: DataFrame, table: str):
    return [(n, f) for n, f in TABLES[table].items() if n in df.columns]


def missing_values(df: DataFrame, table: str, complete: bool = True) -> DataFrame:
    """Required columns that are NULL. A required column that the input lacks is NULL in every row,
    unless the input is said not to be `complete`, a projection of the table.
    """
    broken = {
        n: F.col(n).isNull() if n in df.columns else F.lit(True)
        for n, f in TABLES[table].items()
        if f.need and (complete or n in df.columns)
    }
    return violations(df, table, broken)


def out_of_domain(df: DataFrame, table: str) -> DataFrame:
    """Texts that are too long and numbers outside the range of their column."""
    broken = {}
    for name, field in _declared(df, table):
        if field.longest is not None:
            broken[f"{name} too long"] = F.char_length(F.col(name)) > field.longest
        if field.low is not None:
            broken[f"{name} too small"] = F.col(name) < field.low
        if field.high is not None:
            broken[f"{name} too large"] = F.col(name) > field.high
        if isinstance(field.type, T.DecimalType):
            limit = F.lit(10 ** (field.type.precision - field.type.scale))
            broken[f"{name} too large"] = F.abs(F.col(name)) >= limit
    return violations(df, table, broken)


def unknown_choices(df: DataFrame, table: str) -> DataFrame:
    """Values outside a column's list, compared without case and trailing spaces."""
    broken = {
        n: ~folded(F.col(n)).isin(*[c.lower() for c in f.choices])
        for n, f in _declared(df, table)
        if f.choices
    }
    return violations(df, table, broken)


def declared_violations(df: DataFrame, table: str) -> DataFrame:
    """All that the declarations say of single rows, in one look at each: required columns that are
    NULL (`missing`), texts `too long`, numbers `too small` or `too large`, and values `not permitted`.

    Columns that the input lacks are for `absent_columns`.
    """
    broken = {}
    for name, field in _declared(df, table):
        column = f"`{name}`"
        if field.need:
            broken[f"{name} missing"] = f"{column} is null"
        if field.longest is not None:
            broken[f"{name} too long"] = f"char_length({column}) > {field.longest}"
        if field.low is not None:
            broken[f"{name} too small"] = f"{column} < {field.low}"
        if field.high is not None:
            broken[f"{name} too large"] = f"{column} > {field.high}"
        if isinstance(field.type, T.DecimalType):
            broken[f"{name} too large"] = f"abs({column}) >= 1e{field.type.precision - field.type.scale}BD"
        if field.choices:
            choices = ", ".join(f"'{c.lower()}'" for c in field.choices)
            broken[f"{name} not permitted"] = f"lower(rtrim({column})) not in ({choices})"
    # One text for all rules: a thousand small expressions cost more time than the scan.
    cases = ", ".join(f"case when {verdict} then '{rule}' end" for rule, verdict in broken.items())
    found = df.selectExpr("cast(id as bigint) id", f"array_compact(array({cases})) rules").filter("size(rules) > 0")
    return found.selectExpr(f"'{table}' table_name", "explode(rules) rule", "id")


def absent_columns(spark: SparkSession, tables: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """One row, without id, for each required column without default that a table lacks, be it empty or not."""
    found = [
        (table, f"{name} absent", None)
        for table, df in tables
        for name, field in TABLES[table].items()
        if field.need and field.default is None and name not in df.columns
    ]
    return spark.createDataFrame(found, "table_name string, rule string, id bigint")


def failed_checks(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """Rows for which a declared check is false; unknown passes."""
    return violations(df, table, {rule: fails(condition) for rule, condition in checks.items()})


def _comparable(df: DataFrame, column: str) -> Column:
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column)
    return collated(F.col(column)) if column in NAMES else folded(F.col(column))


def _keys(df: DataFrame, table: str) -> list[tuple[str, ...]]:
    return [k for k in (("id",), *UNIQUE.get(table, ())) if set(k) <= set(df.columns)]


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[tuple[str, ...]] | None = None) -> DataFrame:
    """Primary and unique keys held by more than one row; keys with a NULL do not count.

    `key_value` shows the key as it was compared and `first_id` the lowest row that has it.
    `keys` are those to look at, all that the input has if not given.
    """
    reports = []
    for key in _keys(df, table) if keys is None else keys:
        compared = [_comparable(df, c).alias(f"_{n}") for n, c in enumerate(key)]
        shown = [F.col(f"_{n}").cast("string") for n in range(len(key))]
        reports.append(
            df.dropna(subset=list(key))
            .groupBy(*compared)
            .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
            .filter("copies > 1")
            .select(
                F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("rule"),
                F.concat_ws("|", *shown).alias("key_value"), "copies", "first_id",
            )
        )
    return stack(reports)


def orphans(df: DataFrame, table: str, parents: dict[str, DataFrame]) -> DataFrame:
    """Rows whose foreign key names no row of the parent.

    Columns with the same parent are checked together, on their distinct values, so a value
    that fills a third of the table is looked up once.
    """
    by_parent: dict[str, list[str]] = {}
    for column, (parent, _) in REFERENCES.get(table, {}).items():
        if column in df.columns and parent in parents:
            by_parent.setdefault(parent, []).append(column)
    reports = []
    for parent, columns in by_parent.items():
        stacked = df.select(
            "id",
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("bigint").alias("value")) for c in columns])
            ).alias("k"),
        ).select("id", "k.rule", "k.value").filter(F.col("value").isNotNull())
        known = parents[parent].select(F.col("id").cast("bigint").alias("value"))
        lost = stacked.select("value").distinct().join(known, "value", "left_anti")
        reports.append(
            stacked.join(lost, "value").select(
                F.lit(table).alias("table_name"),
                F.concat("rule", F.lit(f" -> {parent}")).alias("rule"), "id", "value",
            )
        )
    return stack(reports)


def repeated_keys(tables: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """The keys of many tables held by more than one row, as `duplicate_keys` reports them.

    Each table is read once and all keys share one shuffle, after they are counted where they were
    read. Keys with names in them compare by collation and go by themselves.
    """
    stacked, apart = [], []
    for table, df in tables:
        plain = [k for k in _keys(df, table) if not set(k) & set(NAMES)]
        named = [k for k in _keys(df, table) if set(k) & set(NAMES)]
        if named:
            apart.append(duplicate_keys(df, table, named))
        text = lambda c: f"lower(rtrim(`{c}`))" if isinstance(df.schema[c].dataType, T.StringType) else f"cast(`{c}` as string)"
        keys = ", ".join(f"struct('{','.join(k)}' as rule, array({', '.join(map(text, k))}) as key)" for k in plain)
        if plain:
            stacked.append(
                df.selectExpr(
                    f"'{table}' table_name", "id",
                    f"inline(filter(array({keys}), r -> not exists(r.key, v -> v is null)))",
                )
            )
    reports = apart
    if stacked:
        counted = stack(stacked).groupBy("table_name", "rule", "key").agg(
            F.count("*").alias("copies"), F.min("id").alias("first_id")
        )
        shown = F.concat_ws("|", "key").alias("key_value")
        reports = [counted.filter("copies > 1").select("table_name", "rule", shown, "copies", "first_id"), *apart]
    return stack(reports)


def lost_references(
    children: Iterable[tuple[str, DataFrame]], parents: dict[str, DataFrame]
) -> DataFrame:
    """Rows of many tables whose foreign keys name no row of their parents.

    Each child is read once, and the references of all to all parents are settled by one join on
    (parent, value). Rows stay single in it, so a value that fills a third of a table, lost or not, is
    spread by adaptive skew splitting; parents are broadcast only by Spark's own size check.
    """
    stacked = []
    for table, df in children:
        found = [(c, p) for c, (p, _) in REFERENCES.get(table, {}).items() if c in df.columns and p in parents]
        if found:
            each = ", ".join(
                f"struct('{c} -> {p}' as rule, '{p}' as parent, cast(`{c}` as bigint) as value)" for c, p in found
            )
            stacked.append(
                df.selectExpr(
                    f"'{table}' table_name", "cast(id as bigint) id",
                    f"inline(filter(array({each}), r -> r.value is not null))",
                )
            )
    known = stack([df.selectExpr(f"'{p}' parent", "cast(id as bigint) value") for p, df in parents.items()])
    return stack(stacked).join(known, ["parent", "value"], "left_anti").select("table_name", "rule", "id", "value")
