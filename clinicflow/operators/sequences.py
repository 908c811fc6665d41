"""Running sums and numbers over ordered rows, without one task per large key.

A month or an invoice series may hold most of a table, so numbering never runs a window
over a whole key, and running sums only over keys with few rows. Rows are cut by position into chunks, the partitions of a range partitioning
by key and order; ids may have gaps, be negative or be hashed. The window runs inside a key's
rows of a chunk, and a second, small window over the chunk totals supplies what went before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicflow.functions.scalars import LAST_CODE, blank, code_number, month_key, padded
from clinicflow.operators.skew import CHUNK_ROWS, hot_keys, positioned, split


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition on equal keys; NULL equals NULL."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add inclusive running sums per key; only keys with more than `chunk_rows` rows are cut by position."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.sum(value).over(upto) for name, value in totals.items()}
    hot = hot_keys(df, keys, chunk_rows)
    if hot is None:
        return df.withColumns(sums)
    cold, large = split(df, hot, keys)
    cut = positioned(large, [*keys, *order])
    return cold.withColumns(sums).unionByName(
        bucketed_totals(cut, keys, F.col("_chunk"), order, totals).drop("_chunk")
    )


def bucketed_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Running sums per key with windows inside (key, bucket) only.

    `bucket` must not decrease along `order`. The rows are shuffled once, by (key, bucket); what
    is shuffled besides is one partially aggregated row per key and bucket.
    """
    cut = df.withColumn("_bucket", bucket)
    by_bucket = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = Window.partitionBy(*by_bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = cut.groupBy(*by_bucket).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    offsets = offsets.select(
        *by_bucket,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )
    local = cut.withColumns({name: F.sum(v).over(inside) for name, v in totals.items()})
    joined = local.alias("l").join(offsets.alias("o"), _same("l", "o", by_bucket), "left")
    summed = [
        (F.col(f"l.{name}") + F.coalesce(F.col(f"o._before_{name}"), F.lit(0))).alias(name) for name in totals
    ]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *summed)


def assign_numbers(
    new: DataFrame,
    keys: Sequence[str],
    order: str,
    base: DataFrame,
    supplied: str | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Add `number`: the next free number of the key as each row arrives, in the order of `order`.

    `base` holds (keys, last_number), one row per key, and may lack keys. A row whose
    `supplied` number is set keeps it, and later rows continue after the largest number
    seen so far, as if the rows had been inserted one by one. Rows that are not `wanted`
    get no number and use none up. Rows with a NULL order come first.
    """
    given = F.col(supplied) if supplied else F.lit(None).cast("bigint")
    wanted = F.coalesce(wanted, F.lit(False)) if wanted is not None else F.lit(True)
    cut = positioned(
        new.withColumns({"_given": F.when(wanted, given), "_needed": (wanted & given.isNull()).cast("int")}),
        [*keys, order],
    ).withColumnRenamed("_chunk", "_bucket")
    by_bucket = [*keys, "_bucket"]
    inside = Window.partitionBy(*by_bucket).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_count", F.sum("_needed").over(upto))
    if supplied:
        local = local.withColumn("_lead", F.col("_given") - F.col("_count"))
        totals = local.groupBy(*by_bucket).agg(
            F.sum("_needed").alias("_total"), F.max("_lead").alias("_peak")
        )
        local = local.withColumn("_lead", F.max("_lead").over(earlier))
    else:
        local = local.withColumn("_lead", F.lit(None).cast("bigint"))
        totals = cut.groupBy(*by_bucket).agg(
            F.sum("_needed").alias("_total"), F.lit(None).cast("bigint").alias("_peak")
        )

    # The numbers used before count as a bucket ahead of all others.
    used = base.select(
        *keys, F.lit(None).cast("int").alias("_bucket"), F.lit(0).cast("bigint").alias("_total"),
        F.col("last_number").cast("bigint").alias("_peak"), F.lit(True).alias("_used"),
    )
    before = Window.partitionBy(*keys).orderBy(F.col("_used").desc(), "_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        totals.withColumn("_used", F.lit(False)).unionByName(used)
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_peak", F.max(F.col("_peak") - F.col("_before")).over(before))
        .filter("not _used")
        .select(*by_bucket, "_before", "_peak")
    )
    start = F.greatest(F.lit(0), F.col("t._peak"), F.col("l._lead") - F.col("t._before"))
    next_free = F.col("t._before") + F.col("l._count") + start
    number = F.coalesce("l._given", F.when(F.col("l._needed") == 1, next_free))
    joined = local.alias("l").join(totals.alias("t"), _same("l", "t", by_bucket), "left")
    return joined.select(*[F.col(f"l.{c}") for c in new.columns], number.cast("bigint").alias("number"))


def code_prefix(code: Column) -> Column:
    """What a code has before its running number, `KIND-YYYYMM`; empty where it has no such form."""
    return F.regexp_extract(F.upper(code), r"^([A-Z]+-[0-9]{6})-", 1)


def last_codes(existing: DataFrame, code: str) -> DataFrame:
    """(code_prefix, last_number): the largest running number under each code prefix."""
    return (
        existing.select(code_prefix(F.col(code)).alias("code_prefix"), code_number(F.col(code)).alias("n"))
        .filter("code_prefix <> ''")
        .groupBy("code_prefix")
        .agg(F.max("n").alias("last_number"))
    )


def assign_codes(
    new: DataFrame,
    existing: DataFrame,
    kind: str,
    code: str,
    day: Column,
    order: str = "id",
    keep_supplied: bool = False,
    wanted: Column | None = None,
) -> DataFrame:
    """Give documents their monthly codes `KIND-YYYYMM-NNNN`.

    `new` may carry a `code` column; with `keep_supplied` its non-empty values stay and
    count. Adds `code_overflow`: true where the month has no code left, and then the
    code is NULL rather than a truncated number. Rows that are not `wanted` get no code.
    """
    month = F.concat(F.lit(f"{kind}-"), month_key(day))
    columns = [c for c in new.columns if c != code]
    wanted = F.coalesce(wanted, F.lit(False)) if wanted is not None else F.lit(True)
    own = F.col(code) if keep_supplied else F.lit(None).cast("string")
    keeps = wanted & ~blank(own)
    prefix = F.when(keeps, code_prefix(own)).otherwise(month)
    keyed = new.select(
        *columns,
        F.when(keeps, own).alias("_own"),
        prefix.alias("code_prefix"),
        F.when(keeps, code_number(own)).alias("_number"),
        wanted.alias("_wanted"),
    )
    numbered = assign_numbers(
        keyed,
        ["code_prefix"],
        order,
        last_codes(existing, code),
        supplied="_number" if keep_supplied else None,
        wanted=F.col("_wanted"),
    )
    fits = F.col("number") <= LAST_CODE
    made = F.concat(F.col("code_prefix"), F.lit("-"), padded(F.col("number"), 4))
    return numbered.select(
        *columns,
        F.coalesce(F.col("_own"), F.when(fits, made)).alias(code),
        F.coalesce(F.col("_own").isNull() & ~fits, F.lit(False)).alias("code_overflow"),
    )
