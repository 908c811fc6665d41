"""Invoices: line amounts, totals and consecutive numbers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.functions import texts
from clinicflow.functions.scalars import (
    blank,
    from_hundredths,
    hundredths,
    leading_number,
    padded,
    stored,
)
from clinicflow.operators.folds import Fold, Summary, run_fold
from clinicflow.operators.sequences import assign_numbers
from clinicflow.operators.skew import CHUNK_ROWS

CORRELATIVE_DIGITS = 8
LAST_CORRELATIVE = 10**CORRELATIVE_DIGITS - 1

TOTALS = {
    "subtotal": "subtotal", "discount_amount": "discount_amount",
    "tax_amount": "tax_amount", "total_amount": "total_price",
}


def line_amounts(details: DataFrame) -> DataFrame:
    """Gross, discount, subtotal, tax and total of each line, each rounded when stored.

    An amount that its column cannot hold is NULL, and so is all that follows from it;
    `lines_out_of_range` reports such lines.
    """
    percent = F.lit("0.01").cast("decimal(3,2)")
    return (
        details.withColumn("gross_amount", stored(F.col("quantity") * F.col("unit_price")))
        .withColumn(
            "discount_amount",
            stored(F.col("gross_amount") * F.col("discount_percentage") * percent, 8),
        )
        .withColumn("subtotal", stored(F.col("gross_amount") - F.col("discount_amount")))
        .withColumn(
            "tax_amount", stored(F.col("subtotal") * F.col("tax_percentage") * percent, 8)
        )
        .withColumn("total_price", stored(F.col("subtotal") + F.col("tax_amount")))
    )


def lines_out_of_range(lines: DataFrame) -> DataFrame:
    """Lines of `line_amounts` that the tables would refuse, because an amount does not fit."""
    given = [F.col(c).isNotNull() for c in ("quantity", "unit_price", "discount_percentage", "tax_percentage")]
    lost = F.col("total_price").isNull()
    for known in given:
        lost = lost & known
    return lines.filter(lost)


def invoice_totals(invoices: DataFrame, details: DataFrame) -> DataFrame:
    """Invoices with their four totals; an invoice without lines gets zeros.

    Lines are summed before they are shuffled, so a huge invoice costs no more than others.
    The sums run over whole cents, which is exact and cheaper than wide decimals. Lines whose
    amounts do not fit their columns would not be stored and do not count; a total that does
    not fit is NULL.
    """
    sums = details.filter(F.col("total_price").isNotNull()).groupBy(F.col("invoice_id").alias("id")).agg(
        *[F.sum(hundredths(F.col(line))).alias(f"_{total}") for total, line in TOTALS.items()]
    )
    kept = [c for c in invoices.columns if c not in TOTALS]
    return invoices.join(sums, "id", "left").select(
        *kept,
        *[from_hundredths(F.coalesce(F.col(f"_{t}"), F.lit(0))).alias(t) for t in TOTALS],
    )


def refresh_totals(
    invoices: DataFrame, details: DataFrame, touched: DataFrame
) -> DataFrame:
    """Recompute the totals of the invoices in `touched` (invoice_id) only."""
    ids = touched.select("invoice_id").distinct()
    mine = ids.select(F.col("invoice_id").alias("id"))
    fresh = invoice_totals(
        invoices.join(mine, "id", "left_semi"), details.join(ids, "invoice_id", "left_semi")
    )
    return invoices.join(mine, "id", "left_anti").unionByName(fresh.select(*invoices.columns))


def last_correlatives(invoices: DataFrame) -> DataFrame:
    """(series, last_number): the largest correlative used in each series."""
    return invoices.groupBy("series").agg(
        F.max(leading_number(F.col("correlative"))).alias("last_number")
    )


def number_invoices(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Number new invoices that bring no correlative, without gaps, in order of id.

    `correlative_overflow` marks invoices for which the series has no number left.
    """
    numbered = assign_numbers(new, ["series"], "id", last_correlatives(existing))
    kept = [c for c in new.columns if c not in ("correlative", "invoice_number")]
    fits = F.col("number") <= LAST_CORRELATIVE
    correlative = F.when(fits, padded(F.col("number"), CORRELATIVE_DIGITS))
    return numbered.withColumn("correlative", correlative).select(
        *kept, "correlative",
        F.concat("series", F.lit("-"), "correlative").alias("invoice_number"),
        (~fits).alias("correlative_overflow"),
    )


def admit_invoices(
    new: DataFrame, existing: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number new invoices of which some bring a correlative of their own.

    In order of id, an empty correlative takes the next number and a supplied one must be
    that number; otherwise the invoice is refused and the number stays free. An invoice is
    also refused when the series has no number left.
    """
    last = last_correlatives(existing).withColumnRenamed("last_number", "_last")
    opening = new.select("series").distinct().join(last, "series", "left").select(
        "series", F.coalesce("_last", F.lit(0)).cast("bigint").alias("_last")
    )
    given = F.when(~blank(F.col("correlative")), leading_number(F.col("correlative")))
    fold = Fold(
        keys=["series"],
        order=["id"],
        inputs=["_given"],
        state=["_last"],
        outputs=T.StructType(
            [T.StructField("_number", T.LongType()), T.StructField("is_accepted", T.BooleanType())]
        ),
        step=_next_correlative,
        summary=NumbersGiven,
    )
    folded = run_fold(new.withColumn("_given", given), opening, fold, chunk_rows)
    accepted = F.col("is_accepted")
    correlative = F.when(
        F.col("_given").isNull(), padded(F.col("_number"), CORRELATIVE_DIGITS)
    ).otherwise(F.col("correlative"))
    kept = [c for c in new.columns if c not in ("correlative", "invoice_number")]
    return folded.select(
        *kept,
        correlative.alias("correlative"),
        F.when(accepted, F.concat("series", F.lit("-"), correlative)).alias("invoice_number"),
        "is_accepted",
        F.when(~accepted, F.when(F.col("_given").isNull(), F.lit(texts.CODES_EXHAUSTED))
               .otherwise(F.lit(texts.NOT_SEQUENTIAL))).alias("message"),
    )


def _next_correlative(state: tuple | None, inputs: tuple) -> tuple[tuple, tuple]:
    (last,) = state or (0,)
    following = last + 1
    if following <= LAST_CORRELATIVE and inputs[0] in (None, following):
        return (following,), (following, True)
    return (last,), (inputs[0], False)


class NumbersGiven(Summary):
    """The last number after a chunk for any last number before it.

    Every empty correlative adds one. A supplied number adds one to those that stand right
    before it, which from then on go with those that stand on it: starts that ended side by
    side end together. So the starts of an end are always a range, and few ends have more
    than one start. Ends are kept without what all have added, to move none of them.
    """

    top = LAST_CORRELATIVE

    def __init__(self):
        self.ranges: dict[int, tuple[int, int] | None] = {}

    def add(self, inputs: tuple) -> None:
        (given,) = inputs
        if given is None:
            self.shift += 1
        elif given <= LAST_CORRELATIVE:
            before, on = given - 1 - self.shift, given - self.shift
            moved = self.ranges.get(before, (before, before))
            if moved is not None:
                there = self.ranges.get(on, (on, on))
                self.ranges[on] = (moved[0], there[1] if there else moved[1])
                self.ranges[before] = None

    def moves(self) -> Iterator[tuple[int, int]]:
        for end, starts in self.ranges.items():
            if starts is not None:
                yield from ((start, end) for start in range(starts[0], starts[1] + 1) if start != end)
