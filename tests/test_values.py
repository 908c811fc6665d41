"""Column helpers and exact amounts."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinicflow.functions import scalars as s
from clinicflow.operators import billing

D = Decimal


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_helpers(spark):
    lit = F.lit
    assert one(spark, s.leading_number(lit("12ab")), s.leading_number(lit("x")), s.leading_number(lit(None).cast("string"))) == (12, 0, None)
    assert one(spark, s.code_number(lit("CITA-202401-0417")), s.code_number(lit("HC-202401-9999"))) == (417, 9999)
    assert one(spark, s.padded(lit(7), 4), s.padded(lit(10000), 4)) == ("0007", "1000")
    assert one(spark, s.folded(lit("HIGH  ")) == s.folded(lit("high"))) == (True,)
    assert one(spark, s.collated(lit("JOSÉ ")) == s.collated(lit("jose"))) == (True,)
    assert one(spark, s.blank(lit("  ")), s.blank(lit(None).cast("string")), s.blank(lit("a"))) == (True, True, False)


def test_time_helpers(spark):
    day = F.lit(date(2024, 1, 7))
    assert one(spark, s.iso_weekday(day), s.iso_weekday(F.lit(date(2024, 1, 8)))) == (7, 1)
    assert one(spark, s.moment(day, F.lit(-7200)), s.moment(day, F.lit(88200))) == (
        datetime(2024, 1, 6, 22), datetime(2024, 1, 8, 0, 30),
    )
    assert one(spark, s.month_key(day)) == ("202401",)


def test_changes_and_failed_checks_with_nulls(spark):
    null, t, f = F.lit(None).cast("boolean"), F.lit(True), F.lit(False)
    assert one(spark, s.fails(null), s.fails(t), s.fails(f)) == (False, False, True)
    n, a, b = F.lit(None).cast("int"), F.lit(1), F.lit(2)
    assert one(spark, s.changed(n, a), s.changed(a, n), s.changed(a, b), s.changed(a, a)) == (False, False, True, False)
    assert one(spark, s.changed_null_safe(n, a), s.changed_null_safe(n, n)) == (True, False)


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("{}", True), ("[1, 2]", True), ("null", True), (' "a" ', True), ("12", True), ('{"k": [1]}', True),
        ("", False), ("{", False), ('"k": 1}', False), ("1 2", False), ("1, 2", False), ("1],[2", False),
        ("1}", False), ("{'k': 1}", False), ("1,0],[", False), ('1,"b":2', False), (None, None),
    ],
)
def test_json_valid(spark, text, valid):
    assert one(spark, s.json_valid(F.lit(text).cast("string"))) == (valid,)


def test_json_object_keeps_nulls(spark):
    text = one(spark, s.json_object(a=F.lit(1), b=F.lit(None).cast("string")))[0]
    assert text == '{"a":1,"b":null}'


def test_hundredths_round_trip(spark):
    amount = F.lit(D("99999999.99"))
    assert one(spark, s.hundredths(amount), s.from_hundredths(s.hundredths(amount))) == (9999999999, D("99999999.99"))
    assert one(spark, s.from_hundredths(F.lit(-5).cast("bigint"))) == (D("-0.05"),)


LINE = (
    "invoice_id bigint, quantity int, unit_price decimal(8,2), "
    "discount_percentage decimal(5,2), tax_percentage decimal(5,2)"
)


def test_line_amounts_round_at_each_step(spark):
    rows = [(1, 1, D("0.10"), D("5.00"), D("18.00")), (1, 3, D("33.33"), D("12.50"), D("18.00")), (1, 2, None, D(0), D(18))]
    got = billing.line_amounts(spark.createDataFrame(rows, LINE)).collect()
    first = got[0]  # the discount is half a cent and rounds up
    assert (first.discount_amount, first.subtotal, first.tax_amount, first.total_price) == (D("0.01"), D("0.09"), D("0.02"), D("0.11"))
    second = got[1]  # 99.99 * 12.5 % = 12.49875
    assert (second.gross_amount, second.discount_amount, second.subtotal) == (D("99.99"), D("12.50"), D("87.49"))
    assert (second.tax_amount, second.total_price) == (D("15.75"), D("103.24"))
    assert got[2].total_price is None


def test_totals_of_an_invoice_without_lines(spark):
    lines = billing.line_amounts(spark.createDataFrame([(1, 1, D("10.00"), D(0), D(18))] * 2, LINE))
    invoices = spark.createDataFrame([(1,), (2,)], "id bigint")
    got = {r.id: tuple(r)[1:] for r in billing.invoice_totals(invoices, lines).collect()}
    assert got == {1: (D("20.00"), D("0.00"), D("3.60"), D("23.60")), 2: (D("0.00"),) * 4}


def test_refresh_touches_only_the_named_invoices(spark):
    lines = billing.line_amounts(spark.createDataFrame([(n, 1, D("10.00"), D(0), D(18)) for n in (1, 2)], LINE))
    stale = spark.createDataFrame([(n, D(7), D(7), D(7), D(7)) for n in (1, 2, 3)],
                                  "id bigint, " + ", ".join(f"{c} decimal(10,2)" for c in billing.TOTALS))
    touched = spark.createDataFrame([(1,), (3,), (1,)], "invoice_id bigint")
    got = {r.id: r.total_amount for r in billing.refresh_totals(stale, lines, touched).collect()}
    assert got == {1: D("11.80"), 2: D("7.00"), 3: D("0.00")}


def test_one_line_too_large_does_not_end_the_job(spark):
    rows = [(1, D(2), D("10.00"), D(0), D(18)), (1, D(10), D("99999999.00"), D(0), D(18)), (2, D(1), D("5.00"), D(0), D(0))]
    schema = (
        "invoice_id bigint, quantity decimal(10,2), unit_price decimal(10,2), discount_percentage decimal(5,2), "
        "tax_percentage decimal(5,2)"
    )
    lines = billing.line_amounts(spark.createDataFrame(rows, schema))
    assert [r.total_price for r in lines.collect()] == [D("23.60"), None, D("5.00")]
    assert [r.unit_price for r in billing.lines_out_of_range(lines).collect()] == [D("99999999.00")]
    totals = billing.invoice_totals(spark.createDataFrame([(1,), (2,)], "id bigint"), lines)
    assert {r.id: r.total_amount for r in totals.collect()} == {1: D("23.60"), 2: D("5.00")}


def test_json_with_repeated_keys_is_valid(spark):
    assert one(spark, s.json_valid(F.lit('{"a":1,"a":2}'))) == (True,)
