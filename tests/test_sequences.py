"""Numbering against plain loops, with several chunks per key."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinicflow.functions import texts
from clinicflow.operators import billing, sequences


@pytest.fixture
def pieces(spark):
    """Chunks stay as small as the range partitioning makes them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("stride", "first"), [(1, 0), (1_000_003, -50_000_000), (-7, 100)])
def test_numbers_continue_after_supplied_ones(spark, pieces, stride, first):
    rnd = random.Random(stride)
    last, rows, expected = {"a": 4, "b": 0}, [], {}
    for k in range(200):
        key = rnd.choice(["a", "a", "b"])
        given = last[key] + rnd.randint(-3, 6) if rnd.random() < 0.2 else None
        given = None if given is not None and given < 1 else given
        number = last[key] + 1 if given is None else given
        last[key] = max(last[key], number)
        rows.append((first + stride * k, key, given))
        expected[first + stride * k] = number
    if stride < 0:
        expected = None
    new = spark.createDataFrame(rows, "id bigint, k string, given bigint").repartition(4)
    base = spark.createDataFrame([("a", 4)], "k string, last_number bigint")
    got = {r.id: r.number for r in sequences.assign_numbers(new, ["k"], "id", base, "given").collect()}
    if expected is None:
        last, expected = {"a": 4, "b": 0}, {}
        for id, key, given in sorted(rows):
            expected[id] = last[key] + 1 if given is None else given
            last[key] = max(last[key], expected[id])
    assert got == expected


def test_a_key_is_cut_into_chunks(spark, pieces):
    from clinicflow.operators.skew import positioned

    rows = spark.range(4000).select((F.col("id") * 1_000_003).alias("id"), F.lit("x").alias("k"))
    sizes = [r["count"] for r in positioned(rows, ["k", "id"]).groupBy("_chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_null_keys_and_ids_are_numbered(spark, pieces):
    rows = [(None, "a"), (-5, "a"), (3, "a"), (1, None), (2, None)]
    base = spark.createDataFrame([("a", 7), (None, 1)], "k string, last_number bigint")
    new = spark.createDataFrame(rows, "id bigint, k string")
    got = sequences.assign_numbers(new, ["k"], "id", base).collect()
    assert {(r.id, r.k): r.number for r in got} == {
        (None, "a"): 8, (-5, "a"): 9, (3, "a"): 10, (1, None): 2, (2, None): 3,
    }


def test_unwanted_rows_use_no_number(spark, pieces):
    new = spark.range(50).withColumn("k", F.lit("x")).repartition(3)
    base = spark.createDataFrame([], "k string, last_number bigint")
    wanted = F.col("id") % 3 == 0
    got = sequences.assign_numbers(new, ["k"], "id", base, wanted=wanted)
    numbers = {r.id: r.number for r in got.collect()}
    assert [numbers[i] for i in range(0, 50, 3)] == list(range(1, 18))
    assert all(numbers[i] is None for i in range(50) if i % 3)


def test_month_runs_out_of_codes(spark):
    new = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    existing = spark.createDataFrame([("HC-202401-9997",), ("HC-202312-9999",)], "record_number string")
    coded = sequences.assign_codes(new, existing, "HC", "record_number", F.lit(date(2024, 1, 9)))
    rows = [(r.record_number, r.code_overflow) for r in coded.orderBy("id").collect()]
    assert rows == [("HC-202401-9998", False), ("HC-202401-9999", False), (None, True)]


def test_supplied_codes_stay_and_count(spark):
    new = spark.createDataFrame(
        [(1, ""), (2, "CITA-202401-0050"), (3, None), (4, "  ")], "id bigint, appointment_code string"
    )
    none = new.filter(F.lit(False))
    coded = sequences.assign_codes(
        new, none, "CITA", "appointment_code", F.lit(date(2024, 1, 9)), keep_supplied=True
    )
    codes = [r.appointment_code for r in coded.orderBy("id").collect()]
    assert codes == ["CITA-202401-0001", "CITA-202401-0050", "CITA-202401-0051", "CITA-202401-0052"]


def test_invoice_numbers_have_no_gaps(spark, pieces):
    new = spark.range(120).select(
        "id", F.when(F.col("id") % 4 == 0, "B001").otherwise("F001").alias("series"),
        F.lit(None).cast("string").alias("correlative"),
    )
    existing = spark.createDataFrame([("F001", "00000009"), ("F001", "10")], "series string, correlative string")
    numbered = billing.number_invoices(new, existing).collect()
    for series, first in (("F001", 11), ("B001", 1)):
        mine = sorted((r.id, r.invoice_number) for r in numbered if r.series == series)
        assert [n for _, n in mine] == [f"{series}-{first + k:08d}" for k in range(len(mine))]


def test_a_series_can_run_out_of_numbers(spark):
    new = spark.createDataFrame([(1, "F001", None), (2, "F001", ""), (3, "F001", "100000000")],
                                "id bigint, series string, correlative string")
    existing = spark.createDataFrame([("F001", "99999998")], "series string, correlative string")
    numbered = billing.number_invoices(new, existing).orderBy("id").collect()
    assert [(r.correlative, r.correlative_overflow) for r in numbered] == [("99999999", False), (None, True), (None, True)]
    admitted = billing.admit_invoices(new, existing).orderBy("id").collect()
    assert [r.message for r in admitted] == [None, texts.CODES_EXHAUSTED, texts.NOT_SEQUENTIAL]


def test_bucketed_totals_equal_plain_sums(spark):
    rows = [(k % 3, k, Decimal(k % 7 - 3)) for k in range(100)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, q decimal(10,2)").repartition(5)
    got = sequences.bucketed_totals(df, ["k"], F.floor(F.col("at") / 4), ["at"], {"s": F.col("q")})
    sums, expected = {}, {}
    for k, at, q in rows:
        sums[k] = sums.get(k, 0) + q
        expected[at] = sums[k]
    assert {r.at: r.s for r in got.collect()} == expected
