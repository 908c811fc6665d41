"""Streams: state carried between runs, refused rows, reminders."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinicflow.functions import texts
from clinicflow.streaming.reminders import plan_reminders
from clinicflow.streaming.sinks import run_available
from clinicflow.streaming.stock_state import track_stock

D = Decimal
DAY0 = datetime(2024, 1, 1)
MOVE = (
    "id bigint, item_id bigint, movement_type string, movement_category string, quantity decimal(10,2), "
    "unit_cost decimal(10,2), previous_stock decimal(10,2), new_stock decimal(10,2), created_at timestamp"
)
ITEM = (
    "id bigint, current_stock decimal(10,2), unit_cost decimal(10,2), "
    "last_purchase_cost decimal(10,2), is_active boolean"
)


def move(id, item, quantity, before, cost=None):
    kind, category = ("purchase", "in") if quantity > 0 else ("consumption", "out")
    return (id, item, kind, category, D(quantity), cost, D(before), D(before + quantity), DAY0 + timedelta(hours=id))


def test_stock_state_survives_a_restart(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, D(10), D("2.00"), None, True), (2, D(0), D(0), D(9), True), (3, D(5), D(1), None, False)], ITEM
    )
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), MOVE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], MOVE).schema).parquet(source)
        return run_available(track_stock(stream, items), folder, ("is_accepted",))

    arrive(move(2, 1, -4, 10), move(1, 1, 10, 20), move(3, 3, 1, 5))
    after = arrive(move(5, 1, 6, 6, D("5.00")), move(4, 1, -4, 10), move(6, 2, 3, 0), move(7, 99, 3, 0))
    rows = {r.id: r for r in after.collect()}
    assert [rows[n].message for n in range(1, 8)] == [
        texts.STALE_STOCK, None, texts.INACTIVE_ITEM, texts.STALE_STOCK, None, None, None,
    ]
    assert (rows[5].current_stock, rows[5].average_cost, rows[5].last_purchase_cost) == (D("12.00"), D("3.50"), D("5.00"))
    assert (rows[6].current_stock, rows[6].last_purchase_cost) == (D("3.00"), D("9.00"))
    assert sorted(p.name for p in (tmp_path / "out" / "rows").glob("is_accepted=*")) == [
        "is_accepted=false", "is_accepted=true",
    ]


def test_reminders_are_planned_once(spark, tmp_path):
    visits = "id bigint, appointment_date date, appointment_time int"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), visits).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], visits).schema).parquet(source)
        return run_available(plan_reminders(stream, date(2024, 1, 8)), folder)

    arrive((1, date(2024, 1, 9), 36000))
    plan = arrive((2, date(2024, 1, 10), 36000)).collect()
    assert sorted((r.appointment_id, r.hours_before) for r in plan) == [(1, 2), (1, 24), (2, 24)]
    with pytest.raises(ValueError, match="takes a stream"):
        plan_reminders(spark.createDataFrame([], visits), date(2024, 1, 8))


def test_missing_values_are_refused_and_change_nothing(spark, tmp_path):
    items = spark.createDataFrame([(1, D(10), None, None, True)], ITEM)
    rows = [list(move(k, 1, q, b, D("4.00"))) for k, q, b in ((1, 5, 10), (2, 5, 15), (3, 5, 15), (4, 5, 15))]
    rows[1][4], rows[2][7] = None, None
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([tuple(r) for r in rows], MOVE).write.parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame([], MOVE).schema).parquet(source)
    found = {r.id: r for r in run_available(track_stock(stream, items), folder).collect()}
    assert [found[k].message for k in (1, 2, 3, 4)] == [None, texts.INCOMPLETE_MOVEMENT, texts.INCOMPLETE_MOVEMENT, None]
    # An item without a cost counts as free, as in the batch form.
    assert (found[1].average_cost, found[3].average_cost, found[4].average_cost) == (D("1.33"), D("1.33"), D("2.00"))


def test_stock_state_does_not_depend_on_the_files(spark, tmp_path):
    items = spark.createDataFrame([(k, D(100), D(1), None, True) for k in range(3)], ITEM)
    stock, rows = {k: 100 for k in range(3)}, []
    for k in range(120):
        item, quantity = k % 3, (k * 7) % 11 - 5 or 1
        rows.append(move(k, item, quantity, stock[item] + (k % 17 == 0)))
        stock[item] += 0 if k % 17 == 0 else quantity
    df = spark.createDataFrame(rows, MOVE)
    results = []
    for n in (1, 6):
        source = str(tmp_path / f"in{n}")
        df.orderBy(F.desc("id")).coalesce(1).repartition(n).write.parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        found = run_available(track_stock(stream, items), str(tmp_path / f"out{n}"))
        results.append(sorted((r.id, r.is_accepted, r.current_stock) for r in found.collect()))
    assert results[0] == results[1]
    assert sum(accepted for _, accepted, _ in results[0]) > 90


def test_stock_state_of_a_hot_item_in_chunks(spark, tmp_path):
    items = spark.createDataFrame([(k, D(100), D(1), None, k < 2) for k in range(3)], ITEM)
    stock, rows = {k: 100 for k in range(3)}, []
    for k in range(240):
        item, quantity = (0, 1, 0, 2)[k % 4], (k * 7) % 11 - 5 or 1
        wrong = k % 17 == 0
        cost = D(k % 13 + 1) if quantity > 0 else None
        rows.append(move(k, item, quantity, stock[item] + wrong, cost))
        stock[item] += 0 if wrong or item == 2 else quantity
    source = str(tmp_path / "in")
    results = []
    for n, part in enumerate((rows[:100], rows[100:])):
        spark.createDataFrame(part, MOVE).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], MOVE).schema).parquet(source)
        results = [
            run_available(track_stock(stream, items, chunk_rows=limit), str(tmp_path / f"out{limit}"))
            for limit in (7, 1000)
        ]
    names = ("id", "is_accepted", "message", "current_stock", "average_cost", "last_purchase_cost")
    small, whole = (sorted(tuple(r[c] for c in names) for r in found.collect()) for found in results)
    assert small == whole and len(whole) == 240
    assert {(i, a) for i, a, *_ in whole} == {(k, k % 4 != 3 and k % 17 != 0) for k in range(240)}
