"""Movements that take from batches, against a plain loop, with and without hot-key chunks."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from test_folds import DAY0, ITEM, TYPES, make_items
from test_stock import rows_as

from clinicflow.functions import texts
from clinicflow.operators import inventory, movements

REQUEST = (
    "id bigint, item_id bigint, movement_type string, quantity decimal(10,2), unit_cost decimal(10,2), "
    "batch_number string, created_at timestamp"
)


def make_batches(spark, rnd):
    rows = [
        dict(id=10 * item + k, item_id=item, batch_number=name, quantity_current=Decimal(rnd.randint(0, 90)),
             quantity_received=Decimal(100), is_active=True)
        for item in (1, 2, 3, 4) for k, name in enumerate(["L-a", "L-b", "L-c"])
    ]
    return rows, rows_as(spark, "inventory_batches", rows)


def make_requests(spark, rnd, n):
    rows = []
    for k in range(n):
        item = rnd.choice([1, 1, 1, 2, 3, 4, 99])
        kind = rnd.choice(TYPES)
        sign = 1 if kind in ("purchase", "return") else rnd.choice([1, -1]) if kind == "adjustment" else -1
        batch = rnd.choice(["L-a", "l-A ", "L-b", "L-c", "unknown", None])
        cost = Decimal(rnd.randint(50, 900)) / 100
        rows.append((k, item, kind, sign * Decimal(rnd.randint(1, 1500)) / 100, cost, batch, DAY0 + timedelta(hours=5 * k)))
    mixed = rows[:]
    rnd.shuffle(mixed)
    return rows, spark.createDataFrame(mixed, REQUEST).repartition(5)


def by_hand(items, batches, requests):
    stock = {i[0]: i[2] for i in items if i[7]}
    left = {(b["item_id"], b["batch_number"].lower()): b["quantity_current"] for b in batches}
    out = {}
    for rid, item, kind, quantity, _, batch, _ in requests:
        if item not in stock:
            out[rid] = texts.UNKNOWN_ITEM
            continue
        outgoing = kind in ("consumption", "waste", "transfer", "expired")
        key = (item, (batch or "").lower().rstrip())
        after = stock[item] + quantity
        if after < 0 and outgoing:
            out[rid] = texts.NOT_ENOUGH
        elif after < 0 or (outgoing and left.get(key, 10**9) + quantity < 0):
            out[rid] = texts.MOVEMENT_FAILED
        else:
            out[rid], stock[item] = texts.MOVEMENT_DONE, after
            if outgoing and key in left:
                left[key] += quantity
    return out, stock, left


@pytest.mark.parametrize(("chunk_rows", "seed"), [(1_000_000, 1), (50, 1), (35, 2), (20, 3)])
def test_a_batch_of_movements(spark, chunk_rows, seed):
    rnd = random.Random(seed)
    items, item_df = make_items(spark)
    batches, batch_df = make_batches(spark, rnd)
    requests, request_df = make_requests(spark, rnd, 260)
    alerts = rows_as(spark, "inventory_alerts", [])
    expected, stock, left = by_hand(items, batches, requests)
    done = movements.post_batch(request_df, item_df, batch_df, alerts, chunk_rows=chunk_rows)
    assert {r.id: r.message for r in done.movements.collect()} == expected
    assert {texts.MOVEMENT_DONE, texts.MOVEMENT_FAILED, texts.NOT_ENOUGH} <= set(expected.values())
    after = {r.id: r.current_stock for r in done.items.collect()}
    assert {item: after[item] for item in stock} == stock
    shelves = {(r.item_id, r.batch_number.lower()): r.quantity_current for r in done.batches.collect()}
    assert shelves == left and min(left.values()) >= 0
    low = {r.item_id for r in done.alerts.filter("not is_resolved").collect()}
    minimum = {i[0]: i[4] for i in items}
    assert {i for i, amount in stock.items() if amount <= minimum[i]} <= low


def test_a_batch_runs_out_before_its_item(spark):
    items = spark.createDataFrame([(1, "x", Decimal(50), Decimal(0), Decimal(1), Decimal(1), None, True)], ITEM)
    batches = rows_as(spark, "inventory_batches", [
        dict(id=1, item_id=1, batch_number="A", quantity_current=Decimal(5), is_active=True),
        dict(id=2, item_id=1, batch_number="B", quantity_current=None, is_active=True),
    ])
    asked = [("consumption", -4, "A"), ("consumption", -2, "A"), ("adjustment", -9, "A"), ("purchase", 3, "A"),
             ("waste", -1, "A"), ("waste", -1, "A"), ("waste", -20, "B"), ("waste", -1, "C"), ("waste", -1, None)]
    rows = [(k, 1, kind, Decimal(q), None, batch, DAY0 + timedelta(hours=k)) for k, (kind, q, batch) in enumerate(asked)]
    requests = spark.createDataFrame(rows, REQUEST)
    got = inventory.post_movements(requests, items, batches=batches).orderBy("id").collect()
    refused = [r.id for r in got if r.message == texts.MOVEMENT_FAILED]
    assert refused == [1, 5] and got[-1].new_stock == Decimal(50 - 4 - 9 + 3 - 1 - 20 - 1 - 1)
    without = inventory.post_movements(requests, items).collect()
    assert all(r.is_accepted for r in without)


def test_no_movements(spark):
    _, items = make_items(spark)
    _, batches = make_batches(spark, random.Random(1))
    done = movements.post_batch(spark.createDataFrame([], REQUEST), items, batches, rows_as(spark, "inventory_alerts", []))
    assert done.movements.count() == done.alerts.count() == 0
    assert sorted(done.batches.collect()) == sorted(batches.collect())
