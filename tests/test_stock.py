"""Stock labels, reports, batches and alerts at their limits."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinicflow.functions import texts
from clinicflow.operators import alerts as al
from clinicflow.operators import inventory
from clinicflow.sources.schemas import schema

D = Decimal
NOW = datetime(2024, 1, 15, 12)
TODAY = NOW.date()


def rows_as(spark, table, rows):
    """Rows given as dicts, with the table's declared types."""
    fields = schema(table)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


@pytest.mark.parametrize(
    ("current", "minimum", "maximum", "label"),
    [
        ("0", "0", None, texts.NO_STOCK), ("5", "10", None, texts.CRITICAL),
        ("5.01", "10", None, texts.LOW), ("10", "10", "10", texts.LOW),
        ("10.01", "10", None, texts.NORMAL), ("20", "10", "20", texts.EXCESS),
        ("19.99", "10", "20", texts.NORMAL), (None, "10", None, texts.NORMAL),
    ],
)
def test_stock_labels(spark, current, minimum, maximum, label):
    as_amount = lambda v: F.lit(v).cast("decimal(10,2)")
    column = inventory.stock_status(as_amount(current), as_amount(minimum), as_amount(maximum))
    assert spark.range(1).select(column).first()[0] == label


def test_movement_categories(spark):
    kinds = ["purchase", "RETURN ", "consumption", "waste", "expired", "transfer", "adjustment", "other"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = [r.c for r in df.select(inventory.movement_category(F.col("k")).alias("c")).collect()]
    assert got == ["in", "in", "out", "out", "out", "out", "adjustment", "adjustment"]


def item(id, stock, minimum=10, **more):
    base = dict(id=id, code=f"C{id}", name=f"item {id}", category_id=1, current_stock=D(stock),
                minimum_stock=D(minimum), unit_cost=D("2.50"), has_expiration=False, is_active=True,
                reserved_stock=D(0), created_at=datetime(2024, 1, 1), unit_of_measure="piece")
    return {**base, **more}


def test_critical_report_order_and_values(spark):
    items = rows_as(spark, "inventory_items", [
        item(1, 9), item(2, 5), item(3, 0), item(4, 11), item(5, 3, is_active=False), item(6, 4),
    ])
    categories = rows_as(spark, "inventory_categories", [dict(id=1, name="gloves")])
    movements = rows_as(spark, "inventory_movements", [
        dict(item_id=1, movement_type="purchase", created_at=datetime(2024, 1, 10, 23)),
        dict(item_id=1, movement_type="purchase", created_at=datetime(2024, 1, 5)),
        dict(item_id=2, movement_type="return", created_at=datetime(2024, 1, 14)),
    ])
    got = inventory.critical_stock_report(items, categories, movements, TODAY).collect()
    assert [(r.code, r.status, r.days_since_last_purchase) for r in got] == [
        ("C3", texts.NO_STOCK, 14), ("C6", texts.CRITICAL, 14), ("C2", texts.CRITICAL, 14),
        ("C1", texts.LOW, 5),
    ]
    assert {r.recommended_purchase_value for r in got} == {D("50.0000")}


def expiring(id, days, stock=5, **more):
    return item(id, stock, has_expiration=True, expiration_date=TODAY + timedelta(days=days), **more)


def test_expiration_feed_limits(spark):
    items = rows_as(spark, "inventory_items", [
        expiring(1, 7), expiring(2, 8), expiring(3, 15), expiring(4, 16), expiring(5, 30), expiring(6, 31),
        expiring(7, -1), expiring(8, 0), expiring(9, 40, expiration_alert_days=40), expiring(10, 3, stock=0),
        expiring(11, 3, is_active=False), item(12, 5, has_expiration=True),
    ])
    batches = rows_as(spark, "inventory_batches", [
        dict(id=2, item_id=1, batch_number="B2", quantity_current=D(0), is_active=True),
        dict(id=1, item_id=1, batch_number="B1", quantity_current=D(0), is_active=True),
        dict(id=3, item_id=2, batch_number="B3", quantity_current=D(0), is_active=False),
        dict(id=4, item_id=2, batch_number="B4", quantity_current=D(1), is_active=True),
    ])
    feed = al.expiration_feed(items, batches, NOW).collect()
    levels = {(r.item_id, r.alert_type): r.alert_level for r in feed}
    assert levels == {
        (1, "expiring_soon"): "critical", (2, "expiring_soon"): "warning", (3, "expiring_soon"): "warning",
        (4, "expiring_soon"): "info", (5, "expiring_soon"): "info", (7, "expiring_soon"): "critical",
        (7, "expired"): "critical", (8, "expiring_soon"): "critical", (9, "expiring_soon"): "info",
        (1, "batch_depleted"): "info",
    }
    titles = {(r.item_id, r.alert_type): (r.title, r.message) for r in feed}
    assert titles[1, "expiring_soon"] == ("Vence: item 1 (7 días)", 'Artículo "item 1" vence 22/01/2024')
    assert titles[1, "batch_depleted"][1] == 'Lote "B1" del artículo "item 1" se ha agotado'


def alert(id, item_id, kind, resolved=False, **more):
    base = dict(id=id, item_id=item_id, alert_type=kind, alert_level="info", title="old", message="old",
                is_read=False, is_resolved=resolved, created_at=datetime(2023, 12, 1))
    return {**base, **more}


def test_daily_run_refreshes_only_open_alerts(spark):
    items = rows_as(spark, "inventory_items", [expiring(1, 3), expiring(2, -2), expiring(3, 3)])
    batches = rows_as(spark, "inventory_batches", [])
    before = rows_as(spark, "inventory_alerts", [
        alert(1, 1, "expiring_soon"), alert(2, 2, "expired"), alert(3, 3, "expiring_soon", True),
        alert(4, 9, "low_stock", True, auto_resolve_date=NOW - timedelta(days=31)),
        alert(5, 9, "low_stock", True, auto_resolve_date=NOW - timedelta(days=30)),
        alert(6, 9, "overstock", False),
    ])
    after = {(r.id, r.item_id, r.alert_type): r for r in al.daily_alerts(before, items, batches, NOW).collect()}
    assert sorted(k[0] for k in after if k[0]) == [1, 2, 3, 5, 6]
    one = after[1, 1, "expiring_soon"]
    assert (one.title, one.alert_level, one.updated_at) == ("old", "critical", NOW) and one.message != "old"
    two = after[2, 2, "expired"]
    assert (two.message, two.alert_level, two.updated_at) == ("old", "info", NOW)
    assert after[3, 3, "expiring_soon"].updated_at is None
    assert after[None, 3, "expiring_soon"].is_resolved is False
    assert (None, 2, "expiring_soon") in after  # an expired item also counts as expiring


REQUEST = (
    "id bigint, item_id bigint, movement_type string, quantity decimal(10,2), "
    "unit_cost decimal(10,2), created_at timestamp"
)


def posted(spark, items, moves):
    rows = [(k, i, "purchase" if q > 0 else "consumption", D(q), None, NOW + timedelta(hours=k)) for k, (i, q) in enumerate(moves)]
    return inventory.post_movements(spark.createDataFrame(rows, REQUEST), items)


def test_low_stock_alerts_follow_the_movements(spark):
    items = rows_as(spark, "inventory_items", [item(1, 12), item(2, 3), item(3, 8), item(4, 50)])
    moves = [(1, -4), (1, -8), (1, 20), (1, -11), (2, 20), (3, -1), (4, -1)]
    standing = rows_as(spark, "inventory_alerts", [
        alert(1, 2, "low_stock"), alert(2, 3, "low_stock"), alert(3, 1, "expired"), alert(4, 1, "low_stock", True),
    ])
    done = posted(spark, items, moves)
    after = al.low_stock_alerts(standing, done, items).collect()
    assert len(after) == 6
    first, second = sorted((r for r in after if r.item_id == 1 and r.id is None), key=lambda r: r.created_at)
    assert (first.alert_level, first.title, first.current_value) == ("critical", "Stock bajo: item 1", D("0.00"))
    assert first.message == 'Artículo "item 1" - Stock actual: 8.00, Mínimo: 10.00'
    assert (first.is_resolved, first.resolved_at, first.updated_at) == (True, NOW + timedelta(hours=2), NOW + timedelta(hours=1))
    assert (second.alert_level, second.current_value, second.is_resolved) == ("warning", D("9.00"), False)
    by_id = {r.id: r for r in after if r.id}
    assert (by_id[1].is_resolved, by_id[1].alert_level, by_id[1].resolved_at) == (True, "info", NOW + timedelta(hours=4))
    assert (by_id[2].alert_level, by_id[2].current_value, by_id[2].title) == ("warning", D("7.00"), "old")
    assert by_id[4].is_resolved and by_id[3].alert_type == "expired"
    resolved = {r.id: r.is_resolved for r in al.resolve_replenished(standing, done).collect()}
    assert resolved == {1: True, 2: False, 3: False, 4: True}


def test_touched_expiring_alerts_of_empty_items_resolve(spark):
    items = rows_as(spark, "inventory_items", [item(1, 0), item(2, 1)])
    standing = rows_as(spark, "inventory_alerts", [
        alert(1, 1, "expiring_soon"), alert(2, 2, "expiring_soon"), alert(3, 1, "expired"), alert(4, 1, "expiring_soon"),
    ])
    touched = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    got = {r.id: r.is_resolved for r in al.resolve_empty(standing, items, touched, NOW).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_batches(spark):
    batches = rows_as(spark, "inventory_batches", [
        dict(id=1, item_id=1, batch_number="A", quantity_current=D(5), is_active=True),
        dict(id=2, item_id=1, batch_number="B", quantity_current=D(5), is_active=True),
        dict(id=3, item_id=2, batch_number="A", quantity_current=D(0), is_active=True),
    ])
    moves = rows_as(spark, "inventory_movements", [
        dict(item_id=1, batch_number="A", movement_category="out", quantity=D(-2)),
        dict(item_id=1, batch_number="A", movement_category="out", quantity=D(-4)),
        dict(item_id=1, batch_number="B", movement_category="in", quantity=D(4)),
        dict(item_id=2, batch_number=None, movement_category="out", quantity=D(-4)),
    ])
    got = {r.id: r.quantity_current for r in inventory.batch_balance(batches, moves).collect()}
    assert got == {1: D("-1.00"), 2: D("5.00"), 3: D("0.00")}
    judged = moves.withColumn("is_accepted", F.col("quantity") > -4)
    got = {r.id: r.quantity_current for r in inventory.batch_balance(batches, judged).collect()}
    assert got == {1: D("3.00"), 2: D("5.00"), 3: D("0.00")}
    assert {r.id: r.is_active for r in inventory.deactivate_batches(batches).collect()} == {1: True, 2: True, 3: False}


def test_pending_alert_priorities(spark):
    items = rows_as(spark, "inventory_items", [item(1, 1)])
    categories = rows_as(spark, "inventory_categories", [dict(id=1, name="gloves")])
    kinds = [("low_stock", "info"), ("low_stock", "warning"), ("low_stock", "critical"), ("expiring_soon", "critical"), ("expired", "info")]
    rows = [alert(n, 1, kind, alert_level=level) for n, (kind, level) in enumerate(kinds)]
    rows.append(alert(9, 1, "expired", True))
    got = al.pending_alerts(rows_as(spark, "inventory_alerts", rows), items, categories).collect()
    assert [(r.id, r.priority_order) for r in got] == [(4, 1), (3, 2), (2, 3), (1, 4), (0, 5)]


def test_open_alerts_are_counted(spark):
    items = rows_as(spark, "inventory_items", [item(1, 1), item(2, 30)]).withColumn("available_stock", F.lit(D("1.00")))
    categories = rows_as(spark, "inventory_categories", [dict(id=1, name="gloves")])
    rows = rows_as(spark, "inventory_alerts", [alert(1, 1, "low_stock"), alert(2, 1, "expired"), alert(3, 1, "expired", True)])
    got = {r.id: (r.stock_status, r.active_alerts) for r in inventory.inventory_status(items, categories, rows).collect()}
    assert got == {1: (texts.CRITICAL, 2), 2: (texts.NORMAL, 0)}
    assert isinstance(TODAY, date)


def test_a_second_depleted_batch_refreshes_the_first_alert(spark):
    items = rows_as(spark, "inventory_items", [{"id": n, "name": f"item {n}", "is_active": True} for n in (1, 2)])
    batches = rows_as(
        spark, "inventory_batches",
        [
            {"id": k, "item_id": item, "batch_number": f"L{k}", "quantity_current": D(0), "is_active": True}
            for k, item in ((1, 1), (2, 1), (3, 2))
        ],
    )
    after = al.daily_alerts(rows_as(spark, "inventory_alerts", []), items, batches, NOW)
    assert {r.item_id: r.updated_at for r in after.collect()} == {1: NOW, 2: None}


def test_names_sort_without_case_and_accents(spark):
    names = ["Zeta", "beta", "álcali", "Alfa"]
    items = rows_as(
        spark, "inventory_items",
        [
            {"id": k, "code": n, "name": n, "is_active": True, "current_stock": D(0), "minimum_stock": D(1),
             "unit_cost": D(1), "category_id": 1, "created_at": NOW}
            for k, n in enumerate(names)
        ],
    )
    report = inventory.critical_stock_report(
        items, rows_as(spark, "inventory_categories", [{"id": 1, "name": "c"}]), rows_as(spark, "inventory_movements", []), TODAY
    )
    assert [r.name for r in report.collect()] == ["álcali", "Alfa", "beta", "Zeta"]
