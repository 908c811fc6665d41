"""Order-dependent operators against plain loops, with and without hot-key chunks."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from clinicflow.functions import texts
from clinicflow.operators import billing, folds, inventory

DAY0 = datetime(2024, 1, 1, 8)
CENT = Decimal("0.01")
D0 = Decimal(0)
ITEM = (
    "id bigint, name string, current_stock decimal(10,2), reserved_stock decimal(10,2), "
    "minimum_stock decimal(10,2), unit_cost decimal(10,2), last_purchase_cost decimal(10,2), "
    "is_active boolean"
)
REQUEST = (
    "id bigint, item_id bigint, movement_type string, quantity decimal(10,2), "
    "unit_cost decimal(10,2), created_at timestamp"
)
TYPES = ["purchase", "return", "consumption", "waste", "transfer", "expired", "adjustment"]


def make_items(spark):
    rows = [
        (n, f"item {n}", Decimal(10 * n), Decimal(0), Decimal(5), Decimal(3), None, n != 3)
        for n in range(1, 5)
    ]
    return rows, spark.createDataFrame(rows, ITEM)


def make_requests(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        item = rnd.choice([1, 1, 1, 2, 3, 4, 99])  # item 1 is hot, 3 inactive, 99 unknown
        kind = rnd.choice(TYPES + ["mystery"])
        size = Decimal(rnd.randint(1, 1500)) / 100
        sign = 1 if kind in ("purchase", "return") else rnd.choice([1, -1]) if kind == "adjustment" else -1
        if rnd.random() < 0.03:
            sign = -sign
        cost = None if rnd.random() < 0.3 else Decimal(rnd.randint(50, 900)) / 100
        quantity = None if rnd.random() < 0.02 else sign * size
        rows.append((k, item, kind, quantity, cost, DAY0 + timedelta(hours=5 * k)))
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, REQUEST).repartition(5)


def post_by_hand(items, requests):
    """The same outcome computed with exact fractions, one request after the other."""
    state = {i[0]: [i[2], i[5], i[6]] for i in items if i[7]}
    out = {}
    for rid, item, kind, quantity, cost, _ in requests:
        incoming = kind in ("purchase", "return")
        outgoing = kind in ("consumption", "waste", "transfer", "expired")
        if item not in state:
            out[rid] = (texts.UNKNOWN_ITEM, None, None, None)
            continue
        stock, average, last = state[item]
        after = None if quantity is None else stock + quantity
        if after is not None and outgoing and after < 0:
            out[rid] = (texts.NOT_ENOUGH, None, average, last)
            continue
        bad_sign = quantity is not None and ((incoming and quantity <= 0) or (outgoing and quantity >= 0))
        if after is None or kind == "mystery" or bad_sign or after < 0:
            out[rid] = (texts.MOVEMENT_FAILED, None, average, last)
            continue
        if incoming and cost is not None:
            if stock > 0:
                cents = (stock * average + quantity * cost) * 100
                units = stock + quantity
                average = Decimal(int((2 * cents + units) // (2 * units))) * CENT
            else:
                average = cost
            if kind == "purchase":
                last = cost
        state[item] = [after, average, last]
        out[rid] = (texts.MOVEMENT_DONE, after, average, last)
    return out, state


@pytest.mark.parametrize(("chunk_rows", "seed"), [(1_000_000, 1), (50, 1), (40, 2)])
def test_posting_matches_a_plain_loop(spark, chunk_rows, seed):
    items, item_df = make_items(spark)
    requests, request_df = make_requests(spark, seed, 250)
    expected, state = post_by_hand(items, requests)
    posted = inventory.post_movements(request_df, item_df, chunk_rows=chunk_rows)
    got = {
        r.id: (r.message, r.new_stock, r.average_cost, r.last_purchase_cost) for r in posted.collect()
    }
    assert got == expected
    after = {r.id: (r.current_stock, r.unit_cost) for r in inventory.item_state_after(item_df, posted).collect()}
    for item, (stock, average, _) in state.items():
        assert after[item] == (stock, average)


def test_documented_average_cost_example(spark):
    items = spark.createDataFrame(
        [(1, "x", Decimal(0), Decimal(0), Decimal(1), Decimal(0), None, True)], ITEM
    )
    requests = spark.createDataFrame(
        [
            (1, 1, "purchase", Decimal(10), Decimal(2), DAY0),
            (2, 1, "consumption", Decimal(-4), None, DAY0),
            (3, 1, "purchase", Decimal(6), Decimal(5), DAY0),
        ],
        REQUEST,
    )
    costs = [r.average_cost for r in inventory.post_movements(requests, items).orderBy("id").collect()]
    assert costs == [Decimal("2.00"), Decimal("2.00"), Decimal("3.50")]
    written = inventory.post_movements(requests, items, basis="as_written").orderBy("id").collect()
    # Weighing the stock after the row: (10*0 + 10*2) / 20, then (12*1 + 6*5) / 18.
    assert [r.average_cost for r in written] == [Decimal("1.00"), Decimal("1.00"), Decimal("2.33")]


def test_refused_movement_leaves_stock_for_the_next(spark):
    items = spark.createDataFrame(
        [(1, "x", Decimal(5), Decimal(0), Decimal(1), Decimal(1), None, True)], ITEM
    )
    requests = spark.createDataFrame(
        [
            (1, 1, "consumption", Decimal(-6), None, DAY0),
            (2, 1, "consumption", Decimal(-5), None, DAY0),
            (3, 1, "adjustment", Decimal(-1), None, DAY0),
        ],
        REQUEST,
    )
    rows = inventory.post_movements(requests, items).orderBy("id").collect()
    assert [r.message for r in rows] == [texts.NOT_ENOUGH, texts.MOVEMENT_DONE, texts.MOVEMENT_FAILED]
    assert rows[1].new_stock == 0


def test_items_without_stock_or_minimum(spark):
    items = spark.createDataFrame(
        [(1, "x", None, D0, D0, D0, None, True), (2, "y", D0, D0, None, None, None, True)], ITEM
    )
    requests = spark.createDataFrame(
        [(1, 1, "purchase", Decimal(1), None, DAY0), (2, 2, "purchase", Decimal(1), Decimal(2), DAY0)], REQUEST
    )
    rows = inventory.post_movements(requests, items).orderBy("id").collect()
    assert [r.message for r in rows] == [texts.UNKNOWN_ITEM, texts.MOVEMENT_DONE]
    assert (rows[1].average_cost, rows[1].is_low, rows[1].is_refilled) == (Decimal("2.00"), False, False)


def test_two_batches_end_like_one(spark):
    _, items = make_items(spark)
    _, requests = make_requests(spark, 5, 200)
    whole = inventory.item_state_after(items, inventory.post_movements(requests, items))
    first = inventory.post_movements(requests.filter("id < 120"), items)
    middle = inventory.item_state_after(items, first)
    second = inventory.post_movements(requests.filter("id >= 120"), middle)
    assert sorted(inventory.item_state_after(middle, second).collect()) == sorted(whole.collect())


CLAIM = (
    "id bigint, item_id bigint, movement_type string, movement_category string, "
    "quantity decimal(10,2), previous_stock decimal(10,2), new_stock decimal(10,2), "
    "approval_required boolean, is_approved boolean, created_at timestamp"
)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 40])
def test_validation_matches_a_plain_loop(spark, chunk_rows):
    rnd = random.Random(3)
    items, item_df = make_items(spark)
    rows = []
    for k in range(250):
        item = rnd.choice([1, 1, 1, 2, 3])
        was, becomes = rnd.choice([0, 10, 20, 150]), rnd.choice([0, 10, 20, 150])
        kind = "adjustment" if was == becomes else "purchase" if becomes > was else "waste"
        cat = {"adjustment": "adjustment", "purchase": "in", "waste": "out"}[kind]
        new = becomes if rnd.random() > 0.1 else rnd.choice([-1, becomes + 1])
        rows.append((k, item, kind, cat, Decimal(becomes - was), Decimal(was), Decimal(new), False, True,
                     DAY0 + timedelta(hours=7 * k)))
    stock = {i[0]: i[2] for i in items}
    active = {i[0]: i[7] for i in items}
    expected = {}
    for rid, item, kind, cat, q, was, new, *_ in rows:
        if not active[item]:
            why = texts.INACTIVE_ITEM
        elif was != stock[item]:
            why = texts.STALE_STOCK
        elif new < 0:
            why = texts.NEGATIVE_STOCK
        elif cat != "adjustment" and new != was + q:
            why = texts.WRONG_STOCK
        else:
            why, stock[item] = None, new
        flagged = why is None and kind in ("waste", "adjustment") and abs(q) > 100
        expected[rid] = (why, flagged, not flagged)
    df = spark.createDataFrame(rows, CLAIM).repartition(3)
    got = inventory.validate_movements(df, item_df, chunk_rows=chunk_rows).collect()
    assert {r.id: (r.message, r.approval_required, r.is_approved) for r in got} == expected
    assert any(w is None for w, *_ in expected.values())


def claims_between(seed, n, values, jump):
    """Claims that start where many chunks can end, so that chains of chunks branch and join."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        was = rnd.randrange(values)
        becomes = jump(rnd, was)
        cat = "in" if becomes > was else "out" if becomes < was else "adjustment"
        rows.append((k, 1, "purchase", cat, Decimal(becomes - was), Decimal(was), Decimal(becomes), False, True,
                     DAY0 + timedelta(minutes=k)))
    return rows


@pytest.mark.parametrize(
    ("values", "jump"),
    [
        (6, lambda rnd, was: rnd.randrange(6)),
        (60, lambda rnd, was: rnd.randrange(60)),
        (40, lambda rnd, was: (was + 1) % 40),
        (90, lambda rnd, was: was // 2),
    ],
)
def test_long_chains_are_followed_in_parts(spark, values, jump):
    rows, chunk_rows = claims_between(values, 200, values, jump), 5
    stock, taken = Decimal(rows[0][5]), set()
    for row in rows:
        if row[5] == stock:
            stock = row[6]
            taken.add(row[0])
    items = spark.createDataFrame([(1, "x", rows[0][5], D0, D0, D0, None, True)], ITEM)
    found = inventory.validate_movements(spark.createDataFrame(rows, CLAIM).repartition(3), items, chunk_rows=chunk_rows)
    assert {r.id for r in found.collect() if r.message is None} == taken


def test_tasks_of_a_chain_stay_small(spark, monkeypatch):
    # 1,000 falling rows: every chunk has a line for each of its starts, but one way out.
    rows = [
        (k, 1, "waste", "out", Decimal(-1), Decimal(1000 - k), Decimal(999 - k), False, True, DAY0 + timedelta(minutes=k))
        for k in range(1000)
    ]
    items = spark.createDataFrame([(1, "x", Decimal(1000), D0, D0, D0, None, True)], ITEM)
    followed, follow = [], folds._path

    def spied(links, keys, chunk_rows):
        followed.append(links.count())
        return follow(links, keys, chunk_rows)

    monkeypatch.setattr(folds, "_path", spied)
    found = inventory.validate_movements(spark.createDataFrame(rows, CLAIM), items, chunk_rows=50).collect()
    assert all(r.message is None for r in found) and len(found) == 1000
    assert followed == [20]


def test_links_skipped_on_the_way_come_back(spark):
    # A chain of 300 links, and 300 links that nobody reaches.
    links = [("a", c - 1, c, c, c + 1) for c in range(300)] + [("a", c, -7, c + 1, -8) for c in range(300)]
    frame = spark.createDataFrame(links, "k string, _chunk bigint, _value bigint, _at bigint, _to bigint")
    found = {(r["_chunk"], r["_value"]) for r in folds._path(frame, ["k"], 10).collect()}
    assert found == {(c, c + 1) for c in range(300)}


@pytest.mark.parametrize(("chunk_rows", "share"), [(1_000_000, 0.5), (60, 0.1), (60, 0.9)])
def test_invoice_admission_matches_a_plain_loop(spark, chunk_rows, share):
    rnd = random.Random(11)
    last, rows, expected = {"F001": 5, "B001": 0}, [], {}
    for k in range(300):
        series = rnd.choice(["F001", "F001", "B001"])
        given = None
        if rnd.random() < share:
            given = last[series] + rnd.choice([1, 1, 1, 0, 2])
        ok = given is None or given == last[series] + 1
        last[series] += ok
        rows.append((k, series, None if given is None else str(given)))
        expected[k] = (ok, f"{series}-{last[series]:08d}" if ok and given is None else f"{series}-{given}" if ok else None)
    new = spark.createDataFrame(rows, "id bigint, series string, correlative string").repartition(3)
    existing = spark.createDataFrame([("F001", "00000005"), ("F001", "3")], "series string, correlative string")
    got = billing.admit_invoices(new, existing, chunk_rows=chunk_rows).collect()
    assert {r.id: (r.is_accepted, r.invoice_number) for r in got} == expected


def test_the_jobs_of_a_hot_key_do_not_grow_with_its_chunks(spark):
    new = spark.range(600).selectExpr(
        "id", "'F001' as series", "if(id % 2 = 0, cast(id + 1 as string), null) as correlative"
    )
    existing = spark.createDataFrame([], "series string, correlative string")

    def jobs(chunk_rows):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        got = billing.admit_invoices(new, existing, chunk_rows=chunk_rows).collect()
        assert all(r.is_accepted for r in got) and len(got) == 600
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before

    assert jobs(30) <= jobs(200) + 2


def test_chunks_of_null_keys_and_unknown_stock(spark):
    rows = [(k, None if k % 2 else "F001", None) for k in range(80)]
    new = spark.createDataFrame(rows, "id bigint, series string, correlative string")
    existing = spark.createDataFrame([("F001", "7")], "series string, correlative string")
    got = {r.id: r.correlative for r in billing.admit_invoices(new, existing, chunk_rows=9).collect()}
    assert got == {k: f"{k // 2 + (1 if k % 2 else 8):08d}" for k in range(80)}
    items = spark.createDataFrame([(1, "x", None, D0, D0, D0, None, True)], ITEM)
    claims = [
        (k, 1, "purchase", "in", Decimal(1), Decimal(k), Decimal(k + 1), False, True, DAY0 + timedelta(hours=k))
        for k in range(60)
    ]
    claims[30] = (*claims[30][:5], Decimal(99), Decimal(100), *claims[30][7:])
    found = inventory.validate_movements(spark.createDataFrame(claims, CLAIM), items, chunk_rows=7).collect()
    assert {r.id for r in found if r.message is None} == set(range(30))


@pytest.mark.parametrize(("merged", "chunk_rows"), [("false", 0), ("true", 0), ("true", 100), ("true", 1_000_000)])
def test_running_stock_and_ledger_breaks(spark, merged, chunk_rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    items, item_df = make_items(spark)
    rnd = random.Random(4)
    stock, rows, sums = {}, [], {}
    running = {i[0]: i[2] for i in items}
    last, breaks = {}, {}
    for k in range(200):
        item = rnd.choice([1, 1, 1, 2])
        q = Decimal(rnd.randint(-5, 9))
        was = stock.get(item, Decimal(0)) + (1 if rnd.random() < 0.1 else 0)
        new = was + q + (1 if rnd.random() < 0.1 else 0)
        stock[item] = new
        cat = "in" if q > 0 else "out" if q < 0 else "adjustment"
        rows.append((k, item, "x", cat, q, was, new, False, True, DAY0 + timedelta(hours=9 * k)))
        running[item] += q
        sums[k] = running[item]
        gap = item in last and last[item] != was
        wrong = cat != "adjustment" and new != was + q
        if gap or wrong:
            breaks[k] = (gap, wrong)
        last[item] = new
    df = spark.createDataFrame(rows, CLAIM).repartition(3)
    got = inventory.running_stock(df, item_df, chunk_rows=chunk_rows).collect()
    assert {r.id: r.running_stock for r in got} == sums
    found = inventory.ledger_breaks(df, chunk_rows=chunk_rows).collect()
    assert {r.id: (r.breaks_chain, r.wrong_sum) for r in found} == breaks
