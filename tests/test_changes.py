"""Changes of appointments against a loop over the changes, one after the other."""

import random

import pytest
from pyspark.sql import functions as F
from test_scheduling import MONDAY, NINE, TUESDAY, VISIT, hours, no_holidays, visit

from clinicflow.functions import texts
from clinicflow.operators import scheduling

EVERY_DAY = [
    (10 * d + w, d, w, NINE, NINE + 8 * 3600, True, MONDAY.replace(month=1, day=1), None)
    for d in range(1, 5) for w in range(1, 8)
]


def by_hand(old, new):
    """{id: (message, slot it has in the end)}"""
    now = {v[0]: v for v in old}
    out = {}
    for v in sorted(new):
        was = now[v[0]]
        if v[1:5] == was[1:5]:
            out[v[0]] = None
            continue
        start, end = v[3], v[3] + v[4] * 60
        clash = any(
            o[0] != v[0] and o[1:3] == v[1:3] and o[3] < end and start < o[3] + o[4] * 60 for o in now.values()
        )
        if start < NINE or end > NINE + 8 * 3600:
            out[v[0]] = texts.OUTSIDE_HOURS
        elif clash:
            out[v[0]] = texts.SLOT_TAKEN
        else:
            out[v[0]], now[v[0]] = None, v
    return {i: (message, now[i][1:5]) for i, message in out.items()}


def changed(spark, old, new):
    old_df, new_df = (spark.createDataFrame(rows, VISIT).repartition(3) for rows in (old, new))
    got = scheduling.change_appointments(old_df, new_df, hours(spark, *EVERY_DAY), no_holidays(spark)).collect()
    return {
        r.id: (r.message, (r.dentist_id, r.appointment_date, r.appointment_time, r.duration_minutes)) for r in got
    }


@pytest.mark.parametrize("seed", range(4))
def test_changes_match_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    old = [
        visit(k, 15 * rnd.randrange(34), 15 * rnd.randrange(1, 4), rnd.randrange(1, 4), rnd.choice([MONDAY, TUESDAY]))
        for k in range(1, 70)
    ]
    new = [
        visit(v[0], 15 * rnd.randrange(34), v[4], rnd.randrange(1, 4), rnd.choice([MONDAY, TUESDAY]))
        if rnd.random() < 0.8 else v
        for v in old
    ]
    expected = by_hand(old, new)
    assert changed(spark, old, new) == expected
    assert {texts.SLOT_TAKEN, None} <= {m for m, _ in expected.values()}


def test_swaps_and_chains(spark):
    # 1 goes away and 2, 3 ... each take the slot of the one before; 20 and 21 want each other's.
    old = [visit(k, 30 * k, 30) for k in range(1, 11)] + [visit(20, 0, 30, 2), visit(21, 60, 30, 2)]
    new = [visit(1, 0, 30)] + [visit(k, 30 * (k - 1), 30) for k in range(2, 11)] + [visit(20, 60, 30, 2), visit(21, 0, 30, 2)]
    got = changed(spark, old, new)
    assert got == by_hand(old, new)
    assert [got[k][0] for k in (1, 5, 10, 20, 21)] == [None, None, None, texts.SLOT_TAKEN, texts.SLOT_TAKEN]
    backwards = [visit(k, 30 * (k + 1), 30) for k in range(1, 11)]
    assert [m for m, _ in changed(spark, old[:10], backwards).values()].count(None) == 1


def movers(spark, old, new, blocked=()):
    def slot(v):
        return (*v[1:4], v[3] + v[4] * 60)

    rows = [(n[0], *slot(n), slot(o), n[0] in blocked) for o, n in zip(old, new)]
    kind = "dentist_id bigint, appointment_date date, appointment_time int, end_time int"
    return spark.createDataFrame(rows, f"id bigint, {kind}, _old struct<{kind}>, blocked boolean")


def test_rounds(spark):
    # A chain inside one day is one round; one that changes the dentist at each link is one a link.
    old = [visit(k, 15 * k, 15) for k in range(1, 30)]
    new = [visit(k, 15 * (k - 1), 15) for k in range(1, 30)]
    verdicts, rounds = scheduling.settle_changes(movers(spark, old, new))
    assert rounds == 1 and verdicts.filter("verdict").count() == 29
    old = [visit(k, 0, 30, k) for k in range(1, 9)]
    new = [visit(k, 0, 30, k - 1) for k in range(1, 9)]
    verdicts, rounds = scheduling.settle_changes(movers(spark, old, new))
    assert rounds == 8 and verdicts.filter("verdict").count() == 8
    verdicts, rounds = scheduling.settle_changes(movers(spark, old, new, blocked={1}))
    assert rounds <= 8 and verdicts.filter("not verdict").count() == 8


def test_odd_changes(spark):
    old = [visit(1, 0, 30), visit(2, 60, 30), (3, 1, MONDAY, None, 30, None, 1, 1)]
    new = [(1, 1, MONDAY, None, 30, None, 1, 1), visit(2, 0, 30), visit(3, 120, 30)]
    got = changed(spark, old, new)
    assert got[1][0] is None and got[2][0] == texts.SLOT_TAKEN
    # A change from or to an unknown time cannot be seen, as in a comparison with NULL.
    assert got[3][0] is None
    nothing = spark.createDataFrame([], VISIT)
    assert scheduling.change_appointments(nothing, nothing, hours(spark), no_holidays(spark)).count() == 0
    assert scheduling.change_appointments(
        spark.createDataFrame(old, VISIT), nothing, hours(spark), no_holidays(spark)
    ).filter(F.lit(True)).count() == 0
