"""Slots, admission and changes on small hand-made days."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from clinicflow.functions import texts
from clinicflow.operators import scheduling

VISIT = (
    "id bigint, dentist_id bigint, appointment_date date, appointment_time int, "
    "duration_minutes int, appointment_code string, status_id bigint, version int"
)
HOURS = (
    "id bigint, dentist_id bigint, day_of_week int, start_time int, end_time int, "
    "is_active boolean, valid_from date, valid_until date"
)
MONDAY, TUESDAY = date(2024, 1, 8), date(2024, 1, 9)
NINE = 9 * 3600


def visit(id, minute, minutes, dentist=1, day=MONDAY, code=None, status=1, version=1):
    return (id, dentist, day, NINE + minute * 60, minutes, code, status, version)


def hours(spark, *rows):
    rows = rows or [(1, 1, 1, NINE, NINE + 8 * 3600, True, date(2024, 1, 1), None)]
    return spark.createDataFrame(list(rows), HOURS)


def no_holidays(spark):
    return spark.createDataFrame([], "date date, is_active boolean")


def admit(spark, requests, existing=(), working=None, holidays=None):
    requests = spark.createDataFrame(requests, VISIT)
    existing = spark.createDataFrame(list(existing), VISIT)
    return scheduling.admit_appointments(
        requests, existing, working or hours(spark), holidays or no_holidays(spark)
    )


def test_touching_visits_do_not_overlap(spark):
    df = spark.createDataFrame([visit(1, 0, 30), visit(2, 30, 30), visit(3, 59, 15), visit(4, 0, 15)], VISIT)
    counts = {r.id: r.overlaps for r in scheduling.overlaps_within(df).collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 1}
    flags = {r.id: r.overlaps_earlier for r in scheduling.overlap_flags(df).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_and_flags_match_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [visit(k, rnd.randint(0, 900), rnd.choice([15, 30, 45, 480]), rnd.choice([1, 1, 2])) for k in range(120)]
    df = spark.createDataFrame(rows, VISIT).repartition(4)

    def clash(a, b):
        return a[1] == b[1] and a[3] < b[3] + b[4] * 60 and b[3] < a[3] + a[4] * 60

    pairs = {a[0]: [b for b in rows if b[0] != a[0] and clash(a, b)] for a in rows}
    counts = {r.id: r.overlaps for r in scheduling.overlaps_within(df).collect()}
    assert counts == {k: len(v) for k, v in pairs.items()}
    flags = {r.id: r.overlaps_earlier for r in scheduling.overlap_flags(df).collect()}
    assert flags == {a[0]: any((b[3], b[0]) < (a[3], a[0]) for b in pairs[a[0]]) for a in rows}


def test_reasons_come_in_order(spark):
    closed = spark.createDataFrame([(MONDAY, True), (TUESDAY, False)], "date date, is_active boolean")
    working = hours(
        spark,
        (1, 1, 1, NINE, NINE + 3600, True, date(2024, 1, 1), None),
        (2, 1, 2, NINE, NINE + 3600, True, date(2024, 1, 1), None),
        (3, 2, 2, NINE, NINE + 3600, False, date(2024, 1, 1), None),
        (4, 3, 2, NINE, NINE + 3600, True, date(2024, 1, 1), date(2024, 1, 8)),
    )
    rows = admit(
        spark,
        [
            visit(1, 300, 30),  # holiday, although outside hours too
            visit(2, 300, 30, day=TUESDAY), visit(3, 45, 30, day=TUESDAY),
            visit(4, 0, 30, day=TUESDAY), visit(5, 15, 15, day=TUESDAY),
            visit(6, 0, 30, 2, TUESDAY), visit(7, 0, 30, 3, TUESDAY),
            visit(8, 30, 30, day=TUESDAY),
        ],
        working=working, holidays=closed,
    ).orderBy("id").collect()
    assert [r.message for r in rows] == [
        texts.HOLIDAY, texts.OUTSIDE_HOURS, texts.OUTSIDE_HOURS, None, texts.SLOT_TAKEN,
        texts.OUTSIDE_HOURS, texts.OUTSIDE_HOURS, None,
    ]
    assert [r.appointment_code for r in rows if r.is_accepted] == ["CITA-202401-0001", "CITA-202401-0002"]


def test_a_refused_request_blocks_nobody(spark):
    rows = admit(
        spark,
        [visit(2, 0, 60), visit(3, 30, 60), visit(4, 60, 60), visit(5, 0, 60)],
        existing=[visit(1, 480 - 15, 15)],
    ).orderBy("id").collect()
    assert [r.is_accepted for r in rows] == [True, False, True, False]


@pytest.mark.parametrize("seed", [3, 4])
def test_admission_matches_a_plain_loop(spark, seed):
    rnd = random.Random(seed)

    def some(first, n):
        return [
            visit(first + k, 15 * rnd.randint(-2, 36), rnd.choice([15, 30, 60]), rnd.choice([1, 1, 2]), rnd.choice([MONDAY, TUESDAY]))
            for k in range(n)
        ]

    existing, requests = some(0, 6), some(100, 120)
    working = hours(
        spark, *[
            (10 * d + w, d, w, NINE, NINE + 4 * 3600, True, date(2024, 1, 1), None) for d in (1, 2) for w in (1, 2)
        ],
        (99, 1, 1, NINE + 5 * 3600, NINE + 8 * 3600, True, date(2024, 1, 1), None),
    )
    windows = {1: [(0, 240), (300, 480)], 2: [(0, 240)]}
    taken, expected = list(existing), {}
    for r in requests:
        begin, end = (r[3] - NINE) // 60, (r[3] - NINE) // 60 + r[4]
        allowed = windows[r[1]] if r[2] == MONDAY else [(0, 240)]
        if not any(a <= begin and end <= b for a, b in allowed):
            expected[r[0]] = texts.OUTSIDE_HOURS
        elif any(t[1:3] == r[1:3] and t[3] < r[3] + r[4] * 60 and r[3] < t[3] + t[4] * 60 for t in taken):
            expected[r[0]] = texts.SLOT_TAKEN
        else:
            expected[r[0]] = None
            taken.append(r)
    got = {r.id: r.message for r in admit(spark, requests, existing, working).collect()}
    assert got == expected


def test_requests_without_a_dentist_are_kept_and_refused(spark):
    rows = admit(spark, [(1, None, MONDAY, NINE, 30, None, 1, 1), visit(2, 0, 30)]).orderBy("id").collect()
    assert [r.message for r in rows] == [texts.OUTSIDE_HOURS, None]


def test_late_visit_ends_after_midnight(spark):
    late = (1, 1, MONDAY, 23 * 3600 + 1800, 60, None, 1, 1)
    df = scheduling.with_end(spark.createDataFrame([late], VISIT))
    assert df.first().end_time == 24 * 3600 + 1800
    refused = admit(spark, [late], working=hours(spark, (1, 1, 1, NINE, 24 * 3600, True, MONDAY, None)))
    assert refused.first().message == texts.OUTSIDE_HOURS


def test_cancelled_visits_do_not_occupy(spark):
    statuses = spark.createDataFrame([(1, "scheduled"), (6, "Cancelled "), (7, "no_show")], "id bigint, name string")
    existing = spark.createDataFrame([visit(1, 0, 30, status=6), visit(2, 30, 30), visit(3, 60, 30, status=7)], VISIT)
    requests = spark.createDataFrame([visit(10, 0, 30), visit(11, 30, 30), visit(12, 60, 30)], VISIT)
    got = scheduling.overlap_check_active(requests, existing, statuses).orderBy("id").collect()
    assert [r.message for r in got] == [None, texts.ACTIVE_SLOT_TAKEN, None]


def test_changes(spark):
    old = [visit(1, 0, 30), visit(2, 30, 30), visit(3, 60, 30), visit(4, 90, 30), visit(5, 120, 30)]
    new = [
        visit(1, 15, 15),  # overlaps only itself
        visit(2, 60, 30),  # taken by 3, which moves away in the same batch
        visit(3, 180, 30),  # free
        visit(4, 195, 30),  # taken by the change of 3
        visit(5, 120, 30),  # nothing moves
    ]
    old_df, new_df = (spark.createDataFrame(rows, VISIT) for rows in (old, new))
    got = scheduling.change_appointments(
        old_df, new_df.withColumn("status_id", F.lit(2).cast("bigint")), hours(spark), no_holidays(spark)
    ).orderBy("id").collect()
    assert [r.is_accepted for r in got] == [True, False, True, False, True]
    assert [r.version for r in got] == [2, 1, 2, 1, 2]
    assert [(r.appointment_time - NINE) // 60 for r in got] == [15, 30, 180, 90, 120]
    assert [r.status_id for r in got] == [2, 1, 2, 1, 2]
    assert [r.moved for r in got] == [True, True, True, True, False]


def test_weekday_names_and_reminders(spark):
    names = spark.range(9).select(scheduling.day_name(F.col("id")).alias("n")).collect()
    assert [r.n for r in names] == [None, *texts.DAY_NAMES, None]
    df = spark.createDataFrame([visit(1, 0, 30), visit(2, 0, 30, day=TUESDAY)], VISIT)
    plan = scheduling.reminder_plan(df, MONDAY).orderBy("appointment_id", "hours_before").collect()
    assert [(r.appointment_id, r.reminder_type, r.send_at) for r in plan] == [
        (1, "email", datetime(2024, 1, 7, 9)), (2, "sms", datetime(2024, 1, 9, 7)),
        (2, "email", datetime(2024, 1, 8, 9)),
    ]


def overlapping(a, b):
    return a[1:3] == b[1:3] and None not in a[1:5] + b[1:5] and a[3] < b[3] + b[4] * 60 and b[3] < a[3] + a[4] * 60


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conflicts_match_all_pairs(spark, seed):
    rnd = random.Random(seed)
    lengths = [1, 15, 30, 45, 480, 0]
    # One dentist has most visits of one day; starts on and off the grid, repeated rows, a visit past midnight.
    booked = [visit(k, rnd.choice([0, 30, 7, rnd.randint(0, 900)]), rnd.choice(lengths), rnd.choice([1, 1, 1, 2]))
              for k in range(150)]
    asked = [visit(1000 + k, rnd.choice([0, 30, 44, rnd.randint(0, 900)]), rnd.choice(lengths), rnd.choice([1, 1, 2, 3]),
                   rnd.choice([MONDAY, MONDAY, TUESDAY])) for k in range(60)]
    booked += [(200, *booked[0][1:]), visit(201, 890, 480)]
    asked += [visit(2000, 0, 30, dentist=None), (2001, 1, MONDAY, None, 30, None, 1, 1), booked[5]]
    requests, existing = (spark.createDataFrame(rows, VISIT).repartition(3) for rows in (asked, booked))
    timed = [[v for v in rows if v[4]] for rows in (asked, booked)]
    expected = {
        (a[0], b[0], max(a[3], b[3]), min(a[3] + a[4] * 60, b[3] + b[4] * 60))
        for a in timed[0] for b in timed[1] if a[0] != b[0] and overlapping(a, b)
    }
    found = scheduling.conflicts(requests, existing).collect()
    assert len(found) == len(expected)
    assert {(r.request_id, r.visit_id, r.shared_from, r.shared_until) for r in found} == expected

    first = scheduling.first_conflicts(requests, existing).collect()
    assert len(first) == len(asked)
    for row in first:
        request = next(a for a in asked if a[0] == row.id)
        ways = [b for b in timed[1] if request[4] and overlapping(request, b)]
        best = min(ways, key=lambda b: (b[3], -b[4], b[0]), default=None)
        assert (row.blocked_by, row.blocked_from) == ((best[0], best[3]) if best else (None, None))
        assert row.blocked_until == (best[3] + best[4] * 60 if best else None)


def test_conflicts_with_nothing(spark):
    nothing = spark.createDataFrame([], VISIT)
    some = spark.createDataFrame([visit(1, 0, 30)], VISIT)
    assert scheduling.conflicts(nothing, some).count() == scheduling.conflicts(some, nothing).count() == 0
    assert [r.blocked_by for r in scheduling.first_conflicts(some, nothing).collect()] == [None]


def loop_with_codes(requests, existing, windows):
    """Requests one by one: what is in the way, and the code each gets."""
    taken, written = list(existing), [v[5] for v in existing if v[5]]
    found = {}
    for r in sorted(requests, key=lambda r: r[0]):
        month = r[2].strftime("CITA-%Y%m")
        own = r[5] if r[5] and r[5].strip() else None
        # The last four characters count, spaces among them.
        last = max([int(c[-4:]) for c in written if c.upper().startswith(month + "-")], default=0)
        code = own or f"{month}-{last + 1:04d}"
        begin, end = (r[3] - NINE) // 60, (r[3] - NINE) // 60 + r[4]
        if not any(a <= begin and end <= b for a, b in windows[r[1]]):
            found[r[0]] = (texts.OUTSIDE_HOURS, None)
        elif any(overlapping(r, v) for v in taken):
            found[r[0]] = (texts.SLOT_TAKEN, None)
        elif own and own.rstrip().lower() in {c.rstrip().lower() for c in written}:
            found[r[0]] = (texts.CODE_TAKEN, None)
        elif not own and last >= 9999:
            found[r[0]] = (texts.CODES_EXHAUSTED, None)
        else:
            found[r[0]] = (None, code)
            taken.append(r)
            written.append(code)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_slots_and_codes_match_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    february = date(2024, 2, 5)

    def code():
        month = rnd.choice(["202401", "202401", "202402"])
        return rnd.choice([None, None, "", f"CITA-{month}-99{rnd.randint(80, 99)}", f"cita-{month}-99{rnd.randint(75, 85)} "])

    existing = [visit(k, 60 * k, 15, code=f"CITA-202401-{9970 + k}") for k in range(3)]
    requests = [
        visit(100 + k, 15 * rnd.randint(0, 30), rnd.choice([15, 30, 60]), rnd.choice([1, 1, 2]), rnd.choice([MONDAY, february]), code())
        for k in range(150)
    ]
    working = hours(spark, *[(d, d, 1, NINE, NINE + 7 * 3600, True, date(2024, 1, 1), None) for d in (1, 2)])
    expected = loop_with_codes(requests, existing, {1: [(0, 420)], 2: [(0, 420)]})
    rows = admit(spark, requests, existing, working).collect()
    assert {r.id: (r.message, r.appointment_code) for r in rows} == expected
    assert {texts.CODE_TAKEN, None} <= {m for m, _ in expected.values()}


def test_the_slot_of_a_request_without_a_code_goes_to_the_next(spark):
    full = visit(1, 400, 15, code="CITA-202401-9999")
    rows = admit(
        spark,
        [
            visit(10, 0, 30),  # no code left in January
            visit(11, 15, 30, code="CITA-202401-0007"),  # the slot is still free
            visit(12, 0, 30),  # taken now, which is named before the code
            visit(13, 60, 30, code="cita-202401-0007 "),  # in use since 11
            visit(14, 60, 15, code="CITA-202401-9999"),  # stored
            visit(15, 75, 15, code="CITA-202401-0008"),
            visit(16, 60, 30, code="CITA-202401-0009"),  # taken by 15
        ],
        existing=[full],
    ).orderBy("id").collect()
    assert [r.message for r in rows] == [
        texts.CODES_EXHAUSTED, None, texts.SLOT_TAKEN, texts.CODE_TAKEN, texts.CODE_TAKEN, None, texts.SLOT_TAKEN,
    ]
    assert [r.appointment_code for r in rows if r.is_accepted] == ["CITA-202401-0007", "CITA-202401-0008"]


def test_codes_that_meet_along_a_chain(spark):
    # Each pair shares a slot; the first of a pair brings the code of the pair before, whose second
    # request therefore decides it.
    requests = []
    for k in range(5):
        requests += [visit(100 + 2 * k, 60 * k, 30, code=f"X-{k}"), visit(101 + 2 * k, 60 * k, 30, code=f"X-{k + 1}")]
    existing = [visit(1, 400, 15, code="x-0")]
    rows = admit(spark, requests, existing).orderBy("id").collect()
    expected = loop_with_codes(requests, existing, {1: [(0, 480)]})
    assert [(r.message, r.appointment_code) for r in rows] == [expected[r.id] for r in rows]
    assert [r.is_accepted for r in rows] == [False, True] * 5

    keyed = spark.createDataFrame(requests, VISIT).withColumns(
        {"_own": F.lit(True), "_key": F.concat(F.lit("code "), F.lower("appointment_code"))}
    )
    keyed = scheduling.with_end(keyed).select("id", *scheduling.SLOT, "appointment_code", "_own", "_key")
    able = keyed.select(*scheduling.SLOT).distinct()
    _, _, rounds = scheduling.settle_admission(keyed, able, spark.createDataFrame(existing, VISIT))
    assert rounds <= 7
    plain = spark.createDataFrame([visit(k, 60 * k, 30) for k in range(5)], VISIT)
    keyed = scheduling.with_end(plain).withColumns({"_own": F.lit(False), "_key": F.lit("month CITA-202401")})
    assert scheduling.settle_admission(keyed, able, spark.createDataFrame(existing, VISIT))[1:] == (None, 1)
