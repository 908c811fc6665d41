"""Appointments: lookups, slot checks, admission, changes and reminders.

Whether a slot is free, open or a holiday depends only on (dentist, date, start, end).
Tables are therefore first reduced to their distinct slots, or to one row per dentist, date
and second of the day, before anything is shuffled or ordered. The work per dentist and date
is then bounded by the seconds of a day however many appointments share it. Overlaps are
counted from those per-time totals; pairs of appointments are never produced.

Durations must be positive, which the declared checks demand.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.functions import texts
from clinicflow.functions.scalars import (
    LAST_CODE, blank, changed, code_number, collated, end_seconds, folded, iso_weekday, moment, month_key,
)
from clinicflow.operators.folds import Fold, run_fold
from clinicflow.operators.sequences import assign_codes, code_prefix, last_codes
from clinicflow.operators.skew import written

SLOT = ["dentist_id", "appointment_date", "appointment_time", "end_time"]
DAY = ["dentist_id", "appointment_date"]

# Codes of visits, and what a month's key begins with where codes and months are keys together.
CODE, CODE_KIND = "appointment_code", "CITA"
MONTH_KEY = "month "

# Statuses whose appointments do not occupy their slot; reminder lead times in hours.
FREE_STATUSES = ("cancelled", "no_show")
EMAIL_HOURS, SMS_HOURS = 24, 2

# Seconds of the pieces of a day in which visits meet.
PIECE = 900


def with_end(appointments: DataFrame) -> DataFrame:
    if "end_time" in appointments.columns:
        return appointments
    return appointments.withColumn(
        "end_time", end_seconds(F.col("appointment_time"), F.col("duration_minutes"))
    )


def full_name(alias: str) -> Column:
    return F.concat(F.col(f"{alias}.first_name"), F.lit(" "), F.col(f"{alias}.last_name"))


def appointments_complete(
    appointments: DataFrame, users: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Appointments with patient, dentist and status texts.

    Few users are dentists, so only those named by an appointment go into that join; the
    statuses are a handful of seed rows.
    """
    appointments = with_end(appointments)
    people = users.select("id", "first_name", "last_name", "document_number", "phone")
    dentists = people.join(
        appointments.select(F.col("dentist_id").alias("id")).distinct(), "id", "left_semi"
    )
    a, p, d, s = (
        appointments.alias("a"), people.alias("p"), dentists.alias("d"), statuses.alias("s"),
    )
    return (
        a.join(s, F.col("a.status_id") == F.col("s.id"))
        .join(d, F.col("a.dentist_id") == F.col("d.id"))
        .join(p, F.col("a.patient_id") == F.col("p.id"))
        .select(
            "a.id", "a.appointment_code", "a.appointment_date", "a.appointment_time",
            "a.end_time", "a.duration_minutes", "a.reason", "a.priority",
            full_name("p").alias("patient_name"),
            F.col("p.document_number").alias("patient_dni"),
            F.col("p.phone").alias("patient_phone"),
            full_name("d").alias("dentist_name"),
            F.col("s.display_name").alias("status_name"),
            F.col("s.color").alias("status_color"),
            "a.arrived_at", "a.started_at", "a.finished_at", "a.created_at", "a.updated_at",
        )
    )


def day_name(day_of_week: Column) -> Column:
    names = F.array(*[F.lit(name) for name in texts.DAY_NAMES])
    return F.when(day_of_week.between(1, 7), F.element_at(names, day_of_week.cast("int")))


def dentist_availability(users: DataFrame, working_hours: DataFrame) -> DataFrame:
    """Active working hours with weekday names, sorted by dentist and weekday."""
    u, w = users.alias("u"), working_hours.filter("is_active").alias("w")
    return (
        u.join(w, F.col("u.id") == F.col("w.dentist_id"))
        .orderBy(collated(F.col("u.first_name")), collated(F.col("u.last_name")), "w.day_of_week")
        .select(
            "w.dentist_id", full_name("u").alias("dentist_name"), "w.day_of_week",
            day_name(F.col("w.day_of_week")).alias("day_name"), "w.start_time", "w.end_time",
            "w.break_start_time", "w.break_end_time", "w.valid_from", "w.valid_until",
        )
    )


def in_force(day: Column, valid_from: Column, valid_until: Column) -> Column:
    return (day >= valid_from) & (valid_until.isNull() | (day <= valid_until))


def _bookings(existing: DataFrame) -> DataFrame:
    """Starts and ends of booked visits, counted per dentist, date and time."""
    marks = F.explode(
        F.array(
            F.struct(F.col("appointment_time").alias("t"), F.lit(1).alias("o"), F.lit(0).alias("c")),
            F.struct(F.col("end_time").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("c")),
        )
    )
    return (
        with_end(existing)
        .select(*DAY, marks.alias("m"))
        .groupBy(*DAY, F.col("m.t").alias("t"))
        .agg(F.sum("m.o").alias("opened"), F.sum("m.c").alias("closed"))
    )


def _windows(appointments: DataFrame, working_hours: DataFrame) -> DataFrame:
    """Latest end of the working windows that open at each time of a dentist's day."""
    days = appointments.select(*DAY).distinct()
    w = working_hours.filter("is_active").alias("w")
    on = (
        (F.col("d.dentist_id") == F.col("w.dentist_id"))
        & (iso_weekday(F.col("d.appointment_date")) == F.col("w.day_of_week"))
        & in_force(F.col("d.appointment_date"), F.col("w.valid_from"), F.col("w.valid_until"))
    )
    return (
        days.alias("d")
        .join(w, on)
        .groupBy("d.dentist_id", "d.appointment_date", F.col("w.start_time").alias("t"))
        .agg(F.max("w.end_time").alias("reach"))
    )


def _look_up(
    slots: DataFrame, existing: DataFrame | None = None, windows: DataFrame | None = None
) -> DataFrame:
    """Slots with `booked` (existing visits they overlap) and `in_hours`.

    Each slot asks at its start and at its end, in one ordered pass over its dentist's day.
    Visits begun before a slot's end, less those over by its start, are those it overlaps.
    A window that opened by its start must reach its end. The pass and the regrouping by
    slot share one shuffle, by dentist and date, of rows that are already aggregated.
    """
    kept = [c for c in slots.columns if c not in DAY]
    asks = F.explode(F.array(F.lit(True), F.lit(False)))
    points = slots.select(*DAY, F.struct(*kept).alias("slot"), asks.alias("at_start")).withColumn(
        "t", F.when(F.col("at_start"), F.col("slot.appointment_time")).otherwise(F.col("slot.end_time"))
    )
    if existing is not None:
        points = points.unionByName(_bookings(existing), allowMissingColumns=True)
    else:
        points = points.withColumns({"opened": F.lit(0), "closed": F.lit(0)})
    if windows is not None:
        points = points.unionByName(windows, allowMissingColumns=True)
    else:
        points = points.withColumn("reach", F.lit(None).cast("int"))
    by_time = Window.partitionBy(*DAY).orderBy("t")
    upto = by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_time.rangeBetween(Window.unboundedPreceding, -1)
    passed = points.withColumns(
        {
            "begun": F.coalesce(F.sum("opened").over(earlier), F.lit(0)),
            "over": F.coalesce(F.sum("closed").over(upto), F.lit(0)),
            "reach": F.max("reach").over(upto),
        }
    ).filter(F.col("slot").isNotNull())
    start, end = F.col("at_start"), ~F.col("at_start")
    return (
        passed.groupBy(*DAY, "slot")
        .agg(
            F.max(F.when(end, F.col("begun"))).alias("begun"),
            F.max(F.when(start, F.col("over"))).alias("over"),
            F.max(F.when(start, F.col("reach"))).alias("reach"),
        )
        .select(
            *DAY, "slot.*", (F.col("begun") - F.col("over")).alias("booked"),
            F.coalesce(F.col("reach") >= F.col("slot.end_time"), F.lit(False)).alias("in_hours"),
        )
    )


def check_slots(
    slots: DataFrame, existing: DataFrame | None, working_hours: DataFrame, holidays: DataFrame
) -> DataFrame:
    """Distinct slots with `on_holiday`, `in_hours` and `booked`, the count of overlaps."""
    closed = holidays.filter("is_active").select(F.col("date").alias("appointment_date")).distinct()
    return (
        _look_up(slots, existing, _windows(slots, working_hours))
        .join(closed.withColumn("on_holiday", F.lit(True)), "appointment_date", "left")
        .withColumn("on_holiday", F.coalesce("on_holiday", F.lit(False)))
    )


def distinct_slots(appointments: DataFrame) -> DataFrame:
    return with_end(appointments).select(*SLOT).distinct()


def overlap_counts(appointments: DataFrame, existing: DataFrame) -> DataFrame:
    """Appointments with `overlaps`: how many existing visits share their dentist's time.

    An appointment that is itself in `existing` is counted; subtract it where needed.
    """
    slots = distinct_slots(appointments)
    booked = _look_up(slots, existing).select(*SLOT, F.col("booked").alias("overlaps"))
    counted = with_end(appointments).join(booked, SLOT, "left")
    return counted.withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def overlaps_within(appointments: DataFrame) -> DataFrame:
    """Each appointment with the number of other appointments it overlaps."""
    counted = overlap_counts(appointments, appointments)
    return counted.withColumn("overlaps", F.col("overlaps") - 1)


def overlap_flags(appointments: DataFrame) -> DataFrame:
    """Flag every appointment that overlaps one before it in (start, id) order.

    Reduced to one row per start time: an appointment clashes with an earlier start if that
    lasts beyond it, and with any lower id at the same start.
    """
    starts = [*DAY, "appointment_time"]
    rows = with_end(appointments)
    before = Window.partitionBy(*DAY).orderBy("appointment_time").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_start = (
        rows.groupBy(*starts)
        .agg(F.max("end_time").alias("latest"), F.min("id").alias("first_id"))
        .select(*starts, F.max("latest").over(before).alias("busy_until"), "first_id")
    )
    flagged = F.coalesce(F.col("busy_until") > F.col("appointment_time"), F.lit(False)) | (
        F.col("id") > F.col("first_id")
    )
    return (
        rows.join(per_start, starts, "left")
        .withColumn("overlaps_earlier", flagged)
        .drop("busy_until", "first_id")
    )


def _pieces(visits: DataFrame, name: str) -> DataFrame:
    """Visits once for every piece of the day they touch; those without a length touch none."""
    start, end = F.col("appointment_time"), F.col("end_time")
    touched = F.sequence(F.floor(start / PIECE), F.floor((end - 1) / PIECE))
    return with_end(visits).filter(start < end).select(
        *DAY, F.col("id").alias(f"{name}_id"), start.alias(f"{name}_start"), end.alias(f"{name}_end"),
        F.explode(touched).alias("piece"),
    )


def conflicts(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Every request with every existing visit of another id that shares its dentist's time, and since when.

    Visits meet in the pieces of the day that both touch, and a pair counts in the piece in which the
    later of the two begins. So only pairs of which one ends and the other then begins in the
    same piece are looked at in vain, and a busy dentist's day is spread over its pieces.
    """
    begins = F.greatest("request_start", "visit_start")
    ends = F.least("request_end", "visit_end")
    return (
        _pieces(requests, "request")
        .join(_pieces(existing, "visit"), [*DAY, "piece"])
        .filter((begins < ends) & (F.floor(begins / PIECE) == F.col("piece")))
        .filter("request_id <> visit_id")
        .select("request_id", "visit_id", *DAY, begins.alias("shared_from"), ends.alias("shared_until"))
    )


def first_conflicts(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests with the earliest existing visit in their way: `blocked_by`, `blocked_from`, `blocked_until`.

    Of visits that begin together the longest is named, and of those the one with the lowest id;
    all three are NULL where nothing is in the way. Requests are new, so their ids are not looked at. No
    pairs are produced: only visits that last longer than all before them can be the first
    in anybody's way, and of those it is the one that ends next after the request begins.
    """
    visits = with_end(existing).filter(F.col("appointment_time") < F.col("end_time"))
    longest = F.max(F.struct("end_time", (-F.col("id")).alias("id")))
    before = Window.partitionBy(*DAY).orderBy("appointment_time").rowsBetween(Window.unboundedPreceding, -1)
    lasting = (
        visits.groupBy(*DAY, "appointment_time")
        .agg(longest.alias("last"))
        .withColumn("reached", F.max("last.end_time").over(before))
        .filter("reached is null or last.end_time > reached")
    )
    ends = lasting.select(
        *DAY, F.col("last.end_time").alias("at"),
        F.struct((-F.col("last.id")).alias("id"), "appointment_time", F.col("last.end_time").alias("end_time")).alias("visit"),
    )
    slots = distinct_slots(requests).filter(F.col("appointment_time") < F.col("end_time"))
    later = Window.partitionBy(*DAY).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    met = (
        slots.withColumn("at", F.col("appointment_time"))
        .unionByName(ends, allowMissingColumns=True)
        .withColumn("next", F.last("visit", ignorenulls=True).over(later))
        .filter((F.col("next.appointment_time") < F.col("end_time")) & F.col("visit").isNull())
        .select(*SLOT, F.col("next.id").alias("blocked_by"), F.col("next.appointment_time").alias("blocked_from"),
                F.col("next.end_time").alias("blocked_until"))
    )
    return with_end(requests).join(met, SLOT, "left")


def within_hours(appointments: DataFrame, working_hours: DataFrame) -> DataFrame:
    """Appointments that lie inside one active working window of their dentist."""
    slots = distinct_slots(appointments)
    open_slots = _look_up(slots, windows=_windows(appointments, working_hours))
    return with_end(appointments).join(
        open_slots.filter("in_hours").select(*SLOT), SLOT, "left_semi"
    )


def on_holidays(appointments: DataFrame, holidays: DataFrame) -> DataFrame:
    """Appointments on an active holiday."""
    closed = holidays.filter("is_active").select(F.col("date").alias("appointment_date"))
    return appointments.join(closed, "appointment_date", "left_semi")


def occupying(existing: DataFrame, statuses: DataFrame) -> DataFrame:
    """Existing appointments whose status still occupies the slot."""
    busy = statuses.filter(~folded(F.col("name")).isin(*FREE_STATUSES)).select(
        F.col("id").alias("status_id")
    )
    return existing.join(busy, "status_id", "left_semi")


def overlap_check_active(
    requests: DataFrame, existing: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Requests checked against existing visits, cancelled and missed ones left aside."""
    counted = overlap_counts(requests, occupying(existing, statuses))
    taken = F.col("overlaps") > 0
    return counted.withColumn("is_accepted", ~taken).withColumn(
        "message", F.when(taken, F.lit(texts.ACTIVE_SLOT_TAKEN))
    )


def _first_come(slots: DataFrame) -> DataFrame:
    """Grant slots in order of `first_id`, unless one granted before overlaps.

    There is one row per distinct slot, so a dentist's day stays small. The state is the
    sorted list of granted visits, which cannot overlap each other.
    """
    fold = Fold(
        keys=DAY,
        order=["first_id"],
        inputs=["appointment_time", "end_time"],
        state=[],
        outputs=T.StructType([T.StructField("granted", T.BooleanType())]),
        step=_grant,
    )
    return run_fold(slots, None, fold, chunk_rows=None)


def _grant(granted: list | None, row: tuple) -> tuple[list, tuple]:
    granted = granted or []
    start, end = row
    at = bisect_left(granted, (start,))
    free_before = at == 0 or granted[at - 1][1] <= start
    free_after = at == len(granted) or granted[at][0] >= end
    if free_before and free_after:
        granted.insert(at, (start, end))
        return granted, (True,)
    return granted, (False,)


def _taken_from(slots: DataFrame, granted: DataFrame) -> DataFrame:
    """Slots with `taken_from`, the lowest id of a granted visit that overlaps; NULL if none does.

    `granted` has `first_id` and slots that do not overlap each other.
    """
    asked = slots.select(*SLOT, F.lit(None).cast("bigint").alias("first_id"), F.lit(True).alias("asks"))
    rows = granted.select(*SLOT, "first_id", F.lit(False).alias("asks")).unionByName(asked)
    fold = Fold(
        keys=DAY,
        order=["asks", "appointment_time"],
        inputs=["asks", "appointment_time", "end_time", "first_id"],
        state=[],
        outputs=T.StructType([T.StructField("taken_from", T.LongType())]),
        step=_lowest_met,
    )
    return run_fold(rows, None, fold, chunk_rows=None).filter("asks").select(*SLOT, "taken_from")


def _lowest_met(day: tuple[list, list, list] | None, row: tuple) -> tuple[tuple, tuple]:
    starts, ends, ids = day = day or ([], [], [])
    asks, start, end, first_id = row
    if asks:
        return day, (min(ids[bisect_right(ends, start) : bisect_left(starts, end)], default=None),)
    starts.append(start)
    ends.append(end)
    ids.append(first_id)
    return day, (None,)


def _verdict(on_holiday: Column, in_hours: Column, free: Column) -> Column:
    """First reason to refuse, in the order the checks are made; NULL if there is none.

    A request without dentist, date or time has no verdict and counts as outside hours.
    """
    no = F.lit(False)
    return (
        F.when(F.coalesce(on_holiday, no), F.lit(texts.HOLIDAY))
        .when(~F.coalesce(in_hours, no), F.lit(texts.OUTSIDE_HOURS))
        .when(~F.coalesce(free, no), F.lit(texts.SLOT_TAKEN))
    )


def admit_appointments(
    requests: DataFrame, existing: DataFrame, working_hours: DataFrame, holidays: DataFrame
) -> DataFrame:
    """Accept or refuse booking requests in order of their id; accepted ones have codes.

    A request needs a free slot and a code: the one it brings, if nobody has it yet, or the next of
    its month. One that is refused for either leaves both to those after it. The message names the
    slot first. Codes are settled with the slots in rounds, see `settle_admission`.
    """
    requests = with_end(requests)
    if CODE not in requests.columns:
        requests = requests.withColumn(CODE, F.lit(None).cast("string"))
    own = ~blank(F.col(CODE))
    month = F.concat(F.lit(f"{CODE_KIND}-"), month_key(F.col("appointment_date")))
    keyed = requests.withColumns(
        {
            "_own": own,
            "_key": F.when(own, _code_key(F.col(CODE))).otherwise(F.concat(F.lit(MONTH_KEY), month)),
        }
    )
    checked = written(check_slots(distinct_slots(requests), existing, working_hours, holidays))
    able = checked.filter(~F.col("on_holiday") & F.col("in_hours") & (F.col("booked") == 0)).select(*SLOT)
    won, limits, _ = settle_admission(keyed.select("id", *SLOT, CODE, "_own", "_key"), able, existing)
    slots = checked.join(won.select(*SLOT, "first_id", F.col(CODE).alias("_code")), SLOT, "left")
    free, late = F.col("id") == F.col("first_id"), F.lit(False)
    if limits is not None:
        keyed = keyed.join(limits, "_key", "left")
        late = F.coalesce(F.col("id") > F.col("_limit"), F.lit(False))
        asked = able.join(keyed.filter(late), SLOT, "left_semi")
        slots = slots.join(_taken_from(asked, won), SLOT, "left")
        untaken = F.col("taken_from").isNull() | (F.col("taken_from") > F.col("id"))
        free = F.when(late, (F.col("booked") == 0) & untaken).otherwise(free)
    no_code = F.when(late, F.when(F.col("_own"), F.lit(texts.CODE_TAKEN)).otherwise(F.lit(texts.CODES_EXHAUSTED)))
    message = F.coalesce(_verdict(F.col("on_holiday"), F.col("in_hours"), free), no_code)
    return (
        keyed.join(slots, SLOT, "left")
        .withColumn("message", message)
        .withColumn("is_accepted", F.col("message").isNull())
        .withColumn(CODE, F.when(F.col("is_accepted"), F.col("_code")))
        .select(*requests.columns, "message", "is_accepted")
    )


def settle_admission(
    requests: DataFrame, able: DataFrame, existing: DataFrame
) -> tuple[DataFrame, DataFrame | None, int]:
    """The requests that get their slot and a code, what limits codes, and the rounds it took.

    `requests` has id, slot, code, `_own` (it brings a code) and `_key` (that code, or its month);
    `able` the slots that nothing stored stops. Limits are (`_key`, `_limit`): requests of that
    key with a larger id are refused, because the code is in use or the month's last number is.
    A round grants slots and codes under the limits of the round before and finds the limits
    that those leave; it is over when they stay. Whether a request is refused depends on those
    before it only, so each round is right for longer than the one before and the rounds end in
    what a loop over the requests finds. Without codes that run out or meet there is one round;
    otherwise the rounds follow the longest chain of requests that free a slot for the next.

    Of all unlimited requests for one slot only the first can succeed, because what stops it, or
    its own visit, stops the others too. So one candidate per slot is decided.
    """
    supplied = requests.filter("_own").select("_key").distinct()
    if supplied.isEmpty():
        supplied = None
    stored = last_codes(existing, CODE).filter(F.col("last_number") >= LAST_CODE)
    stored = stored.select(F.concat(F.lit(MONTH_KEY), "code_prefix").alias("_key"))
    if supplied is not None:
        used = existing.select(_code_key(F.col(CODE)).alias("_key"))
        stored = stored.unionByName(supplied.join(used, "_key", "left_semi"))
    # Lower than any id: none of these requests has a code.
    stored = stored.withColumn("_limit", F.lit(-(1 << 63)).cast("bigint"))
    limits, rounds = None, 0
    while True:
        rounds += 1
        unlimited = requests
        if limits is not None:
            unlimited = requests.join(limits, "_key", "left").filter("_limit is null or id <= _limit")
        firsts = unlimited.groupBy(*SLOT).agg(F.min_by(F.struct("id", CODE, "_key"), "id").alias("first"))
        candidates = able.join(firsts, SLOT).select(*SLOT, F.col("first.id").alias("first_id"), f"first.{CODE}", "first._key")
        granted = _first_come(candidates).filter("granted").drop("granted")
        won = written(
            assign_codes(granted, existing, CODE_KIND, CODE, F.col("appointment_date"), "first_id", keep_supplied=True)
        )
        found = _limits_left(won, supplied).unionByName(stored).groupBy("_key").agg(F.min("_limit").alias("_limit"))
        if limits is None and found.isEmpty():
            return won, None, rounds
        found = written(found)
        if limits is not None and found.exceptAll(limits).isEmpty() and limits.exceptAll(found).isEmpty():
            return won, limits, rounds
        limits = found


def _code_key(code: Column) -> Column:
    return F.concat(F.lit("code "), folded(code))


def _limits_left(won: DataFrame, supplied: DataFrame | None) -> DataFrame:
    """Months whose last number is given out and supplied codes that somebody has, each since which id."""
    last = F.coalesce(code_number(F.col(CODE)) >= LAST_CODE, F.lit(False))
    key = F.when(F.col("code_overflow"), F.col("_key")).otherwise(F.concat(F.lit(MONTH_KEY), code_prefix(F.col(CODE))))
    limits = won.filter(F.col("code_overflow") | last).select(key.alias("_key"), F.col("first_id").alias("_limit"))
    if supplied is not None:
        owned = won.filter(~F.col("code_overflow")).select(_code_key(F.col(CODE)).alias("_key"), F.col("first_id").alias("_limit"))
        limits = limits.unionByName(owned.join(supplied, "_key", "left_semi"))
    return limits


class Occupied:
    """Visits of a dentist's day, as sorted starts and ends; they may overlap each other."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        insort(self.starts, start)
        insort(self.ends, end)

    def remove(self, start: int, end: int) -> None:
        del self.starts[bisect_left(self.starts, start)]
        del self.ends[bisect_left(self.ends, end)]

    def meets(self, start: int, end: int) -> bool:
        return bisect_left(self.starts, end) > bisect_right(self.ends, start)


# Events of a dentist's day: a visit that is there, one that wants to come, one that wants to go.
STANDS, COMES, GOES = range(3)


def _move(day: tuple[Occupied, Occupied] | None, row: tuple) -> tuple[tuple, tuple]:
    """Decide a visit that wants to come, as far as the visits before it are decided.

    `sure` are the visits that are there, `open_` those that may be, because a change before is
    not decided yet. A verdict is NULL as long as it depends on those.
    """
    sure, open_ = day = day or (Occupied(), Occupied())
    kind, start, end, old_start, old_end, verdict = row
    if kind == STANDS:
        sure.add(start, end)
        return day, (None,)
    here = old_start is not None
    if here:
        sure.remove(old_start, old_end)
    if kind == COMES and verdict is None:
        if sure.meets(start, end):
            verdict = False
        elif not open_.meets(start, end):
            verdict = True
    if here and verdict is not True:
        (open_ if verdict is None else sure).add(old_start, old_end)
    if kind == COMES and verdict is not False:
        (open_ if verdict is None else sure).add(start, end)
    return day, (verdict,)


def _event(kind: int, day: str, order: Column, now: str | None = None, old: Column | None = None) -> Column:
    """A row for `_move`: in the day of `day`, for the slot of `now`, giving up the old slot if `old`."""
    none, verdict = F.lit(None).cast("int"), F.col("verdict")
    times = [none, none] if now is None else [F.col(f"{now}appointment_time"), F.col(f"{now}end_time")]
    given = [none, none] if old is None else [F.when(old, F.col(f"_old.{c}")) for c in ("appointment_time", "end_time")]
    return F.struct(
        *[F.col(f"{day}{c}").alias(c) for c in DAY], order.alias("id"), F.lit(kind).alias("kind"),
        times[0].alias("appointment_time"), times[1].alias("end_time"),
        given[0].alias("old_start"), given[1].alias("old_end"),
        (F.when(F.lit(False), verdict) if kind == STANDS else verdict).alias("verdict"),
    )


def settle_changes(movers: DataFrame) -> tuple[DataFrame, int]:
    """(id, verdict) of visits that want to move, decided one by one in order of their id, and the rounds.

    `movers` has id, the wanted slot, `_old` with the slot given up, and `blocked`, true where a
    visit that never moves is in the way. A change meets the visits as changes before it left
    them: a slot given up is free for those after it. In each round every dentist's day is
    walked in order of id; what depends on another day's open change waits for the next round.
    The first open change depends on nothing open, so each round decides some; a chain of
    changes inside one day takes one round.
    """
    movers = written(movers)
    same_day = reduce(Column.__and__, [F.col(c) == F.col(f"_old.{c}") for c in DAY])
    # A visit without a time stands in nobody's way.
    timed = F.col("_old.appointment_time").isNotNull() & F.col("_old.end_time").isNotNull()
    fold = Fold(
        keys=DAY,
        order=["id", "kind"],
        inputs=["kind", "appointment_time", "end_time", "old_start", "old_end", "verdict"],
        state=[],
        outputs=T.StructType([T.StructField("now", T.BooleanType())]),
        step=_move,
    )
    verdicts = movers.select("id", F.when(F.col("blocked"), False).alias("verdict"))
    rounds = 0
    while True:
        known = movers.join(verdicts, "id")
        stands = _event(STANDS, "_old.", F.lit(None).cast("bigint"), now="_old.")
        comes = _event(COMES, "", F.col("id"), now="", old=same_day & timed)
        goes = _event(GOES, "_old.", F.col("id"), old=timed)
        each = F.array(F.when(timed, stands), comes, F.when(timed & ~same_day, goes))
        events = known.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("e.*")
        if rounds:
            waiting = events.filter((F.col("kind") == COMES) & F.col("verdict").isNull()).select(*DAY).distinct()
            events = events.join(waiting, DAY, "left_semi")
        walked = run_fold(events, None, fold, chunk_rows=None)
        fresh = walked.filter((F.col("kind") == COMES) & F.col("verdict").isNull()).select("id", F.col("now").alias("verdict"))
        verdicts = written(verdicts.filter("verdict is not null").unionByName(fresh))
        rounds += 1
        if verdicts.filter("verdict is null").isEmpty():
            return verdicts, rounds


def change_appointments(
    old: DataFrame, new: DataFrame, working_hours: DataFrame, holidays: DataFrame
) -> DataFrame:
    """Apply proposed new versions of appointments, matched by id, in order of id.

    If date, time, duration or dentist changes, the new slot is checked as for a request,
    against every other appointment as the changes before it left them: slots they gave up are
    free, slots they were granted are taken. An accepted row has its version raised by one; a
    refused one keeps its old values. Changes are settled in rounds, see `settle_changes`.
    """
    old, new = with_end(old), with_end(new)
    moves = F.lit(False)
    for name in ("appointment_date", "appointment_time", "duration_minutes", "dentist_id"):
        moves = moves | changed(F.col(f"n.{name}"), F.col(f"o.{name}"))
    both = new.alias("n").join(old.alias("o"), F.col("n.id") == F.col("o.id"))
    proposals = both.select("n.*", F.struct("o.*").alias("_old"), moves.alias("moved"))
    moved = proposals.filter("moved").select("id", *SLOT, F.struct(*[F.col(f"_old.{c}") for c in SLOT]).alias("_old"))
    closed = check_slots(distinct_slots(moved), None, working_hours, holidays)
    judged = written(moved.join(closed.drop("booked"), SLOT, "left"))
    able = judged.filter(~F.col("on_holiday") & F.col("in_hours"))
    fixed = old.join(able.select("id"), "id", "left_anti")
    blocked = _look_up(able.select(*SLOT).distinct(), fixed).select(*SLOT, (F.col("booked") > 0).alias("blocked"))
    verdicts, _ = settle_changes(able.join(blocked, SLOT, "left").drop("on_holiday", "in_hours"))
    decided = judged.join(verdicts, "id", "left").select(
        "id", _verdict(F.col("on_holiday"), F.col("in_hours"), F.col("verdict")).alias("message")
    )
    outcome = proposals.join(decided, "id", "left").withColumn(
        "is_accepted", F.col("message").isNull()
    )
    values = [
        F.when(F.col("is_accepted"), F.col(name)).otherwise(F.col(f"_old.{name}")).alias(name)
        for name in new.columns
        if name not in ("id", "version")
    ]
    version = F.col("_old.version") + F.col("is_accepted").cast("int")
    return outcome.select(
        "id", *values, version.alias("version"), "moved", "is_accepted", "message"
    )


def reminder_plan(appointments: DataFrame, as_of: date) -> DataFrame:
    """An e-mail a day ahead for every visit, and an SMS two hours ahead if it is tomorrow."""
    tomorrow = F.lit(as_of + timedelta(days=1))
    entries = F.array(
        F.struct(F.lit("email").alias("kind"), F.lit(EMAIL_HOURS).alias("hours")),
        F.when(
            F.col("appointment_date") == tomorrow,
            F.struct(F.lit("sms").alias("kind"), F.lit(SMS_HOURS).alias("hours")),
        ),
    )
    planned = appointments.select(
        F.col("id").alias("appointment_id"), "appointment_date", "appointment_time",
        F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("r"),
    )
    lead = F.col("appointment_time") - F.col("r.hours") * 3600
    return planned.select(
        "appointment_id", F.col("r.kind").alias("reminder_type"),
        F.col("r.hours").alias("hours_before"),
        moment(F.col("appointment_date"), lead).alias("send_at"),
    )
