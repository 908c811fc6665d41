"""Registered queries: each operator applied to the clinic tables under a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicflow.functions.scalars import json_list, stored
from clinicflow.operators import alerts as al
from clinicflow.operators import audit, billing, inventory, movements, rules, scheduling, sequences, snapshots
from clinicflow.operators.checks import CHECKS
from clinicflow.sources import driver_tables
from clinicflow.sources.driver_tables import AS_OF, MOVEMENT_ORDER, NOW, PROJECTIONS
from clinicflow.sources.schemas import CASCADE, REFERENCES, RESTRICT, SET_NULL
from clinicflow.sources.tables import fill_defaults
from clinicflow.streaming.reminders import plan_reminders
from clinicflow.streaming.sinks import run_available
from clinicflow.streaming.stock_state import track_stock

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Clinic tables of one data folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        return driver_tables.read(self.spark, self.sf_dir, table)

    def stream(self, table: str) -> DataFrame:
        return driver_tables.read(self.spark, self.sf_dir, table, stream=True)


QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


# Scheduling


@query
def appointments_complete(t: Tables) -> DataFrame:
    return scheduling.appointments_complete(t.appointments, t.users, t.appointment_statuses)


@query
def dentist_availability(t: Tables) -> DataFrame:
    return scheduling.dentist_availability(t.users, t.working_hours)


@query
def appointment_end_times(t: Tables) -> DataFrame:
    return t.appointments.select("id", "appointment_time", "duration_minutes", "end_time")


@query
def appointment_overlaps(t: Tables) -> DataFrame:
    return scheduling.overlaps_within(t.appointments).select("id", "overlaps")


@query
def appointment_overlap_flags(t: Tables) -> DataFrame:
    return scheduling.overlap_flags(t.appointments).select("id", "overlaps_earlier")


@query
def appointments_in_hours(t: Tables) -> DataFrame:
    return scheduling.within_hours(t.appointments, t.working_hours).select("id", "dentist_id")


@query
def appointments_on_holidays(t: Tables) -> DataFrame:
    return scheduling.on_holidays(t.appointments, t.holidays).select("id", "appointment_date")


@query
def appointment_overlap_active(t: Tables) -> DataFrame:
    checked = scheduling.overlap_check_active(t.requests, t.bookings, t.appointment_statuses)
    return checked.select("id", "overlaps", "is_accepted", "message")


@query
def appointment_conflicts(t: Tables) -> DataFrame:
    return scheduling.conflicts(t.requests, t.bookings)


@query
def appointment_first_conflicts(t: Tables) -> DataFrame:
    return scheduling.first_conflicts(t.requests, t.bookings).select(
        "id", "blocked_by", "blocked_from", "blocked_until"
    )


@query
def appointment_admission(t: Tables) -> DataFrame:
    admitted = scheduling.admit_appointments(t.requests, t.bookings, t.working_hours, t.holidays)
    return admitted.select(
        "id", "dentist_id", "appointment_date", "appointment_time", "end_time",
        "appointment_code", "is_accepted", "message",
    )


@query
def appointment_admission_codes(t: Tables) -> DataFrame:
    """Admission where codes run out and requests bring codes of their own."""
    admitted = scheduling.admit_appointments(t.coded_requests, t.late_bookings, t.working_hours, t.holidays)
    return admitted.select("id", "appointment_code", "is_accepted", "message")


@query
def appointment_changes(t: Tables) -> DataFrame:
    old = t.appointments
    return scheduling.change_appointments(
        old, t.appointment_proposals, t.working_hours, t.holidays
    ).select(
        "id", "dentist_id", "appointment_date", "appointment_time", "end_time", "reason",
        "version", "moved", "is_accepted", "message",
    )


@query
def appointment_reminder_plan(t: Tables) -> DataFrame:
    return scheduling.reminder_plan(t.appointments, AS_OF)


# Billing


@query
def invoice_totals(t: Tables) -> DataFrame:
    return billing.invoice_totals(
        t.invoices.select("id", "series", "patient_id", "issue_date"),
        billing.line_amounts(t.invoice_details),
    )


@query
def invoice_totals_refresh(t: Tables) -> DataFrame:
    """Totals kept as stored, except for the invoices that have a line with ten percent off."""
    lines = billing.line_amounts(t.invoice_details)
    zero = F.lit(0).cast("decimal(10,2)")
    stored_totals = t.invoices.select("id", *[zero.alias(c) for c in billing.TOTALS])
    touched = lines.filter(F.col("discount_percentage") == 10)
    return billing.refresh_totals(stored_totals, lines, touched)


@query
def invoice_line_amounts(t: Tables) -> DataFrame:
    return billing.line_amounts(t.invoice_details)


@query
def last_correlatives(t: Tables) -> DataFrame:
    return billing.last_correlatives(t.invoices_supplied)


@query
def invoice_numbering(t: Tables) -> DataFrame:
    return billing.number_invoices(t.invoices, t.invoices_supplied).select(
        "id", "series", "correlative", "invoice_number"
    )


@query
def invoice_admission(t: Tables) -> DataFrame:
    existing = t.invoices.withColumn("correlative", F.lit("7"))
    return billing.admit_invoices(t.invoices_supplied, existing).select(
        "id", "series", "correlative", "invoice_number", "is_accepted", "message"
    )


@query
def invoice_detail_defaults(t: Tables) -> DataFrame:
    lines = t.invoice_details.select("invoice_id", "line_no", "service_id", "supplier_id", "unit_price")
    return fill_defaults("invoice_details", lines, NOW).select(
        "invoice_id", "line_no", "service_id", "supplier_id", "quantity", "unit_price",
        "discount_percentage", "discount_amount", "tax_percentage", "tax_amount",
    )


# Inventory


@query
def inventory_status(t: Tables) -> DataFrame:
    return inventory.inventory_status(
        t.inventory_items, t.inventory_categories, t.inventory_alerts
    )


@query
def critical_stock_report(t: Tables) -> DataFrame:
    return inventory.critical_stock_report(
        t.inventory_items, t.inventory_categories, t.inventory_movements, AS_OF
    )


@query
def movement_category(t: Tables) -> DataFrame:
    return t.inventory_movements.select(
        "item_id", *MOVEMENT_ORDER, "total_cost",
        inventory.movement_category(F.col("movement_type")).alias("movement_category"),
    )


@query
def item_available_stock(t: Tables) -> DataFrame:
    return t.inventory_items.select("id", "current_stock", "reserved_stock", "available_stock")


@query
def movement_validation(t: Tables) -> DataFrame:
    return inventory.validate_movements(t.movement_claims, t.inventory_items, MOVEMENT_ORDER)


@query
def ledger_continuity(t: Tables) -> DataFrame:
    return inventory.ledger_breaks(t.movement_claims, MOVEMENT_ORDER)


@query
def running_stock(t: Tables) -> DataFrame:
    return inventory.running_stock(
        t.inventory_movements, t.inventory_items, MOVEMENT_ORDER
    ).select("item_id", *MOVEMENT_ORDER, "running_stock")


def _movement_requests(t: Tables) -> DataFrame:
    return t.inventory_movements.select("item_id", *MOVEMENT_ORDER, "unit_cost", "batch_number")


def _posted(t: Tables, basis: str = "previous") -> DataFrame:
    return inventory.post_movements(
        _movement_requests(t), t.inventory_items, MOVEMENT_ORDER, basis, batches=t.inventory_batches
    )


@query
def movement_admission(t: Tables) -> DataFrame:
    return _posted(t).select(
        "item_id", *MOVEMENT_ORDER, "movement_category", "is_accepted", "message",
        "previous_stock", "new_stock", "approval_required", "is_approved",
    )


LEDGER = ("previous_stock", "new_stock", "average_cost", "last_purchase_cost")


@query
def stock_ledger(t: Tables) -> DataFrame:
    return _posted(t).filter("is_accepted").select("item_id", *MOVEMENT_ORDER, *LEDGER)


@query
def stock_ledger_as_written(t: Tables) -> DataFrame:
    posted = _posted(t, "as_written").filter("is_accepted")
    return posted.select("item_id", *MOVEMENT_ORDER, *LEDGER)


@query
def item_state_after(t: Tables) -> DataFrame:
    return inventory.item_state_after(t.inventory_items, _posted(t), MOVEMENT_ORDER).select(
        "id", "current_stock", "available_stock", "unit_cost", "last_purchase_cost"
    )


@query
def batch_balance(t: Tables) -> DataFrame:
    return inventory.batch_balance(t.inventory_batches, _posted(t)).select(
        "id", "item_id", "batch_number", stored(F.col("quantity_current"), 18).alias("quantity_current")
    )


@query
def movement_batch(t: Tables) -> DataFrame:
    """The next states of four tables after one run of movements, one under the other."""
    done = movements.post_batch(
        _movement_requests(t), t.inventory_items, t.inventory_batches, t.inventory_alerts, MOVEMENT_ORDER
    )
    place = F.concat_ws("|", *MOVEMENT_ORDER)

    def state(table: DataFrame, name: str, item: str, ref: Column, amount: str, cost: str | None, fact: Column) -> DataFrame:
        return table.select(
            F.lit(name).alias("table_name"), F.col(item).alias("item_id"), ref.cast("string").alias("ref"),
            F.col(amount).cast("decimal(18,2)").alias("amount"),
            (F.col(cost) if cost else F.lit(None)).cast("decimal(18,2)").alias("cost"),
            fact.alias("fact"),
        )

    return rules.stack(
        [
            state(done.movements, "inventory_movements", "item_id", place, "new_stock", "average_cost", F.col("message")),
            state(done.items, "inventory_items", "id", F.lit(None), "current_stock", "unit_cost", F.lit(None).cast("string")),
            state(done.batches, "inventory_batches", "item_id", F.col("id"), "quantity_current", None, F.col("batch_number")),
            state(
                done.alerts, "inventory_alerts", "item_id", F.col("id"), "current_value", None,
                F.concat_ws("|", "alert_type", "alert_level", F.when(F.col("is_resolved"), "resolved").otherwise("open")),
            ),
        ]
    )


@query
def batches_deactivate(t: Tables) -> DataFrame:
    return inventory.deactivate_batches(t.inventory_batches).select("id", "is_active")


# Alerts

ALERT = (
    "item_id", "alert_type", "alert_level", "title", "message", "threshold_value",
    "current_value", "expiration_date", "batch_number", "is_read", "is_resolved",
    "resolved_at", "auto_resolve_date", "created_at", "updated_at",
)


@query
def pending_alerts(t: Tables) -> DataFrame:
    return al.pending_alerts(t.inventory_alerts, t.inventory_items, t.inventory_categories)


@query
def expiration_feed(t: Tables) -> DataFrame:
    return al.expiration_feed(t.inventory_items, t.inventory_batches, NOW)


@query
def expiration_alerts(t: Tables) -> DataFrame:
    return al.daily_alerts(
        t.inventory_alerts, t.inventory_items, t.inventory_batches, NOW
    ).select("id", *ALERT)


@query
def alerts_purge(t: Tables) -> DataFrame:
    return al.purge_alerts(t.inventory_alerts, NOW).select("id", "auto_resolve_date")


@query
def low_stock_alerts(t: Tables) -> DataFrame:
    return al.low_stock_alerts(
        t.inventory_alerts, _posted(t), t.inventory_items, MOVEMENT_ORDER
    ).select("id", *ALERT)


@query
def alerts_resolve_replenished(t: Tables) -> DataFrame:
    return al.resolve_replenished(t.inventory_alerts, _posted(t)).select(
        "id", "is_resolved", "resolved_at", "auto_resolve_date"
    )


@query
def alerts_resolve_empty(t: Tables) -> DataFrame:
    unread = t.inventory_alerts.filter(~F.col("is_read"))
    return al.resolve_empty(t.inventory_alerts, t.inventory_items, unread, NOW).select(
        "id", "is_resolved", "auto_resolve_date"
    )


# Documents


@query
def code_generation(t: Tables) -> DataFrame:
    today = F.lit(AS_OF)
    documents = [
        ("CITA", t.requests, t.bookings, "appointment_code"),
        ("HC", t.medical_records, t.medical_records, "record_number"),
        ("RX", t.prescriptions, t.prescriptions, "prescription_number"),
        ("LAB", t.laboratory_orders, t.laboratory_orders, "order_number"),
    ]
    coded = [
        sequences.assign_codes(new, existing, kind, code, today).select(
            F.lit(kind).alias("kind"), "id", F.col(code).alias("code"), "code_overflow"
        )
        for kind, new, existing, code in documents
    ]
    return rules.stack(coded)


@query
def lab_order_tests(t: Tables) -> DataFrame:
    return t.laboratory_orders.select(
        "id", F.explode(json_list(F.col("tests_requested"))).alias("test")
    )


# Users


@query
def user_audit_insert(t: Tables) -> DataFrame:
    return audit.created_users(t.users, NOW)


@query
def user_audit_update(t: Tables) -> DataFrame:
    return audit.updated_users(t.users, t.users_new, NOW)


@query
def user_audit_critical(t: Tables) -> DataFrame:
    return audit.critical_changes(t.users, t.users_new, NOW)


@query
def login_reset(t: Tables) -> DataFrame:
    return audit.reset_after_login(t.users, t.users_new).select(
        "id", "last_login", "failed_login_attempts", "last_failed_login", "locked_until"
    )


@query
def password_rotation(t: Tables) -> DataFrame:
    return audit.rotate_after_password(t.users, t.users_new, NOW).select(
        "id", "jwt_version", "password_changed_at", "session_id"
    )


# Data quality


@query
def dq_not_null(t: Tables) -> DataFrame:
    return rules.stack(
        [
            rules.missing_values(t.asked_visits, "appointments", complete=False),
            rules.missing_values(t.medical_records, "medical_records", complete=False),
            rules.missing_values(t.invoices, "invoices", complete=False),
            rules.missing_values(t.audit_logs, "audit_logs", complete=False),
            rules.missing_values(t.support_tickets, "support_tickets", complete=False),
        ]
    )


@query
def dq_domain(t: Tables) -> DataFrame:
    """Balances are what would be left if no movement were refused."""
    asked = t.inventory_movements.withColumn(
        "movement_category", inventory.movement_category(F.col("movement_type"))
    )
    balance = inventory.batch_balance(t.inventory_batches, asked).select(
        "id", "item_id", "batch_number", "quantity_current"
    )
    return rules.stack(
        [
            rules.out_of_domain(balance, "inventory_batches"),
            rules.out_of_domain(t.inventory_items, "inventory_items"),
            rules.out_of_domain(t.users, "users"),
            rules.out_of_domain(t.appointments, "appointments"),
            rules.out_of_domain(t.support_tickets, "support_tickets"),
            rules.out_of_domain(t.user_profiles, "user_profiles"),
        ]
    )


@query
def dq_enum(t: Tables) -> DataFrame:
    return rules.stack(
        [
            rules.unknown_choices(t.audit_logs, "audit_logs"),
            rules.unknown_choices(t.users, "users"),
            rules.unknown_choices(t.inventory_alerts, "inventory_alerts"),
            rules.unknown_choices(t.support_tickets, "support_tickets"),
        ]
    )


@query
def dq_unique(t: Tables) -> DataFrame:
    return rules.stack(
        [
            rules.duplicate_keys(t.appointments, "appointments"),
            rules.duplicate_keys(t.inventory_batches, "inventory_batches"),
            rules.duplicate_keys(t.inventory_alerts, "inventory_alerts"),
            rules.duplicate_keys(t.users, "users"),
            rules.duplicate_keys(t.support_tickets, "support_tickets"),
        ]
    )


@query
def dq_orphans(t: Tables) -> DataFrame:
    """References to users who are no longer active, or to items and categories not there."""
    parents = {
        "users": t.users_new.filter("is_active"),
        "inventory_items": t.inventory_items.filter("is_active"),
        "inventory_categories": t.inventory_categories,
    }
    return rules.stack(
        [
            rules.orphans(t.appointments, "appointments", parents),
            rules.orphans(t.audit_logs, "audit_logs", parents),
            rules.orphans(t.inventory_alerts, "inventory_alerts", parents),
            rules.orphans(t.inventory_items, "inventory_items", parents),
            rules.orphans(t.support_tickets, "support_tickets", parents),
        ]
    )


@query
def dq_declared(t: Tables) -> DataFrame:
    """Required columns, widths, ranges and permitted values of every table, and columns not there at all."""
    tables = [(table, getattr(t, p)) for table, p in PROJECTIONS.items()]
    reports = [rules.declared_violations(df, table) for table, df in tables]
    return rules.stack([rules.absent_columns(t.spark, tables), *reports])


@query
def dq_keys(t: Tables) -> DataFrame:
    """Every primary and unique key. Lines and movements have no id of their own."""
    lacking = ("invoice_details", "inventory_movements")
    return rules.repeated_keys([(table, getattr(t, p)) for table, p in PROJECTIONS.items() if table not in lacking])


@query
def dq_references(t: Tables) -> DataFrame:
    """Every reference of every table, to all rows of the parents but for users, who must be active."""
    tables = [(table, getattr(t, p)) for table, p in PROJECTIONS.items()]
    parents = {
        table: df for table, df in tables
        if any(table == p for refs in REFERENCES.values() for p, _ in refs.values())
    }
    parents["users"] = t.users_new.filter("is_active")
    return rules.lost_references([*tables, ("invoices", t.invoice_references)], parents)


@query
def dq_checks(t: Tables) -> DataFrame:
    """Invoice lines and movements have no id of their own and name their document."""
    lines = billing.line_amounts(t.invoice_details)
    totals = billing.invoice_totals(t.invoices, lines)
    checked = {
        "appointments": t.appointments, "working_hours": t.working_hours,
        "appointment_statuses": t.appointment_statuses, "invoices": totals,
        "inventory_items": t.inventory_items, "inventory_batches": t.inventory_batches,
        "inventory_categories": t.inventory_categories, "medical_records": t.medical_records,
        "prescriptions": t.prescriptions, "laboratory_orders": t.laboratory_orders,
        "audit_logs": t.audit_logs, "users": t.users,
        "invoice_details": lines.withColumn("id", F.col("invoice_id")),
        "inventory_movements": t.movement_claims.withColumn("id", F.col("order_no")),
    }
    apart = {
        ("invoices", "payment reference"): t.invoice_references,
        ("users", "lockouts"): t.user_limits,
        ("users", "birth date"): t.user_limits,
        ("inventory_categories", "sort order"): t.category_places,
        ("inventory_movements", "approval"): t.movement_approvals,
    }
    reports = [rules.failed_checks(df, table, _checks(table, None, apart)) for table, df in checked.items()]
    for table, rule in apart:
        reports.append(rules.failed_checks(apart[table, rule], table, _checks(table, {(table, rule)}, apart)))
    alone = (
        "appointment_unavailabilities", "appointment_reminders", "services", "invoice_payments",
        "treatment_types", "treatment_records", "medical_record_files", "notifications",
        "support_ticket_messages", "system_maintenance", "user_profiles",
    )
    reports += [rules.failed_checks(getattr(t, table), table, CHECKS[table](NOW)) for table in alone]
    return rules.stack(reports)


def _checks(table: str, mine: set | None, apart: dict) -> dict:
    """The checks of a table that are in `mine`, or that no other projection is asked for."""
    def here(rule: str) -> bool:
        return (table, rule) not in apart if mine is None else (table, rule) in mine

    return {rule: c for rule, c in CHECKS[table](NOW).items() if here(rule)}


# Deleting


@query
def delete_cascade(t: Tables) -> DataFrame:
    closed = t.invoices.filter(F.col("o_orderstatus") == "F").select("id")
    after, _ = snapshots.on_delete(t.invoice_details, "invoice_id", closed, CASCADE)
    return after.select("invoice_id", "line_no", "service_id", "supplier_id", "quantity")


@query
def delete_set_null(t: Tables) -> DataFrame:
    gone = t.users_new.filter(~F.col("is_active")).select("id")
    after, _ = snapshots.on_delete(t.audit_logs, "user_id", gone, SET_NULL)
    return after.select("id", "user_id", "record_id")


@query
def delete_restrict(t: Tables) -> DataFrame:
    gone = t.users_new.filter(~F.col("is_active")).select("id")
    _, blocked = snapshots.on_delete(t.invoices, "patient_id", gone, RESTRICT)
    return blocked


@query
def delete_users(t: Tables) -> DataFrame:
    """What is left of users, and of the tables that refer to them, when inactive users go."""
    tables = {
        "users": t.users_new, "invoices": t.invoices, "appointments": t.appointments,
        "audit_logs": t.audit_logs, "working_hours": t.working_hours,
        "medical_records": t.medical_records, "prescriptions": t.prescriptions,
    }
    gone = t.users_new.filter(~F.col("is_active")).select("id")
    after, blocked = snapshots.delete_rows(tables, "users", gone)
    shown = {"users": F.lit(None), "audit_logs": F.col("user_id"), "working_hours": F.col("dentist_id")}
    left = [
        after[name].select(F.lit(name).alias("table_name"), "id", column.cast("bigint").alias("reference"))
        for name, column in shown.items()
    ]
    kept = blocked.select(F.lit("blocked").alias("table_name"), "id", F.lit(None).cast("bigint").alias("reference"))
    return rules.stack([*left, kept])


# Streams


@query
def stream_stock_state(t: Tables) -> DataFrame:
    tracked = track_stock(t.stream("movement_claims"), t.inventory_items, MOVEMENT_ORDER)
    return run_available(tracked, partition_by=("is_accepted",)).select(
        "item_id", *MOVEMENT_ORDER, "is_accepted", "message", "current_stock", "average_cost",
        "last_purchase_cost",
    )


@query
def stream_reminders(t: Tables) -> DataFrame:
    return run_available(plan_reminders(t.stream("appointments"), AS_OF))
