"""The declared row checks of every table, as conditions that must not be false.

Limits, patterns and permitted values are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinicflow.functions.scalars import folded, json_valid

HEX_COLOR = "^#[0-9A-Fa-f]{6}$"
APPOINTMENT_CODE = "^CITA-[0-9]{6}-[0-9]{4}$"
INVOICE_SERIES = "^[BF][0-9]{3}$"
CORRELATIVE = "^[0-9]{1,8}$"
TOOTH = "^[1-8][1-8]$"
DNI, FOREIGN_CARD = "^[0-9]{8}$", "^[0-9]{9}$"
PASSPORT_BYTES = (6, 20)
VISIT_MINUTES, SERVICE_MINUTES = (15, 480), (5, 480)
CLINIC_OPENS, CLINIC_CLOSES = 7 * 3600, 20 * 3600
WEEKDAYS, CATEGORY_LEVELS, LEAD_HOURS = (1, 7), (1, 5), (1, 168)
SYSTEM_LEAD_HOURS = (1, 2, 6, 12, 24, 48, 72)
PERCENT, TAX_PERCENT = (0, 100), (0, 25)
MOST_RETRIES, MOST_FAILURES, MOST_LOCKOUTS, MOST_YEARS = 5, 10, 50, 70
SHORTEST_REFERENCE = 3
FILE_TYPES = (
    "image/jpeg", "image/png", "application/pdf", "image/dicom", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
)

C = F.col
Checks = dict[str, Column]


def every(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def either(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def at_least_zero(*names: str) -> Column:
    return every(*[C(n) >= 0 for n in names])


def matches(name: str, pattern: str) -> Column:
    """Pattern match that ignores case, as the tables' text comparison does."""
    return C(name).rlike(f"(?i){pattern}")


def unset_or(name: str, condition: Column) -> Column:
    return C(name).isNull() | condition


def span_or_nothing(start: str, end: str, *inside: Column) -> Column:
    """Both ends missing, or both present, in order and within the given bounds."""
    none = C(start).isNull() & C(end).isNull()
    both = every(C(start).isNotNull(), C(end).isNotNull(), *inside, C(start) < C(end))
    return none | both


def appointment_statuses(now: datetime) -> Checks:
    return {"color": matches("color", HEX_COLOR)}


def appointments(now: datetime) -> Checks:
    at = F.lit(now)
    return {
        "duration": C("duration_minutes").between(*VISIT_MINUTES),
        "date in the past": C("appointment_date") >= F.lit(now.date()),
        "arrival times": every(
            unset_or("arrived_at", C("arrived_at") <= F.coalesce(C("started_at"), at)),
            unset_or("started_at", C("started_at") <= F.coalesce(C("finished_at"), at)),
        ),
        "code format": matches("appointment_code", APPOINTMENT_CODE),
        "clinic hours": C("appointment_time").between(CLINIC_OPENS, CLINIC_CLOSES),
    }


def working_hours(now: datetime) -> Checks:
    return {
        "weekday": C("day_of_week").between(*WEEKDAYS),
        "start before end": C("start_time") < C("end_time"),
        "validity": unset_or("valid_until", C("valid_until") >= C("valid_from")),
        "break": span_or_nothing(
            "break_start_time", "break_end_time",
            C("break_start_time") >= C("start_time"), C("break_end_time") <= C("end_time"),
        ),
    }


def appointment_unavailabilities(now: datetime) -> Checks:
    return {
        "dates": C("start_date") <= C("end_date"),
        "times": span_or_nothing("start_time", "end_time"),
    }


def appointment_reminders(now: datetime) -> Checks:
    return {
        "retries": C("retry_count") <= MOST_RETRIES,
        "hours before": C("hours_before").between(*LEAD_HOURS),
        "system hours before": C("hours_before").isin(*SYSTEM_LEAD_HOURS),
    }


def services(now: datetime) -> Checks:
    return {
        "price": at_least_zero("price"),
        "duration": C("duration_minutes").between(*SERVICE_MINUTES),
    }


def invoices(now: datetime) -> Checks:
    due = C("subtotal") - C("discount_amount") + C("tax_amount")
    return {
        "amounts": at_least_zero("subtotal", "discount_amount", "tax_amount", "total_amount")
        & (C("total_amount") == due),
        "due date": unset_or("due_date", C("due_date") >= C("issue_date")),
        "series format": matches("series", INVOICE_SERIES),
        "correlative format": matches("correlative", CORRELATIVE),
        "payment reference": either(
            C("payment_method_id").isNull(), C("payment_reference").isNull(),
            F.octet_length("payment_reference") >= SHORTEST_REFERENCE,
        ),
    }


def invoice_details(now: datetime) -> Checks:
    return {
        "quantity": C("quantity") > 0,
        "unit price": at_least_zero("unit_price"),
        "discount percentage": C("discount_percentage").between(*PERCENT),
        "tax percentage": C("tax_percentage").between(*TAX_PERCENT),
        "amounts": at_least_zero("discount_amount", "tax_amount", "subtotal", "total_price"),
    }


def invoice_payments(now: datetime) -> Checks:
    return {"amount": C("amount") > 0}


def inventory_categories(now: datetime) -> Checks:
    return {
        "level": C("level").between(*CATEGORY_LEVELS),
        "sort order": at_least_zero("sort_order"),
    }


def inventory_items(now: datetime) -> Checks:
    return {
        "stock": every(
            at_least_zero("current_stock", "minimum_stock", "reserved_stock"),
            C("reserved_stock") <= C("current_stock"),
            unset_or("maximum_stock", C("maximum_stock") >= C("minimum_stock")),
        ),
        "cost": at_least_zero("unit_cost")
        & unset_or("last_purchase_cost", at_least_zero("last_purchase_cost")),
        "expiration": ~C("has_expiration")
        | (C("has_expiration") & C("expiration_alert_days").isNotNull() & (C("expiration_alert_days") > 0)),
    }


def inventory_movements(now: datetime) -> Checks:
    kind = folded(C("movement_category"))
    signed = either(
        (kind == "in") & (C("quantity") > 0), (kind == "out") & (C("quantity") < 0),
        kind == "adjustment",
    )
    return {
        "quantity": signed,
        "stock values": at_least_zero("previous_stock", "new_stock"),
        "approval": ~C("approval_required")
        | (C("approval_required") & (C("is_approved") == C("approved_by").isNotNull())),
    }


def inventory_batches(now: datetime) -> Checks:
    return {
        "quantity": every(
            C("quantity_received") > 0, at_least_zero("quantity_current"),
            C("quantity_current") <= C("quantity_received"),
        ),
        "dates": C("expiration_date") > C("purchase_date"),
    }


def medical_records(now: datetime) -> Checks:
    return {
        "visit date": C("visit_date") <= F.lit(now.date()),
        "next visit": unset_or("next_visit_date", C("next_visit_date") > C("visit_date")),
    }


def treatment_types(now: datetime) -> Checks:
    return {
        "duration": C("estimated_duration").between(*SERVICE_MINUTES),
        "price": at_least_zero("base_price"),
    }


def treatment_records(now: datetime) -> Checks:
    return {
        "price": at_least_zero("final_price"),
        "tooth number": unset_or("tooth_number", matches("tooth_number", TOOTH)),
    }


def medical_record_files(now: datetime) -> Checks:
    return {"size": C("file_size") > 0, "file type": folded(C("file_type")).isin(*FILE_TYPES)}


def prescriptions(now: datetime) -> Checks:
    return {
        "date": C("prescription_date") <= F.lit(now.date()),
        "medications": json_valid(C("medications")),
    }


def laboratory_orders(now: datetime) -> Checks:
    return {
        "date": C("order_date") <= F.lit(now.date()),
        "tests": json_valid(C("tests_requested")),
    }


def notifications(now: datetime) -> Checks:
    return {"retries": C("retry_count") <= MOST_RETRIES}


def audit_logs(now: datetime) -> Checks:
    return {"old values": json_valid(C("old_values")), "new values": json_valid(C("new_values"))}


def support_ticket_messages(now: datetime) -> Checks:
    return {"attachments": json_valid(C("attachments"))}


def system_maintenance(now: datetime) -> Checks:
    return {
        "dates": C("ends_at") > C("starts_at"),
        "modules": json_valid(C("affected_modules")),
    }


def users(now: datetime) -> Checks:
    kind = folded(C("document_type"))
    return {
        "document": either(
            (kind == "dni") & matches("document_number", DNI),
            (kind == "ce") & matches("document_number", FOREIGN_CARD),
            (kind == "passport") & F.octet_length("document_number").between(*PASSPORT_BYTES),
        ),
        "failed attempts": C("failed_login_attempts") <= MOST_FAILURES,
        "lockouts": C("lockout_count") <= MOST_LOCKOUTS,
        "birth date": C("birth_date") <= F.lit(now.date()),
        "token version": C("jwt_version") > 0,
    }


def user_profiles(now: datetime) -> Checks:
    return {
        "experience": C("years_experience") <= MOST_YEARS,
        "salary": unset_or("salary", at_least_zero("salary")),
    }


CHECKS: dict[str, Callable[[datetime], Checks]] = {
    f.__name__: f
    for f in (
        appointment_statuses, appointments, working_hours, appointment_unavailabilities,
        appointment_reminders, services, invoices, invoice_details, invoice_payments,
        inventory_categories, inventory_items, inventory_movements, inventory_batches,
        medical_records, treatment_types, treatment_records, medical_record_files,
        prescriptions, laboratory_orders, notifications, audit_logs, support_ticket_messages,
        system_maintenance, users, user_profiles,
    )
}
