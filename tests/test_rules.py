"""Violation reports: every declared check, keys, references and domains."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from clinicflow.operators import rules
from clinicflow.operators.checks import CHECKS
from clinicflow.sources import seeds
from clinicflow.sources.schemas import REFERENCES, TABLES, UNIQUE, schema

D = Decimal
NOW = datetime(2024, 1, 15, 12)
TODAY, LATER = NOW.date(), NOW.date() + timedelta(days=1)
HOUR = timedelta(hours=1)

# table -> check -> (rows that pass, rows that fail), as the columns the check looks at
CASES = {
    "appointment_statuses": {"color": ([{"color": "#a0B1c2"}], [{"color": "#12345"}, {"color": "red"}])},
    "appointments": {
        "duration": ([{"duration_minutes": 15}, {"duration_minutes": 480}], [{"duration_minutes": 14}, {"duration_minutes": 481}]),
        "date in the past": ([{"appointment_date": TODAY}], [{"appointment_date": TODAY - timedelta(days=1)}]),
        "arrival times": (
            [{"arrived_at": NOW, "started_at": NOW, "finished_at": NOW}, {"arrived_at": NOW}],
            [{"arrived_at": NOW, "started_at": NOW - HOUR}, {"arrived_at": NOW + HOUR},
             {"started_at": NOW, "finished_at": NOW - HOUR}],
        ),
        "code format": ([{"appointment_code": "cita-202401-0001"}], [{"appointment_code": "CITA-202401-001"}]),
        "clinic hours": ([{"appointment_time": 25200}, {"appointment_time": 72000}], [{"appointment_time": 25199}, {"appointment_time": 72001}]),
    },
    "working_hours": {
        "weekday": ([{"day_of_week": 1}, {"day_of_week": 7}], [{"day_of_week": 0}, {"day_of_week": 8}]),
        "start before end": ([{"start_time": 1, "end_time": 2}], [{"start_time": 2, "end_time": 2}]),
        "validity": ([{"valid_from": TODAY, "valid_until": TODAY}], [{"valid_from": LATER, "valid_until": TODAY}]),
        "break": (
            [{"start_time": 0, "end_time": 9, "break_start_time": 0, "break_end_time": 9}, {"start_time": 0, "end_time": 9}],
            [{"start_time": 1, "end_time": 9, "break_start_time": 0, "break_end_time": 5},
             {"start_time": 1, "end_time": 9, "break_start_time": 3, "break_end_time": 10},
             {"start_time": 1, "end_time": 9, "break_start_time": 3, "break_end_time": 3},
             {"start_time": 1, "end_time": 9, "break_start_time": 3}],
        ),
    },
    "appointment_unavailabilities": {
        "dates": ([{"start_date": TODAY, "end_date": TODAY}], [{"start_date": LATER, "end_date": TODAY}]),
        "times": ([{}, {"start_time": 1, "end_time": 2}], [{"start_time": 2, "end_time": 2}, {"start_time": 2}, {"end_time": 2}]),
    },
    "appointment_reminders": {
        "retries": ([{"retry_count": 5}], [{"retry_count": 6}]),
        "hours before": ([{"hours_before": 1}, {"hours_before": 168}], [{"hours_before": 0}, {"hours_before": 169}]),
        "system hours before": ([{"hours_before": h} for h in (1, 2, 6, 12, 24, 48, 72)], [{"hours_before": 3}]),
    },
    "services": {
        "price": ([{"price": D(0)}], [{"price": D("-0.01")}]),
        "duration": ([{"duration_minutes": 5}, {"duration_minutes": 480}], [{"duration_minutes": 4}, {"duration_minutes": 481}]),
    },
    "invoices": {
        "amounts": (
            [dict(subtotal=D(10), discount_amount=D(1), tax_amount=D(2), total_amount=D(11))],
            [dict(subtotal=D(10), discount_amount=D(1), tax_amount=D(2), total_amount=D(12)),
             dict(subtotal=D(-1), discount_amount=D(0), tax_amount=D(0), total_amount=D(-1))],
        ),
        "due date": ([{"due_date": TODAY, "issue_date": TODAY}, {"issue_date": TODAY}], [{"due_date": TODAY, "issue_date": LATER}]),
        "series format": ([{"series": "F001"}, {"series": "b999"}], [{"series": "X001"}, {"series": "F01"}]),
        "correlative format": ([{"correlative": "1"}, {"correlative": "00000001"}], [{"correlative": "123456789"}, {"correlative": "1a"}]),
        "payment reference": (
            [{"payment_method_id": 1}, {"payment_reference": "x"}, {"payment_method_id": 1, "payment_reference": "abc"},
             {"payment_method_id": 1, "payment_reference": "ñé"}],
            [{"payment_method_id": 1, "payment_reference": "ab"}],
        ),
    },
    "invoice_details": {
        "quantity": ([{"quantity": 1}], [{"quantity": 0}]),
        "unit price": ([{"unit_price": D(0)}], [{"unit_price": D(-1)}]),
        "discount percentage": ([{"discount_percentage": D(0)}, {"discount_percentage": D(100)}], [{"discount_percentage": D("100.01")}]),
        "tax percentage": ([{"tax_percentage": D(25)}], [{"tax_percentage": D("25.01")}, {"tax_percentage": D(-1)}]),
        "amounts": ([dict(discount_amount=D(0), tax_amount=D(0), subtotal=D(0), total_price=D(0))], [dict(total_price=D(-1)), dict(tax_amount=D(-1))]),
    },
    "invoice_payments": {"amount": ([{"amount": D("0.01")}], [{"amount": D(0)}])},
    "inventory_categories": {
        "level": ([{"level": 1}, {"level": 5}], [{"level": 0}, {"level": 6}]),
        "sort order": ([{"sort_order": 0}], [{"sort_order": -1}]),
    },
    "inventory_items": {
        "stock": (
            [dict(current_stock=D(2), minimum_stock=D(1), reserved_stock=D(2), maximum_stock=D(1)),
             dict(current_stock=D(2), minimum_stock=D(1), reserved_stock=D(0))],
            [dict(current_stock=D(1), minimum_stock=D(1), reserved_stock=D(2)),
             dict(current_stock=D(2), minimum_stock=D(2), reserved_stock=D(0), maximum_stock=D(1)),
             dict(current_stock=D(-1), minimum_stock=D(1), reserved_stock=D(-2))],
        ),
        "cost": ([{"unit_cost": D(0)}], [{"unit_cost": D(-1)}, {"unit_cost": D(1), "last_purchase_cost": D(-1)}]),
        "expiration": (
            [{"has_expiration": False}, {"has_expiration": True, "expiration_alert_days": 1}],
            [{"has_expiration": True}, {"has_expiration": True, "expiration_alert_days": 0}],
        ),
    },
    "inventory_movements": {
        "quantity": (
            [dict(movement_category="in", quantity=D(1)), dict(movement_category="OUT", quantity=D(-1)), dict(movement_category="adjustment", quantity=D(0))],
            [dict(movement_category="in", quantity=D(0)), dict(movement_category="out", quantity=D(1))],
        ),
        "stock values": ([dict(previous_stock=D(0), new_stock=D(0))], [dict(previous_stock=D(0), new_stock=D(-1))]),
        "approval": (
            [dict(approval_required=False, is_approved=True), dict(approval_required=True, is_approved=False),
             dict(approval_required=True, is_approved=True, approved_by=4)],
            [dict(approval_required=True, is_approved=True), dict(approval_required=True, is_approved=False, approved_by=4)],
        ),
    },
    "inventory_batches": {
        "quantity": (
            [dict(quantity_received=D(2), quantity_current=D(2)), dict(quantity_received=D(2), quantity_current=D(0))],
            [dict(quantity_received=D(0), quantity_current=D(0)), dict(quantity_received=D(1), quantity_current=D(2)),
             dict(quantity_received=D(1), quantity_current=D(-1))],
        ),
        "dates": ([dict(expiration_date=LATER, purchase_date=TODAY)], [dict(expiration_date=TODAY, purchase_date=TODAY)]),
    },
    "medical_records": {
        "visit date": ([{"visit_date": TODAY}], [{"visit_date": LATER}]),
        "next visit": ([{"visit_date": TODAY, "next_visit_date": LATER}], [{"visit_date": TODAY, "next_visit_date": TODAY}]),
    },
    "treatment_types": {
        "duration": ([{"estimated_duration": 5}], [{"estimated_duration": 4}]),
        "price": ([{"base_price": D(0)}], [{"base_price": D(-1)}]),
    },
    "treatment_records": {
        "price": ([{"final_price": D(0)}], [{"final_price": D(-1)}]),
        "tooth number": ([{"tooth_number": "11"}, {"tooth_number": "88"}, {}], [{"tooth_number": "19"}, {"tooth_number": "1"}]),
    },
    "medical_record_files": {
        "size": ([{"file_size": 1}], [{"file_size": 0}]),
        "file type": ([{"file_type": "image/PNG"}], [{"file_type": "text/plain"}]),
    },
    "prescriptions": {
        "date": ([{"prescription_date": TODAY}], [{"prescription_date": LATER}]),
        "medications": ([{"medications": "[]"}], [{"medications": "["}]),
    },
    "laboratory_orders": {
        "date": ([{"order_date": TODAY}], [{"order_date": LATER}]),
        "tests": ([{"tests_requested": "null"}], [{"tests_requested": "x"}]),
    },
    "notifications": {"retries": ([{"retry_count": 5}], [{"retry_count": 6}])},
    "audit_logs": {
        "old values": ([{"old_values": "{}"}, {}], [{"old_values": "{"}]),
        "new values": ([{"new_values": "{}"}, {}], [{"new_values": "{} {}"}]),
    },
    "support_ticket_messages": {"attachments": ([{"attachments": '["u"]'}, {}], [{"attachments": "u"}])},
    "system_maintenance": {
        "dates": ([{"starts_at": NOW, "ends_at": NOW + HOUR}], [{"starts_at": NOW, "ends_at": NOW}]),
        "modules": ([{"affected_modules": "[]"}, {}], [{"affected_modules": ""}]),
    },
    "users": {
        "document": (
            [dict(document_type="DNI", document_number="12345678"), dict(document_type="ce", document_number="123456789"),
             dict(document_type="PASSPORT", document_number="ABñ456")],
            [dict(document_type="DNI", document_number="1234567"), dict(document_type="CE", document_number="12345678"),
             dict(document_type="PASSPORT", document_number="AB456"), dict(document_type="other", document_number="12345678")],
        ),
        "failed attempts": ([{"failed_login_attempts": 10}], [{"failed_login_attempts": 11}]),
        "lockouts": ([{"lockout_count": 50}], [{"lockout_count": 51}]),
        "birth date": ([{"birth_date": TODAY}], [{"birth_date": LATER}]),
        "token version": ([{"jwt_version": 1}], [{"jwt_version": 0}]),
    },
    "user_profiles": {
        "experience": ([{"years_experience": 70}], [{"years_experience": 71}]),
        "salary": ([{"salary": D(0)}, {}], [{"salary": D(-1)}]),
    },
}


def frame(spark, table, rows):
    fields = schema(table)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def test_every_check_has_cases(spark):
    assert {t: set(CHECKS[t](NOW)) for t in CHECKS} == {t: set(CASES[t]) for t in CASES}


@pytest.mark.parametrize("table", sorted(CASES))
def test_checks(spark, table):
    """Passing rows pass, failing rows fail, and a row of NULLs breaks nothing."""
    rows, expected = [{"id": 0}], set()
    for rule, (good, bad) in CASES[table].items():
        rows += [{**r, "id": len(rows) + n} for n, r in enumerate(good)]
        for r in bad:
            expected.add((rule, len(rows)))
            rows.append({**r, "id": len(rows)})
    found = rules.failed_checks(frame(spark, table, rows), table, CHECKS[table](NOW)).collect()
    hits = {(r.rule, r.id) for r in found}
    assert expected <= hits
    passing = {n for n in range(len(rows))} - {n for _, n in expected}
    for rule, (good, _) in CASES[table].items():
        ids = [r["id"] for r in rows if r["id"] in passing and {k: v for k, v in r.items() if k != "id"} in good]
        assert not {(rule, n) for n in ids} & hits
    assert not any(n == 0 for _, n in hits)


def test_required_range_and_choice_rules(spark):
    rows = [
        dict(id=1, document_type="DNI", document_number="1" * 21, email="a@x.pe", password="p", first_name="A",
             last_name="B", role_id=-1, is_active=True, failed_login_attempts=300, lockout_count=0, jwt_version=1),
        dict(id=2, document_type="dni ", document_number="1", email=None, password="p", first_name="A", gender="Z",
             last_name="B", role_id=1, is_active=None, failed_login_attempts=0, lockout_count=0, jwt_version=1),
    ]
    df = frame(spark, "users", rows)
    assert {(r.rule, r.id) for r in rules.missing_values(df, "users").collect()} == {("email", 2), ("is_active", 2)}
    assert {(r.rule, r.id) for r in rules.out_of_domain(df, "users").collect()} == {
        ("document_number too long", 1), ("role_id too small", 1), ("failed_login_attempts too large", 1),
    }
    assert {(r.rule, r.id) for r in rules.unknown_choices(df, "users").collect()} == {("gender", 2)}


def test_movement_quantities_may_be_negative(spark):
    df = frame(spark, "inventory_movements", [dict(id=1, quantity=D(-5), previous_stock=D(-1))])
    assert [r.rule for r in rules.out_of_domain(df, "inventory_movements").collect()] == ["previous_stock too small"]


def test_unique_keys_ignore_case_accents_and_nulls(spark):
    rows = [
        dict(id=1, code="A1 ", barcode=None, name="x"), dict(id=2, code="a1", barcode=None, name="x"),
        dict(id=3, code="b1", barcode="7", name="x"), dict(id=3, code="c1", barcode="7", name="x"),
    ]
    found = rules.duplicate_keys(frame(spark, "inventory_items", rows), "inventory_items").collect()
    assert {(r.rule, r.key_value, r.copies, r.first_id) for r in found} == {
        ("code", "a1", 2, 1), ("barcode", "7", 2, 3), ("id", "3", 2, 3),
    }
    roles = frame(spark, "roles", [dict(id=1, name="José"), dict(id=2, name="JOSE ")])
    assert [(r.rule, r.copies) for r in rules.duplicate_keys(roles, "roles").collect()] == [("name", 2)]


def test_seed_holidays_repeat_two_names(spark):
    found = rules.duplicate_keys(seeds.holidays(spark), "holidays").collect()
    assert sorted((r.rule, r.copies) for r in found) == [("name,is_recurring,year", 2)] * 2


def test_orphans_skip_nulls(spark):
    df = frame(spark, "inventory_categories", [dict(id=1), dict(id=2, parent_id=1), dict(id=3, parent_id=9)])
    found = rules.orphans(df, "inventory_categories", {"inventory_categories": df}).collect()
    assert [(r.rule, r.id, r.value) for r in found] == [("parent_id -> inventory_categories", 3, 9)]


def test_declarations_name_real_columns(spark):
    assert len(TABLES) == 35
    for table, keys in UNIQUE.items():
        assert all(c in TABLES[table] or c == "year" for key in keys for c in key)
    for table, columns in REFERENCES.items():
        assert set(columns) <= set(TABLES[table])
        assert {parent for parent, _ in columns.values()} <= set(TABLES)


def test_absent_required_columns_are_reported(spark):
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    found = rules.missing_values(users, "users").collect()
    needed = [n for n, f in TABLES["users"].items() if f.need and n != "id"]
    assert len(found) == 2 * len(needed) > 0
    assert rules.missing_values(users, "users", complete=False).count() == 0


def test_declared_rules_of_single_rows(spark):
    df = spark.createDataFrame(
        [
            (1, "x" * 20, "Name", Decimal("1.00"), 30), (2, None, "n" * 101, Decimal("-0.01"), -1),
            (3, "x" * 21, None, Decimal("1000000.00"), 70000), (4, "c", "n", None, None),
        ],
        "id int, code string, name string, price decimal(12,2), duration_minutes int",
    )
    found = {(r.rule, r.id) for r in rules.declared_violations(df, "services").collect()}
    assert found == {
        ("code missing", 2), ("name too long", 2), ("price too small", 2), ("duration_minutes too small", 2),
        ("code too long", 3), ("name missing", 3), ("price too large", 3), ("duration_minutes too large", 3),
        ("price missing", 4), ("duration_minutes missing", 4),
    }
    kinds = spark.createDataFrame([(1, "CASH "), (2, "cheque"), (3, None)], "id bigint, type string")
    found = {(r.rule, r.id) for r in rules.declared_violations(kinds, "payment_methods").collect()}
    assert found == {("type not permitted", 2), ("type missing", 3)}
    assert rules.declared_violations(kinds.limit(0), "payment_methods").count() == 0


def test_absent_columns_are_named_once(spark):
    empty = spark.createDataFrame([], "id bigint, email string")
    found = [tuple(r) for r in rules.absent_columns(spark, [("login_attempts", empty), ("holidays", empty)]).collect()]
    # Columns with a default are filled, and need not be there.
    assert found == [
        ("login_attempts", "ip_address absent", None), ("holidays", "name absent", None), ("holidays", "date absent", None),
    ]
    assert rules.absent_columns(spark, []).count() == 0


def test_repeated_keys_agree_with_single_reports(spark):
    rows = [(k, f"IT-{k % 7}" if k % 5 else None, f"b{k}") for k in range(1, 60)] + [(59, "it-3 ", "B1 ")]
    items = spark.createDataFrame(rows, "id bigint, code string, barcode string")
    named = spark.createDataFrame([(1, "José"), (2, "jose "), (3, "Ana"), (4, None)], "id bigint, name string")
    tables = [("inventory_items", items), ("roles", named), ("login_attempts", named.limit(0).select("id"))]
    found = rules.repeated_keys(tables)
    expected = rules.stack([rules.duplicate_keys(df, t) for t, df in tables])
    order = lambda df: sorted((r.table_name, r.rule, r.copies, r.first_id) for r in df.collect())
    assert order(found) == order(expected)
    assert ("roles", "name", 2, 1) in order(found)
    assert {r.key_value for r in found.collect() if r.rule == "code"} == {f"it-{k}" for k in range(7)}


def test_lost_references_of_many_tables(spark):
    users = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id bigint")
    visits = spark.createDataFrame(
        [(k, 7 if k % 3 == 0 else 1, 2 if k % 2 else None, "x") for k in range(300)],
        "id int, patient_id int, dentist_id bigint, value string",
    )
    audits = spark.createDataFrame([(1, None), (2, 9), (3, 2)], "id bigint, user_id bigint")
    loose = spark.createDataFrame([(1, 5)], "id bigint, item_id bigint")  # its parent is not given
    children = [("appointments", visits), ("audit_logs", audits), ("inventory_batches", loose)]
    found = sorted(tuple(r) for r in rules.lost_references(children, {"users": users}).collect())
    assert found == sorted(
        [("appointments", "patient_id -> users", k, 7) for k in range(0, 300, 3)] + [("audit_logs", "user_id -> users", 2, 9)]
    )
    # The report for one child, read by itself, is the same.
    single = rules.stack([rules.orphans(df, t, {"users": users}) for t, df in children[:2]])
    assert sorted(tuple(r) for r in single.collect()) == found
    empty = rules.lost_references([("audit_logs", audits)], {"users": users.limit(0)})
    assert sorted(r.id for r in empty.collect()) == [2, 3]
