"""Reading, defaults, seeds, snapshots, deletes and user audit."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinicflow.operators import audit, snapshots
from clinicflow.sources import seeds, tables
from clinicflow.sources.schemas import CASCADE, RESTRICT, SET_NULL, TABLES, schema

D = Decimal
NOW = datetime(2024, 1, 15, 12)


def test_load_adds_generated_columns(spark, tmp_path):
    path = str(tmp_path / "movements")
    fields = schema("inventory_movements")
    row = dict(id=1, item_id=1, quantity=D("-2.50"), unit_cost=D("3.33"))
    other = dict(id=2, item_id=1, quantity=D("4.00"))
    spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in (row, other)], fields).write.parquet(path)
    got = {r.id: r.total_cost for r in tables.load_table(spark, path, "inventory_movements").collect()}
    assert got == {1: D("8.33"), 2: D("0.00")}


@pytest.mark.parametrize("table", sorted(TABLES))
def test_every_table_round_trips(spark, tmp_path, table):
    path = str(tmp_path / table)
    spark.createDataFrame([], schema(table)).write.parquet(path)
    loaded = tables.load_table(spark, path, table)
    assert loaded.columns[: len(TABLES[table])] == list(TABLES[table])
    assert loaded.isEmpty()


def test_defaults_fill_only_missing_columns(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, duration_minutes int")
    filled = tables.fill_defaults("appointments", df, NOW).first()
    assert (filled.duration_minutes, filled.priority, filled.version) == (None, "normal", 1)
    assert tables.fill_defaults("working_hours", df, NOW).first().valid_from == NOW.date()
    assert tables.fill_defaults("notifications", df, NOW).first().created_at == NOW
    assert tables.fill_defaults("invoice_details", df, NOW).first().tax_percentage == D("18.00")


def test_append_and_snapshots(spark, tmp_path):
    df = spark.range(3)
    tables.append(df, str(tmp_path / "t"))
    tables.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    first = tables.write_snapshot(df, str(tmp_path / "s"), "1")
    assert spark.read.parquet(first).count() == 3
    with pytest.raises(Exception, match="already exists"):
        tables.write_snapshot(df, str(tmp_path / "s"), "1")


def test_seed_counts_and_values(spark):
    counts = {
        f: getattr(seeds, f)(spark).count()
        for f in ("appointment_statuses", "holidays", "payment_methods", "payment_method_labels",
                  "treatment_types", "roles", "permissions", "system_configurations")
    }
    assert list(counts.values()) == [8, 17, 7, 8, 16, 5, 20, 21]
    assert seeds.treatment_types(spark).agg(F.sum("base_price")).first()[0] == D("7715.00")
    texts = {r.name: r.display_name for r in seeds.appointment_statuses(spark, clinical_texts=True).collect()}
    assert texts["in_progress"] == "En consulta" and texts["scheduled"] == "Programada"
    settings = seeds.system_configurations(spark, clinic_name="Mine").filter("key_name = 'clinic_name'")
    assert settings.first().value == "Mine"
    assert seeds.holidays(spark).agg(F.max("year")).first()[0] == 2025


def test_upsert_update_delete(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, name string, n int")
    new = spark.createDataFrame([(2, "x", 9), (3, "y", 8)], "id bigint, name string, n int")
    merged = snapshots.upsert(target, new, ["id"], {"n": F.col("old.n") + F.col("new.n")})
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", 1), (2, "b", 11), (3, "y", 8)]
    unknown = F.when(F.col("id") == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    updated = snapshots.update_where(target, unknown, {"n": F.lit(0)})
    assert sorted(r.n for r in updated.collect()) == [0, 1]
    assert [r.id for r in snapshots.delete_where(target, unknown).collect()] == [1]


def test_delete_actions(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id bigint, parent bigint")
    gone = spark.createDataFrame([(10,), (30,)], "id bigint")
    after, blocked = snapshots.on_delete(child, "parent", gone, CASCADE)
    assert sorted(r.id for r in after.collect()) == [2, 3] and blocked.isEmpty()
    after, _ = snapshots.on_delete(child, "parent", gone, SET_NULL)
    assert sorted((r.id, r.parent) for r in after.collect()) == [(1, None), (2, 20), (3, None)]
    after, blocked = snapshots.on_delete(child, "parent", gone, RESTRICT)
    assert after.count() == 3 and [r.id for r in blocked.collect()] == [10]
    with pytest.raises(ValueError, match="unknown action"):
        snapshots.on_delete(child, "parent", gone, "ignore")


def users(spark, *rows):
    fields = schema("users")
    base = dict(document_type="DNI", document_number="12345678", email="a@x.pe", first_name="A", last_name="B",
                role_id=1, is_active=True, password="p", jwt_version=3, session_id="s", failed_login_attempts=4,
                last_failed_login=NOW, locked_until=NOW)
    return spark.createDataFrame([tuple({**base, **r}.get(f.name) for f in fields) for r in rows], fields)


def test_audit_rows(spark):
    old = users(spark, dict(id=1), dict(id=2), dict(id=3, email=None), dict(id=4))
    new = users(spark, dict(id=1, email="A@x.pe "), dict(id=2, role_id=2), dict(id=3), dict(id=4, is_active=False))
    critical = audit.critical_changes(old, new, NOW).orderBy("user_id").collect()
    assert [r.user_id for r in critical] == [2, 4]
    assert json.loads(critical[1].new_values) == {"email": "a@x.pe", "is_active": 0, "role_id": 1}
    assert (critical[0].risk_level, critical[0].action, critical[0].created_at) == ("high", "update", NOW)
    updated = audit.updated_users(old, new, NOW).filter("user_id = 3").first()
    assert json.loads(updated.old_values)["email"] is None and len(json.loads(updated.new_values)) == 7
    created = audit.created_users(new, NOW).filter("user_id = 2").first()
    assert list(json.loads(created.new_values)) == list(audit.CREATED_KEYS) and created.action == "CREATE"


def test_logins_and_passwords(spark):
    early = datetime(2024, 1, 1)
    old = users(spark, dict(id=1), dict(id=2, last_login=early), dict(id=3, last_login=early), dict(id=4, last_login=early))
    new = users(spark, dict(id=1, last_login=NOW), dict(id=2, last_login=NOW), dict(id=3, last_login=early), dict(id=4))
    got = {r.id: (r.failed_login_attempts, r.locked_until) for r in audit.reset_after_login(old, new).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (4, NOW), 4: (4, NOW)}
    changed = users(spark, dict(id=1, password="q"), dict(id=2))
    got = {r.id: (r.jwt_version, r.session_id, r.password_changed_at) for r in audit.rotate_after_password(old, changed, NOW).collect()}
    assert got == {1: (4, None, NOW), 2: (3, "s", None)}



def test_deleting_follows_the_schema(spark):
    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)

    tables = {
        "users": rows("id bigint", (1,), (2,), (3,), (4,)),
        "appointments": rows("id bigint, patient_id bigint, modified_by bigint", (10, 1, 2), (11, 4, 4)),
        "appointment_reminders": rows("id bigint, appointment_id bigint", (20, 10)),
        "working_hours": rows("id bigint, dentist_id bigint", (30, 2), (31, 3)),
        "inventory_alerts": rows("id bigint, item_id bigint, resolved_by bigint", (40, 7, 2)),
        "invoices": rows("id bigint, patient_id bigint", (50, 4)),
        "invoice_details": rows("id bigint, invoice_id bigint, service_id bigint", (60, 50, 9)),
        "services": rows("id bigint", (9,)),
    }
    after, blocked = snapshots.delete_rows(tables, "users", rows("id bigint", (1,), (2,), (2,)))
    left = {name: sorted(tuple(r) for r in df.collect()) for name, df in after.items()}
    assert [r.id for r in blocked.collect()] == [1]
    assert left["users"] == [(1,), (3,), (4,)]
    assert sorted(map(str, left["appointments"])) == ["(10, 1, None)", "(11, 4, 4)"]
    assert left["working_hours"] == [(31, 3)] and left["inventory_alerts"] == [(40, 7, None)]
    # Cascades go on, and stop at what a grandchild restricts.
    after, blocked = snapshots.delete_rows(tables, "appointments", rows("id bigint", (10,)))
    assert after["appointment_reminders"].count() == 0 and blocked.count() == 0
    after, _ = snapshots.delete_rows(tables, "invoices", rows("id bigint", (50,)))
    assert after["invoice_details"].count() == 0
    after, blocked = snapshots.delete_rows(tables, "services", rows("id bigint", (9,)))
    assert [r.id for r in blocked.collect()] == [9] and after["services"].count() == 1
