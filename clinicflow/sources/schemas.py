"""The clinic's tables: one schema per table, declared once.

A `Field` holds the Spark type together with what a Spark schema cannot say: required,
default, longest text, value range and permitted values. The readers, the default
filler and the data-quality rules all work from these declarations.

Table and column names, widths, permitted values and defaults are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TODAY = "today"
NOW = "now"

TINY, SMALL, INT = 2**8 - 1, 2**16 - 1, 2**32 - 1


@dataclass(frozen=True)
class Field:
    type: T.DataType
    need: bool = False
    default: object = None
    longest: int | None = None
    low: int | None = None
    high: int | None = None
    choices: tuple[str, ...] = ()
    json: bool = False


def key() -> Field:
    return Field(T.LongType(), need=True, low=0)


def ref(need: bool = False) -> Field:
    return Field(T.LongType(), need=need, low=0)


def text(longest: int, need: bool = False, default: str | None = None) -> Field:
    return Field(T.StringType(), need=need, default=default, longest=longest)


def memo(need: bool = False) -> Field:
    return Field(T.StringType(), need=need)


def doc(need: bool = False) -> Field:
    return Field(T.StringType(), need=need, json=True)


def whole(high: int, need: bool = False, default: int | None = None, low: int = 0) -> Field:
    kind = T.LongType() if high > 2**31 - 1 else T.IntegerType()
    return Field(kind, need=need, default=default, low=low, high=high)


def amount(
    precision: int, need: bool = False, default: str | None = None, signed: bool = False
) -> Field:
    kind = T.DecimalType(precision, 2)
    return Field(kind, need=need, default=default, low=None if signed else 0)


def flag(default: bool) -> Field:
    return Field(T.BooleanType(), need=True, default=default)


def day(need: bool = False, default: str | None = None) -> Field:
    return Field(T.DateType(), need=need, default=default)


def clock(need: bool = False) -> Field:
    return Field(T.IntegerType(), need=need)


def stamp(need: bool = False, default: str | None = None) -> Field:
    return Field(T.TimestampType(), need=need, default=default)


def choice(*choices: str, need: bool = True, default: str | None = None) -> Field:
    return Field(T.StringType(), need=need, default=default, choices=choices)


def _written() -> dict[str, Field]:
    return {"created_at": stamp(), "updated_at": stamp()}


def _logged() -> dict[str, Field]:
    return {"created_at": stamp(default=NOW), "updated_at": stamp(default=NOW)}


SCHEDULE: dict[str, dict[str, Field]] = {
    "appointment_statuses": dict(
        id=key(), name=text(50, True), display_name=text(100, True), description=memo(),
        color=text(7, True, "#6B7280"), can_modify=flag(True), can_cancel=flag(True),
        is_active=flag(True), display_order=whole(TINY, True, 0), **_written(),
    ),
    "appointments": dict(
        id=key(), appointment_code=text(16, True), patient_id=ref(True), dentist_id=ref(True),
        appointment_date=day(True), appointment_time=clock(True),
        duration_minutes=whole(SMALL, True, 30), reason=memo(), notes=memo(),
        status_id=ref(True),
        priority=choice("baja", "normal", "alta", "urgente", default="normal"),
        created_by=ref(True), modified_by=ref(), confirmation_sent=flag(False),
        reminder_sent=flag(False), arrived_at=stamp(), started_at=stamp(), finished_at=stamp(),
        cancellation_reason=memo(), cancelled_by=ref(), cancelled_at=stamp(),
        version=whole(SMALL, True, 1), **_written(),
    ),
    "working_hours": dict(
        id=key(), dentist_id=ref(True), day_of_week=whole(127, True, low=-128),
        start_time=clock(True), end_time=clock(True), break_start_time=clock(),
        break_end_time=clock(), is_active=flag(True), valid_from=day(True, TODAY),
        valid_until=day(), **_written(),
    ),
    "holidays": dict(
        id=key(), name=text(100, True), date=day(True), is_recurring=flag(False),
        description=memo(), is_national=flag(False), is_active=flag(True), **_written(),
    ),
    "appointment_unavailabilities": dict(
        id=key(), dentist_id=ref(True), start_date=day(True), end_date=day(True),
        start_time=clock(), end_time=clock(), reason=text(255, True),
        type=choice("personal", "medical", "vacation", "training", "emergency", default="personal"),
        is_active=flag(True), created_by=ref(True), approved_by=ref(), approved_at=stamp(),
        **_written(),
    ),
    "appointment_reminders": dict(
        id=key(), appointment_id=ref(True),
        reminder_type=choice("email", "sms", "whatsapp", "call"), send_at=stamp(True),
        hours_before=whole(SMALL, True), is_sent=flag(False), sent_at=stamp(),
        delivery_status=choice(
            "pending", "sent", "delivered", "failed", "bounced", default="pending"
        ),
        error_message=memo(), retry_count=whole(TINY, True, 0), **_written(),
    ),
}

BILLING: dict[str, dict[str, Field]] = {
    "payment_methods": dict(
        id=key(), code=text(20, True), name=text(50, True),
        type=choice("cash", "card", "transfer", "digital"), requires_reference=flag(False),
        is_active=flag(True), display_order=whole(TINY, True, 0), **_written(),
    ),
    "services": dict(
        id=key(), code=text(20, True), name=text(100, True), description=memo(),
        category=text(50, True), price=amount(8, True, "0.00"),
        duration_minutes=whole(SMALL, True, 30), requires_lab=flag(False),
        requires_materials=flag(False), igv_exempt=flag(False), is_active=flag(True),
        **_written(),
    ),
    "invoices": dict(
        id=key(), invoice_number=text(20, True), series=text(4, True),
        correlative=text(8, True), invoice_type=choice("boleta", "factura"),
        patient_id=ref(True), appointment_id=ref(), issue_date=day(True), due_date=day(),
        subtotal=amount(10, True, "0.00"), discount_amount=amount(10, True, "0.00"),
        tax_amount=amount(10, True, "0.00"), total_amount=amount(10, True, "0.00"),
        payment_status=choice(
            "pending", "partial", "paid", "overdue", "cancelled", default="pending"
        ),
        payment_method_id=ref(), payment_reference=text(100), payment_date=day(),
        sunat_status=choice("pending", "accepted", "rejected", "sent", default="pending"),
        sunat_response=memo(), sunat_sent_at=stamp(), sunat_hash=text(255),
        xml_filename=text(255), pdf_filename=text(255), created_by=ref(True),
        approved_by=ref(), approved_at=stamp(), cancelled_by=ref(), cancelled_at=stamp(),
        cancellation_reason=memo(), **_written(),
    ),
    "invoice_details": dict(
        id=key(), invoice_id=ref(True), service_id=ref(True), quantity=whole(SMALL, True, 1),
        unit_price=amount(8, True), discount_percentage=amount(5, True, "0.00"),
        discount_amount=amount(8, True, "0.00"), subtotal=amount(10, True),
        tax_percentage=amount(5, True, "18.00"), tax_amount=amount(8, True, "0.00"),
        total_price=amount(10, True), **_written(),
    ),
    "invoice_payments": dict(
        id=key(), invoice_id=ref(True), payment_method_id=ref(True), amount=amount(10, True),
        payment_date=day(True), reference=text(100), notes=memo(), processed_by=ref(True),
        **_written(),
    ),
}

INVENTORY: dict[str, dict[str, Field]] = {
    "inventory_categories": dict(
        id=key(), name=text(100, True), description=memo(), parent_id=ref(),
        category_code=text(20, True), level=whole(TINY, True, 1),
        sort_order=whole(INT, True, 0), is_active=flag(True), **_written(),
    ),
    "inventory_items": dict(
        id=key(), code=text(50, True), barcode=text(100), name=text(150, True),
        description=memo(), category_id=ref(True),
        unit_of_measure=choice(
            "piece", "box", "bottle", "tube", "vial", "kit", "pack", "ml", "gr", "unit",
            default="piece",
        ),
        minimum_stock=amount(10, True, "0"), maximum_stock=amount(10),
        current_stock=amount(10, True, "0"), reserved_stock=amount(10, True, "0"),
        unit_cost=amount(10, True, "0"), last_purchase_cost=amount(10),
        primary_supplier=text(100), supplier_code=text(50), has_expiration=flag(False),
        expiration_date=day(), expiration_alert_days=whole(INT, default=30),
        location=text(100), storage_conditions=memo(), is_controlled=flag(False),
        requires_prescription=flag(False), is_active=flag(True), created_by=ref(),
        updated_by=ref(), **_written(),
    ),
    "inventory_movements": dict(
        id=key(), item_id=ref(True),
        movement_type=choice(
            "purchase", "consumption", "adjustment", "transfer", "return", "waste", "expired"
        ),
        movement_category=choice("in", "out", "adjustment"),
        quantity=amount(10, True, signed=True), unit_cost=amount(10),
        previous_stock=amount(10, True), new_stock=amount(10, True), reason=text(255, True),
        reference_document=text(100), batch_number=text(50), expiration_date=day(),
        appointment_id=ref(), patient_id=ref(), treatment_id=ref(), supplier_id=ref(),
        from_location=text(100), to_location=text(100), user_id=ref(True), approved_by=ref(),
        approval_required=flag(False), is_approved=flag(True), approval_date=stamp(),
        notes=memo(), metadata=doc(), **_written(),
    ),
    "inventory_batches": dict(
        id=key(), item_id=ref(True), batch_number=text(50, True), expiration_date=day(True),
        purchase_date=day(True), quantity_received=amount(10, True),
        quantity_current=amount(10, True), unit_cost=amount(10, True), supplier=text(100),
        is_active=flag(True), **_written(),
    ),
    "inventory_alerts": dict(
        id=key(), item_id=ref(True),
        alert_type=choice(
            "low_stock", "expiring_soon", "expired", "overstock", "inactive_item",
            "batch_depleted",
        ),
        alert_level=choice("info", "warning", "critical", default="warning"),
        title=text(150, True), message=memo(True),
        threshold_value=amount(10, signed=True), current_value=amount(10, signed=True),
        expiration_date=day(), batch_number=text(50), is_read=flag(False),
        is_resolved=flag(False), resolved_by=ref(), resolved_at=stamp(),
        auto_resolve_date=stamp(), **_written(),
    ),
}

CARE: dict[str, dict[str, Field]] = {
    "medical_records": dict(
        id=key(), record_number=text(15, True), patient_id=ref(True), dentist_id=ref(True),
        appointment_id=ref(), visit_date=day(True), chief_complaint=memo(),
        clinical_examination=memo(), diagnosis=memo(), treatment_plan=memo(),
        treatment_performed=memo(), observations=memo(), next_visit_date=day(),
        is_validated=flag(False), validated_at=stamp(), version=whole(TINY, True, 1),
        previous_version_id=ref(), **_written(),
    ),
    "treatment_types": dict(
        id=key(), code=text(20, True), name=text(100, True), description=memo(),
        category=text(50, True), estimated_duration=whole(SMALL, True, 30),
        base_price=amount(8, True, "0.00"), requires_lab=flag(False), is_active=flag(True),
        **_written(),
    ),
    "treatment_records": dict(
        id=key(), medical_record_id=ref(True), treatment_type_id=ref(True),
        tooth_number=text(5), treatment_details=memo(), materials_used=memo(),
        final_price=amount(8, True, "0.00"),
        status=choice("planned", "in_progress", "completed", "cancelled", default="planned"),
        performed_at=stamp(), **_written(),
    ),
    "medical_record_files": dict(
        id=key(), medical_record_id=ref(True), file_name=text(255, True),
        file_path=text(500, True), file_type=text(50, True), file_size=whole(INT, True),
        file_category=choice("xray", "photo", "document", "scan", "other", default="other"),
        description=memo(), uploaded_by=ref(True), **_written(),
    ),
    "prescriptions": dict(
        id=key(), prescription_number=text(15, True), patient_id=ref(True),
        dentist_id=ref(True), medical_record_id=ref(), prescription_date=day(True),
        medications=doc(True), instructions=memo(), pharmacy_name=text(100),
        is_sent=flag(False), sent_at=stamp(), dispensed_at=stamp(), **_written(),
    ),
    "laboratory_orders": dict(
        id=key(), order_number=text(15, True), patient_id=ref(True), dentist_id=ref(True),
        medical_record_id=ref(), order_date=day(True), tests_requested=doc(True),
        instructions=memo(), laboratory_name=text(100), is_sent=flag(False), sent_at=stamp(),
        results_received=flag(False), results_received_at=stamp(),
        results_file_path=text(500), **_written(),
    ),
}

SYSTEM: dict[str, dict[str, Field]] = {
    "notifications": dict(
        id=key(), user_id=ref(True), title=text(255, True), message=memo(True),
        type=choice("info", "warning", "error", "success", "reminder", default="info"),
        method=choice("email", "sms", "whatsapp", "system"), related_entity=text(50),
        related_id=ref(), is_sent=flag(False), is_read=flag(False), sent_at=stamp(),
        read_at=stamp(), retry_count=whole(TINY, True, 0), error_message=memo(), **_logged(),
    ),
    "audit_logs": dict(
        id=key(), user_id=ref(), jwt_version=whole(INT),
        action=choice(
            "INSERT", "CREATE", "UPDATE", "DELETE", "LOGIN", "LOGOUT", "ACCESS_DENIED"
        ),
        table_name=text(64, True), record_id=ref(), old_values=doc(), new_values=doc(),
        ip_address=text(45), user_agent=memo(), session_id=text(255), module=text(50),
        risk_level=choice("low", "medium", "high", "critical", need=False, default="low"),
        additional_data=doc(), created_at=stamp(default=NOW),
    ),
    "login_attempts": dict(
        id=key(), email=text(191), ip_address=text(45, True), user_agent=memo(),
        is_successful=flag(False), failure_reason=text(100), blocked_until=stamp(),
        created_at=stamp(default=NOW),
    ),
    "password_resets": dict(
        id=key(), email=text(191, True), token=text(255, True), ip_address=text(45),
        used_at=stamp(), expires_at=stamp(True), created_at=stamp(default=NOW),
    ),
    "support_tickets": dict(
        id=key(), ticket_number=text(20, True), user_id=ref(True), title=text(255, True),
        description=memo(True),
        category=choice(
            "technical", "billing", "feature_request", "bug_report", "other",
            default="technical",
        ),
        priority=choice("low", "medium", "high", "critical", default="medium"),
        status=choice(
            "open", "in_progress", "waiting_response", "resolved", "closed", default="open"
        ),
        assigned_to=ref(), resolution=memo(), estimated_hours=amount(4, signed=True),
        actual_hours=amount(4, signed=True), resolved_at=stamp(), closed_at=stamp(),
        **_logged(),
    ),
    "support_ticket_messages": dict(
        id=key(), ticket_id=ref(True), user_id=ref(True), message=memo(True),
        is_internal=flag(False), is_solution=flag(False), attachments=doc(), **_logged(),
    ),
    "system_configurations": dict(
        id=key(), category=text(50, True, "general"), key_name=text(100, True), value=memo(),
        default_value=memo(), description=memo(),
        data_type=choice(
            "string", "integer", "decimal", "boolean", "json", "encrypted", default="string"
        ),
        validation_rule=text(255), is_active=flag(True), is_public=flag(False),
        requires_restart=flag(False), last_modified_by=ref(), **_logged(),
    ),
    "system_maintenance": dict(
        id=key(), title=text(255, True), description=memo(),
        maintenance_type=choice("scheduled", "emergency", "update"), starts_at=stamp(True),
        ends_at=stamp(True), is_active=flag(False), affected_modules=doc(),
        notification_sent=flag(False), created_by=ref(True), **_logged(),
    ),
}

PEOPLE: dict[str, dict[str, Field]] = {
    "roles": dict(
        id=key(), name=text(50, True), display_name=text(100, True), description=memo(),
        is_active=flag(True), **_written(),
    ),
    "permissions": dict(
        id=key(), name=text(100, True), display_name=text(150, True), description=memo(),
        module=text(50, True), action=text(50, True), **_written(),
    ),
    "role_permissions": dict(
        id=key(), role_id=ref(True), permission_id=ref(True), **_written(),
    ),
    "users": dict(
        id=key(), document_type=choice("DNI", "CE", "PASSPORT", default="DNI"),
        document_number=text(20, True), email=text(191, True), email_verified_at=stamp(),
        password=text(255, True), password_changed_at=stamp(),
        jwt_version=whole(SMALL, True, 1), session_id=text(100), first_name=text(100, True),
        last_name=text(100, True), phone=text(20), address=memo(), birth_date=day(),
        gender=choice("M", "F", "O", need=False), role_id=ref(True), is_active=flag(True),
        last_login=stamp(), failed_login_attempts=whole(TINY, True, 0),
        last_failed_login=stamp(), locked_until=stamp(), lockout_count=whole(TINY, True, 0),
        password_reset_token=text(100), password_reset_expires=stamp(),
        remember_token=text(100), **_written(),
    ),
    "user_profiles": dict(
        id=key(), user_id=ref(True), emergency_contact_name=text(100),
        emergency_contact_phone=text(20), allergies=memo(), medical_conditions=memo(),
        insurance_provider=text(100), insurance_number=text(50), license_number=text(50),
        specializations=memo(), education=memo(), years_experience=whole(TINY),
        employee_code=text(20), hire_date=day(), department=text(50), salary=amount(8),
        **_written(),
    ),
}

TABLES: dict[str, dict[str, Field]] = {
    **SCHEDULE, **BILLING, **INVENTORY, **CARE, **SYSTEM, **PEOPLE,
}

# Unique keys besides the primary key `id`.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "appointment_statuses": (("name",),),
    "appointments": (
        ("appointment_code",), ("dentist_id", "appointment_date", "appointment_time"),
    ),
    "holidays": (("name", "is_recurring", "year"),),
    "payment_methods": (("code",), ("name",)),
    "services": (("code",),),
    "invoices": (("invoice_number",),),
    "inventory_categories": (("category_code",),),
    "inventory_items": (("code",), ("barcode",)),
    "inventory_batches": (("item_id", "batch_number"),),
    "inventory_alerts": (("item_id", "alert_type", "is_resolved"),),
    "medical_records": (("record_number",),),
    "treatment_types": (("code",),),
    "prescriptions": (("prescription_number",),),
    "laboratory_orders": (("order_number",),),
    "support_tickets": (("ticket_number",),),
    "system_configurations": (("category", "key_name"),),
    "roles": (("name",),),
    "permissions": (("name",), ("module", "action")),
    "role_permissions": (("role_id", "permission_id"),),
    "users": (("email",), ("document_type", "document_number")),
    "user_profiles": (("user_id",),),
}

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"

# Foreign keys: child table -> column -> (parent table, what deleting the parent does).
REFERENCES: dict[str, dict[str, tuple[str, str]]] = {
    "appointments": {
        "patient_id": ("users", RESTRICT), "dentist_id": ("users", RESTRICT),
        "status_id": ("appointment_statuses", RESTRICT), "created_by": ("users", RESTRICT),
        "modified_by": ("users", SET_NULL), "cancelled_by": ("users", SET_NULL),
    },
    "working_hours": {"dentist_id": ("users", CASCADE)},
    "appointment_unavailabilities": {
        "dentist_id": ("users", CASCADE), "created_by": ("users", RESTRICT),
        "approved_by": ("users", SET_NULL),
    },
    "appointment_reminders": {"appointment_id": ("appointments", CASCADE)},
    "invoices": {
        "patient_id": ("users", RESTRICT), "appointment_id": ("appointments", SET_NULL),
        "created_by": ("users", RESTRICT), "approved_by": ("users", SET_NULL),
        "cancelled_by": ("users", SET_NULL),
        "payment_method_id": ("payment_methods", SET_NULL),
    },
    "invoice_details": {
        "invoice_id": ("invoices", CASCADE), "service_id": ("services", RESTRICT),
    },
    "invoice_payments": {
        "invoice_id": ("invoices", CASCADE), "payment_method_id": ("payment_methods", RESTRICT),
        "processed_by": ("users", RESTRICT),
    },
    "inventory_categories": {"parent_id": ("inventory_categories", SET_NULL)},
    "inventory_items": {
        "category_id": ("inventory_categories", RESTRICT), "created_by": ("users", SET_NULL),
        "updated_by": ("users", SET_NULL),
    },
    "inventory_movements": {
        "item_id": ("inventory_items", RESTRICT), "user_id": ("users", RESTRICT),
        "approved_by": ("users", SET_NULL), "appointment_id": ("appointments", SET_NULL),
        "patient_id": ("users", SET_NULL),
    },
    "inventory_batches": {"item_id": ("inventory_items", RESTRICT)},
    "inventory_alerts": {
        "item_id": ("inventory_items", CASCADE), "resolved_by": ("users", SET_NULL),
    },
    "medical_records": {
        "patient_id": ("users", RESTRICT), "dentist_id": ("users", RESTRICT),
        "appointment_id": ("appointments", SET_NULL),
        "previous_version_id": ("medical_records", SET_NULL),
    },
    "treatment_records": {
        "medical_record_id": ("medical_records", CASCADE),
        "treatment_type_id": ("treatment_types", RESTRICT),
    },
    "medical_record_files": {
        "medical_record_id": ("medical_records", CASCADE), "uploaded_by": ("users", RESTRICT),
    },
    "prescriptions": {
        "patient_id": ("users", RESTRICT), "dentist_id": ("users", RESTRICT),
        "medical_record_id": ("medical_records", SET_NULL),
    },
    "laboratory_orders": {
        "patient_id": ("users", RESTRICT), "dentist_id": ("users", RESTRICT),
        "medical_record_id": ("medical_records", SET_NULL),
    },
    "notifications": {"user_id": ("users", CASCADE)},
    "audit_logs": {"user_id": ("users", SET_NULL)},
    "support_tickets": {"user_id": ("users", RESTRICT), "assigned_to": ("users", SET_NULL)},
    "support_ticket_messages": {
        "ticket_id": ("support_tickets", CASCADE), "user_id": ("users", RESTRICT),
    },
    "system_configurations": {"last_modified_by": ("users", SET_NULL)},
    "system_maintenance": {"created_by": ("users", RESTRICT)},
    "role_permissions": {
        "role_id": ("roles", CASCADE), "permission_id": ("permissions", CASCADE),
    },
    "users": {"role_id": ("roles", RESTRICT)},
    "user_profiles": {"user_id": ("users", CASCADE)},
}


def schema(table: str) -> T.StructType:
    """Spark schema of a table. Every field is nullable: files are checked, not trusted."""
    return T.StructType(
        [T.StructField(name, field.type, True) for name, field in TABLES[table].items()]
    )
