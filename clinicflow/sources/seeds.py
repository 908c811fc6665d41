"""Seed rows of the small dimension tables. All rows in this file are fixed values.

The clinic's own identity settings (name, address, phone, e-mail) are not stored here; they
are arguments of `system_configurations`.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clinicflow.sources.schemas import TABLES
from clinicflow.sources.tables import fill_defaults, generated

# name, display_name, description, color, can_modify, can_cancel, display_order
APPOINTMENT_STATUSES = [
    ("scheduled", "Programada", "Cita programada y confirmada", "#3B82F6", True, True, 1),
    ("confirmed", "Confirmada", "Cita confirmada por el paciente", "#10B981", True, True, 2),
    ("arrived", "Paciente llegó", "Paciente llegó a la clínica", "#F59E0B", False, True, 3),
    ("in_progress", "En curso", "Consulta en progreso", "#8B5CF6", False, False, 4),
    ("completed", "Completada", "Consulta finalizada exitosamente", "#059669", False, False, 5),
    ("cancelled", "Cancelada", "Cita cancelada", "#DC2626", False, False, 6),
    ("no_show", "No asistió", "Paciente no se presentó", "#6B7280", False, False, 7),
    ("rescheduled", "Reprogramada", "Cita reprogramada", "#F97316", True, True, 8),
]

# Texts of the clinical module where they differ: name -> display_name, description, color
CLINICAL_STATUS_TEXTS = {
    "arrived": ("Paciente llegó", "Paciente registrado en recepción", "#F59E0B"),
    "in_progress": ("En consulta", "Consulta en progreso", "#8B5CF6"),
    "cancelled": ("Cancelada", "Cita cancelada", "#EF4444"),
}

# name, date, is_recurring, is_national, description
HOLIDAYS = [
    ("Año Nuevo", "2024-01-01", True, True, "Año Nuevo"),
    ("Jueves Santo", "2024-03-28", False, True, "Jueves Santo 2024"),
    ("Viernes Santo", "2024-03-29", False, True, "Viernes Santo 2024"),
    ("Día del Trabajo", "2024-05-01", True, True, "Día Internacional del Trabajo"),
    ("Día de la Independencia", "2024-07-28", True, True,
     "Proclamación de la Independencia del Perú"),
    ("Día de la Independencia", "2024-07-29", True, True, "Día de la Gran Parada Militar"),
    ("Santa Rosa de Lima", "2024-08-30", True, True, "Santa Rosa de Lima"),
    ("Combate de Angamos", "2024-10-08", True, True, "Combate de Angamos"),
    ("Todos los Santos", "2024-11-01", True, True, "Día de Todos los Santos"),
    ("Inmaculada Concepción", "2024-12-08", True, True, "Inmaculada Concepción"),
    ("Navidad", "2024-12-25", True, True, "Navidad"),
    ("Año Nuevo", "2025-01-01", True, True, "Año Nuevo"),
    ("Jueves Santo", "2025-04-17", False, True, "Jueves Santo 2025"),
    ("Viernes Santo", "2025-04-18", False, True, "Viernes Santo 2025"),
    ("Día del Trabajo", "2025-05-01", True, True, "Día Internacional del Trabajo"),
    ("Día de la Independencia", "2025-07-28", True, True,
     "Proclamación de la Independencia del Perú"),
    ("Día de la Independencia", "2025-07-29", True, True, "Día de la Gran Parada Militar"),
]

# code, name, type, requires_reference, display_order
PAYMENT_METHODS = [
    ("CASH", "Efectivo", "cash", False, 1),
    ("CARD_VISA", "Tarjeta Visa", "card", True, 2),
    ("CARD_MC", "Tarjeta Mastercard", "card", True, 3),
    ("TRANSFER", "Transferencia Bancaria", "transfer", True, 4),
    ("YAPE", "Yape", "digital", True, 5),
    ("PLIN", "Plin", "digital", True, 6),
    ("DEPOSIT", "Depósito Bancario", "transfer", True, 7),
]

# name, display_name, description, is_electronic, requires_reference, display_order
PAYMENT_METHOD_LABELS = [
    ("efectivo", "Efectivo", "Pago en efectivo", False, False, 1),
    ("tarjeta_debito", "Tarjeta de Débito", "Pago con tarjeta de débito", True, True, 2),
    ("tarjeta_credito", "Tarjeta de Crédito", "Pago con tarjeta de crédito", True, True, 3),
    ("transferencia", "Transferencia Bancaria", "Transferencia electrónica", True, True, 4),
    ("yape", "Yape", "Pago mediante Yape", True, True, 5),
    ("plin", "Plin", "Pago mediante Plin", True, True, 6),
    ("deposito", "Depósito Bancario", "Depósito en cuenta bancaria", False, True, 7),
    ("cheque", "Cheque", "Pago con cheque", False, True, 8),
]

# code, name, category, estimated_duration, base_price, requires_lab
TREATMENT_TYPES = [
    ("CONS-001", "Consulta General", "Consulta", 30, "50.00", False),
    ("LIMI-001", "Limpieza Dental", "Prevención", 45, "80.00", False),
    ("OBTU-001", "Obturación Simple", "Restauración", 60, "120.00", False),
    ("OBTU-002", "Obturación Compuesta", "Restauración", 90, "180.00", False),
    ("EXTR-001", "Extracción Simple", "Cirugía", 30, "100.00", False),
    ("EXTR-002", "Extracción Compleja", "Cirugía", 60, "200.00", False),
    ("ENDO-001", "Endodoncia", "Endodoncia", 120, "350.00", False),
    ("CORO-001", "Corona Dental", "Prótesis", 90, "500.00", True),
    ("PONT-001", "Puente Dental", "Prótesis", 120, "800.00", True),
    ("IMPL-001", "Implante Dental", "Implantología", 180, "1200.00", True),
    ("BLAN-001", "Blanqueamiento", "Estética", 60, "300.00", False),
    ("ORTO-001", "Brackets Metálicos", "Ortodoncia", 60, "1500.00", False),
    ("ORTO-002", "Brackets Estéticos", "Ortodoncia", 60, "2000.00", False),
    ("PERI-001", "Tratamiento Periodontal", "Periodoncia", 90, "250.00", False),
    ("RADI-001", "Radiografía Periapical", "Diagnóstico", 15, "25.00", False),
    ("RADI-002", "Radiografía Panorámica", "Diagnóstico", 20, "60.00", False),
]

# name, display_name, description
ROLES = [
    ("admin", "Administrador", "Acceso completo al sistema"),
    ("dentist", "Odontólogo", "Profesional odontólogo con acceso a gestión médica"),
    ("receptionist", "Recepcionista", "Gestión de citas y atención al cliente"),
    ("assistant", "Asistente Dental", "Apoyo en procedimientos y gestión básica"),
    ("patient", "Paciente", "Acceso limitado para consulta de información personal"),
]

# module, action, display_name, description; the permission's name is module.action
PERMISSIONS = [
    ("users", "create", "Crear Usuarios", "Crear nuevos usuarios en el sistema"),
    ("users", "read", "Ver Usuarios", "Ver información de usuarios"),
    ("users", "update", "Editar Usuarios", "Modificar información de usuarios"),
    ("users", "delete", "Eliminar Usuarios", "Eliminar usuarios del sistema"),
    ("appointments", "create", "Crear Citas", "Programar nuevas citas"),
    ("appointments", "read", "Ver Citas", "Consultar citas programadas"),
    ("appointments", "update", "Editar Citas", "Modificar citas existentes"),
    ("appointments", "delete", "Cancelar Citas", "Cancelar citas programadas"),
    ("billing", "create", "Crear Facturas", "Generar facturas y boletas"),
    ("billing", "read", "Ver Facturas", "Consultar documentos de facturación"),
    ("billing", "update", "Editar Facturas", "Modificar documentos antes del envío"),
    ("billing", "delete", "Anular Facturas", "Anular documentos de facturación"),
    ("inventory", "create", "Crear Inventario", "Registrar nuevos artículos"),
    ("inventory", "read", "Ver Inventario", "Consultar stock y artículos"),
    ("inventory", "update", "Editar Inventario", "Modificar información de artículos"),
    ("inventory", "delete", "Eliminar Inventario", "Eliminar artículos del inventario"),
    ("reports", "read", "Ver Reportes", "Acceso a reportes del sistema"),
    ("reports", "export", "Exportar Reportes", "Exportar reportes en diferentes formatos"),
    ("admin", "settings", "Configuración", "Acceso a configuración del sistema"),
    ("admin", "audit", "Auditoría", "Acceso a logs de auditoría"),
]

# category, key_name, value, description, data_type, is_public
SETTINGS = [
    ("appointments", "default_duration", "60", "Duración por defecto de citas (minutos)",
     "integer", False),
    ("appointments", "max_daily_appointments", "20", "Máximo de citas por día",
     "integer", False),
    ("appointments", "allow_weekend_appointments", "false",
     "Permitir citas en fines de semana", "boolean", False),
    ("appointments", "advance_booking_days", "30",
     "Días máximos para agendar con anticipación", "integer", False),
    ("notifications", "email_enabled", "true", "Habilitar notificaciones por email",
     "boolean", False),
    ("notifications", "sms_enabled", "false", "Habilitar notificaciones por SMS",
     "boolean", False),
    ("notifications", "reminder_hours_before", "24",
     "Horas antes para recordatorios por defecto", "integer", False),
    ("security", "max_login_attempts", "5", "Máximo intentos de login antes de bloqueo",
     "integer", False),
    ("security", "lockout_duration_minutes", "30", "Duración del bloqueo en minutos",
     "integer", False),
    ("security", "password_expiry_days", "90", "Días para expiración de contraseña",
     "integer", False),
    ("security", "jwt_expiry_hours", "8", "Horas de validez del JWT", "integer", False),
    ("billing", "tax_rate", "18.00", "Tasa de IGV (%)", "decimal", False),
    ("billing", "currency", "PEN", "Moneda por defecto", "string", True),
    ("billing", "invoice_prefix", "F001", "Prefijo de facturas", "string", False),
    ("system", "timezone", "America/Lima", "Zona horaria del sistema", "string", False),
    ("system", "date_format", "d/m/Y", "Formato de fecha", "string", True),
    ("system", "maintenance_mode", "false", "Modo mantenimiento activo", "boolean", False),
]

# key_name, description of the identity settings the caller supplies
IDENTITY_SETTINGS = [
    ("clinic_name", "Nombre de la clínica"),
    ("clinic_address", "Dirección de la clínica"),
    ("clinic_phone", "Teléfono principal"),
    ("clinic_email", "Email de contacto"),
]


def _table(spark: SparkSession, table: str, names: str, rows: list[tuple]) -> DataFrame:
    """Number the rows from 1, give them their declared types and fill the defaults."""
    columns = ["id", *names.split()]
    types = [T.StructField(c, TABLES[table][c].type) for c in columns]
    numbered = [(n, *row) for n, row in enumerate(rows, start=1)]
    df = spark.createDataFrame(numbered, T.StructType(types))
    return generated(table, fill_defaults(table, df, datetime(2024, 1, 1)))


def appointment_statuses(spark: SparkSession, clinical_texts: bool = False) -> DataFrame:
    rows = APPOINTMENT_STATUSES
    if clinical_texts:
        rows = [(r[0], *CLINICAL_STATUS_TEXTS.get(r[0], r[1:4]), *r[4:]) for r in rows]
    names = "name display_name description color can_modify can_cancel display_order"
    return _table(spark, "appointment_statuses", names, rows)


def holidays(spark: SparkSession) -> DataFrame:
    rows = [(name, date.fromisoformat(day), *rest) for name, day, *rest in HOLIDAYS]
    return _table(spark, "holidays", "name date is_recurring is_national description", rows)


def payment_methods(spark: SparkSession) -> DataFrame:
    names = "code name type requires_reference display_order"
    return _table(spark, "payment_methods", names, PAYMENT_METHODS)


def payment_method_labels(spark: SparkSession) -> DataFrame:
    """The user module's own list of payment methods, which has other columns."""
    rows = [(n, *row) for n, row in enumerate(PAYMENT_METHOD_LABELS, start=1)]
    return spark.createDataFrame(
        rows,
        "id bigint, name string, display_name string, description string, "
        "is_electronic boolean, requires_reference boolean, display_order int",
    )


def treatment_types(spark: SparkSession) -> DataFrame:
    rows = [(*r[:4], Decimal(r[4]), r[5]) for r in TREATMENT_TYPES]
    names = "code name category estimated_duration base_price requires_lab"
    return _table(spark, "treatment_types", names, rows)


def roles(spark: SparkSession) -> DataFrame:
    return _table(spark, "roles", "name display_name description", ROLES)


def permissions(spark: SparkSession) -> DataFrame:
    rows = [(f"{m}.{a}", display, text, m, a) for m, a, display, text in PERMISSIONS]
    return _table(spark, "permissions", "name display_name description module action", rows)


def system_configurations(spark: SparkSession, **identity: str) -> DataFrame:
    """The 21 settings; `identity` gives the values of the four clinic identity settings."""
    rows = [
        ("clinic", key, identity.get(key), text, "string", True)
        for key, text in IDENTITY_SETTINGS
    ]
    names = "category key_name value description data_type is_public"
    return _table(spark, "system_configurations", names, rows + SETTINGS)
