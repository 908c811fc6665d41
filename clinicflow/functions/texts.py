"""Result labels and messages that users of the system read and match on."""

# Reasons for refusing an appointment
HOLIDAY = "No se pueden programar citas en días feriados"
OUTSIDE_HOURS = "La cita está fuera del horario de trabajo del dentista"
SLOT_TAKEN = "Ya existe una cita programada en ese horario para el dentista"
ACTIVE_SLOT_TAKEN = "El dentista ya tiene una cita programada en ese horario"

# Reason for refusing an invoice number
NOT_SEQUENTIAL = "El correlativo debe ser secuencial"

# Reasons for refusing a stock movement row
INACTIVE_ITEM = "No se pueden realizar movimientos en artículos inactivos"
STALE_STOCK = "Stock anterior no coincide. Actualice y reintente"
NEGATIVE_STOCK = "Stock resultante no puede ser negativo"
WRONG_STOCK = "Error en cálculo de stock resultante"

# Outcomes of a movement request
UNKNOWN_ITEM = "Artículo no encontrado o inactivo"
NOT_ENOUGH = "Stock insuficiente para el movimiento"
MOVEMENT_FAILED = "Error al procesar movimiento de inventario"
MOVEMENT_DONE = "Movimiento registrado exitosamente"

# Stock labels
NO_STOCK = "SIN STOCK"
CRITICAL = "CRÍTICO"
LOW = "BAJO"
EXCESS = "EXCESO"
NORMAL = "NORMAL"

# Weekday names, Monday first
DAY_NAMES = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

# This library's own reason when a month or a series has used all its numbers
CODES_EXHAUSTED = "no number left in this range"
# when a supplied code is in use already
CODE_TAKEN = "code is in use"
# and when a movement row lacks a stock or its quantity
INCOMPLETE_MOVEMENT = "stock or quantity is missing"
