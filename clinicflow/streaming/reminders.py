"""Reminders planned as appointments arrive; no state is needed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from clinicflow.operators.scheduling import reminder_plan


def plan_reminders(appointments: DataFrame, as_of: date) -> DataFrame:
    """Reminder rows for a stream of new appointments."""
    if not appointments.isStreaming:
        raise ValueError("plan_reminders takes a stream; use reminder_plan for tables")
    return reminder_plan(appointments, as_of)
