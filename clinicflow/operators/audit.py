"""User accounts: audit rows from two snapshots, and what logins and passwords reset."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicflow.functions.scalars import changed, changed_null_safe, folded, json_object

# What an audit row records, in this order.
CREATED_KEYS = (
    "document_type", "document_number", "email", "first_name", "last_name", "role_id",
)
UPDATED_KEYS = (*CREATED_KEYS, "is_active")
CRITICAL_KEYS = ("email", "is_active", "role_id")


def _values(alias: str, keys: tuple[str, ...]) -> Column:
    """JSON of one version of a user; flags are written as 1 and 0."""
    fields = {k: F.col(f"{alias}.{k}") for k in keys}
    if "is_active" in fields:
        fields["is_active"] = fields["is_active"].cast("int")
    return json_object(**fields)


def _versions(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.alias("n").join(old.alias("o"), F.col("n.id") == F.col("o.id"))


def _row(df: DataFrame, action: str, now: datetime, **values: Column) -> DataFrame:
    return df.select(
        F.col("n.id").alias("user_id"), F.lit("users").alias("table_name"),
        F.col("n.id").alias("record_id"), F.lit(action).alias("action"),
        *[value.alias(name) for name, value in values.items()],
        F.lit(now).alias("created_at"),
    )


def created_users(users: DataFrame, now: datetime) -> DataFrame:
    """Audit row for each new user."""
    return _row(users.alias("n"), "CREATE", now, new_values=_values("n", CREATED_KEYS))


def updated_users(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Audit row with old and new values for each user written again."""
    return _row(
        _versions(old, new), "UPDATE", now,
        old_values=_values("o", UPDATED_KEYS), new_values=_values("n", UPDATED_KEYS),
    )


def critical_changes(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """High-risk audit row where e-mail, role or active flag changed from one value to another."""
    differs = (
        changed(folded(F.col("n.email")), folded(F.col("o.email")))
        | changed(F.col("n.is_active"), F.col("o.is_active"))
        | changed(F.col("n.role_id"), F.col("o.role_id"))
    )
    return _row(
        _versions(old, new).filter(differs), "update", now,
        old_values=_values("o", CRITICAL_KEYS), new_values=_values("n", CRITICAL_KEYS),
        risk_level=F.lit("high"),
    )


def _rewritten(new: DataFrame, hit: Column, values: dict[str, Column]) -> list[Column]:
    return [
        F.when(hit, values[c]).otherwise(F.col(f"n.{c}")).alias(c) if c in values else F.col(f"n.{c}")
        for c in new.columns
    ]


def reset_after_login(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new login clears failed attempts and the lock, on the first login as well."""
    logged_in = F.col("n.last_login").isNotNull() & changed_null_safe(
        F.col("n.last_login"), F.col("o.last_login")
    )
    cleared = {
        "failed_login_attempts": F.lit(0),
        "last_failed_login": F.lit(None).cast("timestamp"),
        "locked_until": F.lit(None).cast("timestamp"),
    }
    return _versions(old, new).select(*_rewritten(new, logged_in, cleared))


def rotate_after_password(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """A changed password invalidates tokens and the session."""
    rotated = changed(folded(F.col("n.password")), folded(F.col("o.password")))
    values = {
        "jwt_version": F.col("o.jwt_version") + 1,
        "password_changed_at": F.lit(now),
        "session_id": F.lit(None).cast("string"),
    }
    return _versions(old, new).select(*_rewritten(new, rotated, values))
