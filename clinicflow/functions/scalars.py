"""Column expressions with the value rules the clinic tables follow.

Amounts are exact decimals that are rounded half up whenever they are stored.
Times of day are integer seconds, because an appointment may end after 24:00.
The processing date is always a parameter; no function here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_DIGITS = 4
LAST_CODE = 10**CODE_DIGITS - 1


def stored(value: Column, precision: int = 10, scale: int = 2) -> Column:
    """The value as a DECIMAL(precision, scale) column would hold it; NULL where it does not fit."""
    return value.try_cast(f"decimal({precision},{scale})")


def hundredths(value: Column) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return (value * 100).cast("bigint")


def from_hundredths(value: Column, precision: int = 10) -> Column:
    """NULL where the column cannot hold the amount."""
    return (value.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).try_cast(
        f"decimal({precision},2)"
    )


def iso_weekday(day: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(day) + 1


def end_seconds(start: Column, minutes: Column) -> Column:
    """End of a visit in seconds of the day; may pass 86,400."""
    return start + minutes * 60


def moment(day: Column, seconds: Column) -> Column:
    """Wall-clock timestamp of a day and a second of that day."""
    wall = day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return wall.cast("timestamp")


def leading_number(text: Column) -> Column:
    """The digits a text starts with as a number; 0 when there are none."""
    digits = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0)))


def code_number(code: Column) -> Column:
    """The running number at the end of a document code."""
    return leading_number(F.substring(code, -CODE_DIGITS, CODE_DIGITS))


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def folded(code: Column) -> Column:
    """Key under which codes and enum values compare equal: case and trailing spaces aside."""
    return F.lower(F.rtrim(code))


def collated(name: Column) -> Column:
    """A free-text name that compares without case, accents and trailing spaces."""
    return F.collate(name, "UNICODE_CI_AI_RTRIM")


def blank(text: Column) -> Column:
    """NULL or empty; trailing spaces do not count as content."""
    return text.isNull() | (F.rtrim(text) == "")


def json_object(**values: Column) -> Column:
    """JSON text that keeps keys whose value is NULL."""
    fields = [value.alias(name) for name, value in values.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_valid(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else; NULL stays NULL.

    The parser stops after the first value and does not see what follows it, so the text is
    placed in an array, where it must fill one place, and in an object, where a bracket that
    closes the array too early is an error. A repeated key is valid if the session allows it
    (spark.sql.variant.allowDuplicateKeys, as `session.SETTINGS` does).
    """
    one_value = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    parses = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(text.isNotNull(), parses & F.coalesce(one_value, F.lit(False)))


def json_list(text: Column) -> Column:
    """A JSON array kept in a text column, as an array of strings."""
    return F.from_json(text, "array<string>")


def changed(new: Column, old: Column) -> Column:
    """True only if both sides are set and differ."""
    return F.coalesce(new != old, F.lit(False))


def changed_null_safe(new: Column, old: Column) -> Column:
    return ~new.eqNullSafe(old)


def fails(condition: Column) -> Column:
    """A declared check is broken only by FALSE; NULL passes."""
    return F.coalesce(~condition, F.lit(False))
