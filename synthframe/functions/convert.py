"""Typed conversion of raw text. Nothing here throws: bad text becomes an error message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text formats.
RELATIVE_DATE = r"(?i)^(today|now)\s*(?:([+-])\s*([0-9]+)\s*([dwmy]))?$"
ISO_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
US_DATE = r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$"
GUID_DASHED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
GUID_BARE = r"^[0-9a-fA-F]{32}$"
TIME_OF_DAY = r"^([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:\.[0-9]+)?)?$"
TIME_SPAN = r"^(-)?(?:([0-9]+)\.)?([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9](?:\.[0-9]{1,7})?))?$"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_INTEGRAL = ("byte", "smallint", "int", "bigint")


def is_null_literal(raw: Column) -> Column:
    return F.lower(raw) == F.lit("null")


def null_literal(raw: Column, nullable: bool = True) -> Column:
    """The word ``null`` in any case becomes NULL for nullable targets, else it stays text."""
    return F.when(is_null_literal(raw), F.lit(None)).otherwise(raw) if nullable else raw


def relative_date(raw: Column, now: Column) -> Column:
    """``today`` / ``now`` with an optional ``+3d``, ``-2w``, ``+1m``, ``-1y``; NULL if it is neither."""
    token = F.trim(raw)
    part = [F.regexp_extract(token, RELATIVE_DATE, i) for i in range(5)]
    base = F.when(F.lower(part[1]) == "today", F.date_trunc("day", now)).otherwise(now)
    n = F.when(part[3] == "", F.lit(0)).otherwise(part[3].try_cast("int"))
    n = F.when(part[2] == "-", -n).otherwise(n)
    unit = F.lower(part[4])
    days = F.when(unit == "d", n).when(unit == "w", n * 7).otherwise(0)
    months = F.when(unit == "m", n).when(unit == "y", n * 12).otherwise(0)
    shifted = base + F.make_dt_interval(days) + F.make_ym_interval(F.lit(0), months)
    return F.when(token.rlike(RELATIVE_DATE), shifted)


def parse_timestamp_utc(raw: Column) -> Column:
    """ISO text (or month/day/year) to a UTC timestamp; text without an offset is taken as UTC."""
    text = F.trim(raw)
    return (F.when(text.rlike(ISO_DATE), text.try_cast("timestamp"))
             .when(text.rlike(US_DATE), F.try_to_timestamp(text, F.lit("M/d/yyyy"))))


def parse_date(raw: Column) -> Column:
    text = F.trim(raw)
    return (F.when(text.rlike(ISO_DATE + r"\s*$"), text.try_cast("date"))
             .when(text.rlike(US_DATE), F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))))


def parse_enum(raw: Column, values: Sequence[str]) -> Column:
    """Name without spaces in any case, or the ordinal number of the value."""
    text = F.replace(raw, F.lit(" "), F.lit(""))
    pairs: list[Column] = []
    for position, value in enumerate(values):
        pairs += [F.lit(value.lower()), F.lit(value), F.lit(str(position)), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), F.lower(text))


def parse_guid(raw: Column) -> Column:
    text = F.trim(raw)
    wrapped = text.rlike(r"^(\{.*\}|\(.*\))$")
    inner = F.when(wrapped, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    digits = F.lower(F.when(inner.rlike(GUID_DASHED), F.replace(inner, F.lit("-"), F.lit("")))
                      .when(~wrapped & inner.rlike(GUID_BARE), inner))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    pieces: list[Column] = []
    for start, size in cuts:
        pieces += [F.lit("-"), F.substring(digits, start, size)]
    return F.concat(*pieces[1:])


def parse_bool(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def parse_time(raw: Column) -> Column:
    """Time of day as ``HH:mm:ss`` text."""
    text = F.trim(raw)
    h, m, s = (F.regexp_extract(text, TIME_OF_DAY, i) for i in (1, 2, 3))
    seconds = F.when(s == "", F.lit("00")).otherwise(s)
    return F.when(text.rlike(TIME_OF_DAY), F.concat_ws(":", F.lpad(h, 2, "0"), m, seconds))


def parse_timespan_seconds(raw: Column) -> Column:
    """``[-][d.]hh:mm[:ss[.f]]`` or a whole number of days, as decimal seconds."""
    text = F.trim(raw)
    sign, d, h, m, s = (F.regexp_extract(text, TIME_SPAN, i) for i in range(1, 6))
    amount = (F.coalesce(d.try_cast("decimal(18,6)"), F.lit(0)) * 86400
              + F.coalesce(h.try_cast("decimal(18,6)"), F.lit(0)) * 3600
              + F.coalesce(m.try_cast("decimal(18,6)"), F.lit(0)) * 60
              + F.coalesce(s.try_cast("decimal(18,6)"), F.lit(0)))
    signed = F.when(sign == "-", -amount).otherwise(amount).cast("decimal(18,6)")
    days = (text.try_cast("decimal(18,6)") * 86400).cast("decimal(18,6)")
    return F.when(text.rlike(TIME_SPAN), signed).when(text.rlike(INTEGER), days)


def parse_timespan(raw: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), parse_timespan_seconds(raw))


def parse_integral(raw: Column, target: str) -> Column:
    text = F.trim(raw)
    if target == "byte":  # unsigned, hence one size up
        value = F.when(text.rlike(INTEGER), text.try_cast("smallint"))
        return F.when(value.between(0, 255), value)
    return F.when(text.rlike(INTEGER), text.try_cast(target))


def parse_number(raw: Column, target: str) -> Column:
    text = F.trim(raw)
    return F.when(text.rlike(NUMBER), text.try_cast(target))


def _parsed(raw: Column, target: str, now: Column | None, enum_values: Sequence[str] | None) -> Column:
    if target == "string":
        return raw
    if target in ("timestamp", "date"):
        anchor = F.current_timestamp() if now is None else now
        relative = relative_date(raw, anchor)
        if target == "date":
            return F.coalesce(F.to_date(relative), parse_date(raw))
        return F.coalesce(relative, parse_timestamp_utc(raw))
    if target == "enum":
        if not enum_values:
            raise ValueError("an enum target needs its values")
        return parse_enum(raw, enum_values)
    if target == "guid":
        return parse_guid(raw)
    if target == "time":
        return parse_time(raw)
    if target == "timespan":
        return parse_timespan(raw)
    if target == "boolean":
        return parse_bool(raw)
    if target in _INTEGRAL:
        return parse_integral(raw, target)
    return parse_number(raw, target)


def typed_convert(raw: Column, target: str, *, nullable: bool = True, now: Column | None = None,
                  enum_values: Sequence[str] | None = None) -> Column:
    """``struct(value, error)``: value is typed, error is NULL unless the text does not fit.

    Targets: string, timestamp, date, enum, guid, time, timespan, boolean, byte, smallint, int,
    bigint, float, double and decimal(p,s). Text targets always count as nullable.
    """
    missing = is_null_literal(raw) if (nullable or target == "string") else F.lit(False)
    value = F.when(~F.coalesce(missing, F.lit(True)), _parsed(raw, target, now, enum_values))
    bad = raw.isNotNull() & ~missing & value.isNull()
    message = F.concat(F.lit('Cannot convert "'), raw, F.lit(f'" to {target}'))
    return F.struct(value.alias("value"), F.when(bad, message).alias("error"))
