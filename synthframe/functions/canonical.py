"""Canonical text of values: what a recorded row looks like as strings, and when two are equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text formats of recorded values.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
DATE_FORMAT = "yyyy-MM-dd"

_ISO_POINT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
_SCIENTIFIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$"


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """Explicit format per type, so that no engine default decides how a value reads."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TIMESTAMP_FORMAT)
    if isinstance(data_type, T.DateType):
        return F.date_format(column, DATE_FORMAT)
    # a double's text reads back as the same double, NaN and infinity included
    return column.cast("string")


def snapshot(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Every scalar column as ``map(property -> text)``; a null stays a null entry."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    names = F.array(*[F.lit(f.name) for f in fields])
    return F.map_from_arrays(names, F.array(*[canonical_text(F.col(f.name), f.dataType) for f in fields]))


def snapshot_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, property): ``keys..., property, value``. Narrow, no shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [canonical_text(F.col(c), types[c]).alias(c) for c in columns]
    held = [F.col(k).alias(f"_key_{k}") for k in keys]
    long = df.select(*held, *texts).unpivot([f"_key_{k}" for k in keys], list(columns), "property", "value")
    return long.withColumnsRenamed({f"_key_{k}": k for k in keys})


def canonical_row(ordinal: Column, row_id: Column, key: Column, values: dict[str, Column]) -> Column:
    """``ordinal|id|key`` and, by property name, unit separator ``name=value``; null reads as empty."""
    head = F.concat(ordinal.cast("string"), F.lit("|"), F.coalesce(row_id.cast("string"), F.lit("")),
                    F.lit("|"), F.coalesce(key.cast("string"), F.lit("")))
    cells = [F.concat(F.lit(f"\u001f{name}="), F.coalesce(values[name], F.lit(""))) for name in sorted(values)]
    return F.concat(head, *cells)


def _digits(text: Column) -> Column:
    """Text of a plain number without sign, leading and trailing zeros; a negative one keeps its sign. No digit is cut."""
    body = F.regexp_replace(text, r"^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^([0-9]*)", 1), "^0+", "")
    fraction = F.regexp_replace(F.regexp_extract(body, r"\.([0-9]*)$", 1), "0+$", "")
    value = F.concat(whole, F.lit("."), fraction)
    return F.when((value != ".") & F.startswith(text, F.lit("-")), F.concat(F.lit("-"), value)).otherwise(value)


def values_equal(recorded: Column, current: Column) -> Column:
    """Same stored value, never NULL.

    Equal text; or equal numbers, to every digit, where at least one side has a fraction dot (so ``007`` is
    not ``7``); or, where one side has an exponent, the same double; or the same instant to the microsecond.
    A null equals only a null.
    """
    def instant(text: Column) -> Column:
        return F.when(text.rlike(_ISO_POINT), text.try_cast("timestamp"))

    a, b = F.trim(recorded), F.trim(current)
    plain = a.rlike(_PLAIN) & b.rlike(_PLAIN)
    number = (a.rlike(_PLAIN) | a.rlike(_SCIENTIFIC)) & (b.rlike(_PLAIN) | b.rlike(_SCIENTIFIC))
    dotted = F.contains(recorded, F.lit(".")) | F.contains(current, F.lit("."))
    numeric = F.when(plain & dotted, _digits(a) == _digits(b)).when(number & ~plain, a.try_cast("double") == b.try_cast("double"))
    temporal = instant(recorded) == instant(current)
    return F.coalesce(
        F.when(recorded.eqNullSafe(current), True),
        F.when(recorded.isNull() | current.isNull(), False),
        numeric, temporal, F.lit(False),
    )
