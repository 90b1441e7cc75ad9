"""Deterministic identities: RFC 4122 version 5 UUIDs as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the frozen namespace of all derived identities.
NAMESPACE = "8f1b9c6e-2a4d-5e7f-9b3c-6d8e0f2a4b5c"

_NAMESPACE_BYTES = NAMESPACE.replace("-", "").upper()


def uuid5_name(name: Column) -> Column:
    """Version 5 UUID of a name; null stays null. Runs inside whole-stage codegen."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_BYTES)), F.encode(name, "utf-8")))
    # Mentions of the digest share one evaluation as long as the id is not inside a conditional:
    # callers choose between names, not between ids.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def _text(value: Column | str | int) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def joined_name(*parts: Column | str | int) -> Column:
    """``a|b|c``; ``concat`` keeps a null part visible where ``concat_ws`` would hide it."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("|"), _text(part)]
    return F.concat(*pieces[1:])


def natural_name(domain: Column | str, entity: Column | str, key: Column | str) -> Column:
    return joined_name(domain, entity, key)


def ordinal_name(domain, entity, scenario, seed, ordinal) -> Column:
    return joined_name(domain, entity, scenario, seed, ordinal)


def uuid5_natural(domain: Column | str, entity: Column | str, key: Column | str) -> Column:
    """Identity of a row with a natural key; a null part is a contract violation, not a null id."""
    problem = F.raise_error(F.lit("domain, entity and natural key must not be null")).cast("string")
    return uuid5_name(F.coalesce(natural_name(domain, entity, key), problem))


def uuid5_ordinal(domain, entity, scenario, seed, ordinal) -> Column:
    """Identity of a row without a natural key: its position in a seeded scenario."""
    return uuid5_name(ordinal_name(domain, entity, scenario, seed, ordinal))
