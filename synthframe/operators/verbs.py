"""Keyed verbs over entity tables: filter, count, find, create or reuse, update, delete, verify.

Every verb returns a new DataFrame. Rows that share a key are folded by an aggregate before any
join, so a key that is repeated many times is reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_text, snapshot_long
from ..functions.convert import typed_convert
from ..spec import normalize
from .linking import Reference, link, reference_findings
from .skew import join_per_key


def _property(df: DataFrame, name: str) -> T.StructField:
    wanted = normalize(name)
    for f in df.schema.fields:
        if normalize(f.name) == wanted:
            return f
    raise ValueError(f"property '{name}' not found: {', '.join(df.columns)}")


def predicate(df: DataFrame, props: Mapping[str, object], now: Column | None = None) -> Column:
    """Conjunction of equalities on typed constants; a null constant matches null, never NULL itself.

    A text constant is converted to the property type on the driver side of the plan; a value that
    does not fit is a plan error.
    """
    terms = [F.lit(True)]
    for name, value in props.items():
        f = _property(df, name)
        if isinstance(value, str) and (value.lower() == "null" or not isinstance(f.dataType, T.StringType)):
            constant = _constant(df, value, f, now)
        else:
            constant = F.lit(value).cast(f.dataType)
        terms.append(F.col(f.name).eqNullSafe(constant))
    return reduce(lambda a, b: a & b, terms)


def _constant(df: DataFrame, raw: str, f: T.StructField, now: Column | None) -> Column:
    """Convert one constant now, so that the filter holds a literal that can be pushed down."""
    target = "timestamp" if isinstance(f.dataType, T.TimestampNTZType) else f.dataType.simpleString()
    result = df.sparkSession.range(1).select(typed_convert(F.lit(raw), target, now=now).alias("c")).first()["c"]
    if result["error"] is not None:
        raise ValueError(f"{f.name}: {result['error']}")
    return F.lit(result["value"]).cast(f.dataType)


def filter_eq(df: DataFrame, props: Mapping[str, object], now: Column | None = None) -> DataFrame:
    return df.filter(predicate(df, props, now))


def assert_count(df: DataFrame, props: Mapping[str, object], expected: int) -> DataFrame:
    """One row ``expected, actual, ok``."""
    return filter_eq(df, props).agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit(expected).cast("bigint").alias("expected"), "actual", (F.col("actual") == expected).alias("ok"))


def find_by_natural_key(df: DataFrame, keys: DataFrame, natural_key: str, row_id: str) -> DataFrame:
    """``key, status, rows, first_id, last_id`` for each distinct wanted key.

    ``keys`` has one column ``key``. Status is missing, unique or ambiguous; of an ambiguous key
    two ids are named, however many rows it has.
    """
    wanted = keys.select("key").distinct()
    # only rows of wanted keys are grouped: with few keys the table itself is not shuffled
    asked = df.withColumn("key", F.col(natural_key)).join(wanted, "key", "left_semi")
    found = asked.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))
    status = F.when(F.col("rows") == 1, "unique").when(F.col("rows") > 1, "ambiguous").otherwise("missing")
    return wanted.join(found, "key", "left").select(
        "key", status.alias("status"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "first_id", "last_id")


def find_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose primary key is in ``ids`` (column of the same name)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def assert_exists(df: DataFrame, expectations: DataFrame, natural_key: str) -> DataFrame:
    """Findings for ``key, property, expected`` (texts): row missing, ambiguous, or value different.

    An expectation without a property only asks for the row. Expected texts are converted to the
    property type first; a text that does not fit is a finding of its own.
    """
    fields = {f.name: f for f in df.schema.fields if f.name != natural_key}
    names = sorted(fields)
    wanted = expectations.select("key", "property", "expected")
    asked = df.join(wanted.select(F.col("key").alias(natural_key)).distinct(), natural_key, "left_semi").withColumn("key", F.col(natural_key))
    found = asked.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    held = snapshot_long(asked, ["key"], names).withColumnRenamed("value", "actual")
    # rows of ambiguous keys are not compared; the others have one value per (key, property)
    held = held.groupBy("key", "property").agg(F.min("actual").alias("actual"))
    canonical, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in names:
        kind = fields[name].dataType
        target = "timestamp" if isinstance(kind, T.TimestampNTZType) else kind.simpleString()
        result = typed_convert(F.col("expected"), target)
        canonical = F.when(F.col("property") == name, canonical_text(result["value"], kind)).otherwise(canonical)
        error = F.when(F.col("property") == name, result["error"]).otherwise(error)
    checked = (wanted.join(found, "key", "left").join(held, ["key", "property"], "left")
               .withColumn("_want", canonical).withColumn("_error", error))
    known = F.col("property").isin(names)
    finding = (F.when(F.col("_rows").isNull(), "missing row").when(F.col("_rows") > 1, "ambiguous key")
               .when(F.col("property").isNull(), F.lit(None)).when(~known, "unknown property")
               .when(F.col("_error").isNotNull(), F.col("_error"))
               .when(~F.col("_want").eqNullSafe(F.col("actual")), "value differs"))
    return (checked.withColumn("finding", finding).filter(F.col("finding").isNotNull())
            .select("key", "property", F.coalesce("_want", "expected").alias("expected"), "actual", "finding"))


def create_rows(rows: DataFrame, shared: Mapping[str, object]) -> DataFrame:
    """Inline rows plus values shared by all of them; a cell of the row wins over a shared value."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    columns = {}
    for name, value in shared.items():
        constant = F.lit(value).cast(types[name]) if name in types else F.lit(value)
        columns[name] = F.coalesce(F.col(name), constant) if name in types else constant
    return rows.withColumns(columns)


def fold_batch(rows: DataFrame, natural_key: str, order: Sequence[str], set_columns: Mapping[str, str]) -> DataFrame:
    """One row per key of a batch: generated values of the first row, explicit values of the last.

    ``set_columns`` maps an entity column to the column that holds its explicit value (NULL = not
    given). ``order`` is the position within the batch.
    """
    position = F.struct(*[F.col(c) for c in order])
    carried = [c for c in rows.columns if c != natural_key and c not in set_columns.values()]
    aggregates = [F.min_by(F.struct(*[F.col(c) for c in carried]), position).alias("_first")]
    for source in set_columns.values():
        aggregates.append(F.max_by(F.col(source), F.when(F.col(source).isNotNull(), position)).alias(source))
    return rows.groupBy(natural_key).agg(*aggregates).select(natural_key, "_first.*", *set_columns.values())


def create_or_reuse(target: DataFrame, rows: DataFrame, natural_key: str, order: Sequence[str],
                    set_columns: Mapping[str, str]) -> DataFrame:
    """The table after the batch, with ``action`` kept, updated or inserted per row.

    An existing row of the same natural key keeps its id and values and takes only the explicit
    ones; repeated keys in the batch converge on the first row; a key that several stored rows
    share cannot be reused, so its row is inserted.
    """
    batch = fold_batch(rows, natural_key, order, set_columns)
    asked = target.select(natural_key).join(batch.select(natural_key), natural_key, "left_semi")
    stored = asked.groupBy(natural_key).agg(F.count(F.lit(1)).alias("_stored"))
    batch = batch.join(stored, natural_key, "left").withColumn("_stored", F.coalesce("_stored", F.lit(0)))

    changes = batch.filter(F.col("_stored") == 1).select(
        natural_key, F.lit(True).alias("_hit"), *[F.col(s).alias(f"_set_{c}") for c, s in set_columns.items()])
    touched = reduce(lambda a, b: a | b, [F.col(f"_set_{c}").isNotNull() for c in set_columns], F.lit(False))
    joined = join_per_key(target, changes, [natural_key])
    kept = joined.select(
        *[F.coalesce(F.col(f"_set_{c}"), F.col(c)).alias(c) if c in set_columns else F.col(c) for c in target.columns],
        F.when(F.col("_hit") & touched, "updated").otherwise("kept").alias("action"))
    fresh = batch.filter(F.col("_stored") != 1).select(
        *[F.coalesce(F.col(set_columns[c]), F.col(c)).alias(c) if c in set_columns else F.col(c) for c in target.columns],
        F.lit("inserted").alias("action"))
    return kept.unionByName(fresh)


def concurrent_winner(rows: DataFrame, natural_key: str, order: Sequence[str], row_id: str) -> DataFrame:
    """Rows of several scenarios that create one key: the first survives, the others reuse its id."""
    place = F.struct(*[F.col(c) for c in order])
    winners = rows.groupBy(natural_key).agg(F.min(place).alias("_first"), F.min_by(row_id, place).alias("winner_id"))
    return join_per_key(rows, winners, [natural_key], "inner").withColumn(
        "outcome", F.when(place == F.col("_first"), "created").otherwise("already-existed")).drop("_first")


def _usable_changes(df: DataFrame, changes: DataFrame, natural_key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key that exactly one row of ``df`` has: the last non-null cell of each column as ``_set_<column>``."""
    position = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    folded = changes.groupBy(natural_key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_set_{c}") for c in columns])
    asked = df.select(natural_key).join(folded.select(natural_key), natural_key, "left_semi")
    single = asked.groupBy(natural_key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") == 1)
    return folded.join(single, natural_key, "left_semi")


def update_by_key(df: DataFrame, changes: DataFrame, natural_key: str, columns: Sequence[str],
                  order: Sequence[str] = (), references: Sequence[Reference] = (), context: DataFrame | None = None) -> DataFrame:
    """The table with the non-null cells of ``changes`` applied to the row of each key.

    Several changes of one key apply in ``order``. A key shared by several rows changes none. ``references`` take their
    keys from columns of ``changes`` and set foreign keys after the values; one that is not resolved leaves the foreign
    key as it was (see ``update_findings``).
    """
    usable = _linked_changes(df, changes, natural_key, columns, order, references, context)
    written = [*columns, *(r.fk for r in references)]
    return join_per_key(df, usable.select(natural_key, *[f"_set_{c}" for c in written]), [natural_key]).select(*[
        F.coalesce(F.col(f"_set_{c}").cast(df.schema[c].dataType), F.col(c)).alias(c) if c in written else F.col(c) for c in df.columns])


def _linked_changes(df: DataFrame, changes: DataFrame, natural_key: str, columns: Sequence[str], order: Sequence[str],
                    references: Sequence[Reference], context: DataFrame | None) -> DataFrame:
    keys = [r.key_column for r in references if r.key_column not in columns]
    usable = _usable_changes(df, changes, natural_key, [*columns, *keys], order)
    return link(usable, [replace(r, fk=f"_set_{r.fk}", key_column=f"_set_{r.key_column}") for r in references], context)


def update_findings(df: DataFrame, changes: DataFrame, natural_key: str, references: Sequence[Reference],
                    order: Sequence[str] = (), context: DataFrame | None = None) -> DataFrame:
    """``row`` (the changed key), ``entity``, ``key``, ``problem``: references of an update that could not be resolved."""
    usable = _linked_changes(df, changes, natural_key, [], order, references, context)
    return reference_findings(usable, [replace(r, fk=f"_set_{r.fk}") for r in references], natural_key)


def missing_keys(df: DataFrame, keys: DataFrame, natural_key: str) -> DataFrame:
    """Wanted keys that match no row: one finding each."""
    return keys.select(natural_key).distinct().join(df.select(natural_key), natural_key, "left_anti")


def delete_by_key(df: DataFrame, keys: DataFrame, natural_key: str) -> DataFrame:
    """The table without the rows of the given keys."""
    return join_per_key(df, keys.select(natural_key).distinct(), [natural_key], "left_anti")


def delete_where(df: DataFrame, props: Mapping[str, object]) -> DataFrame:
    """The table without the matching rows; an empty filter deletes all."""
    return df.filter(~predicate(df, props))


def deleted_count(df: DataFrame, props: Mapping[str, object]) -> DataFrame:
    return filter_eq(df, props).agg(F.count(F.lit(1)).alias("deleted"))


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def exists_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``key, existed`` per distinct id: what a delete by id would report."""
    present = df.select(F.col(key)).distinct().withColumn("_there", F.lit(True))
    return ids.select(key).distinct().join(present, key, "left").select(
        key, F.coalesce("_there", F.lit(False)).alias("existed"))


class StepFailed(RuntimeError):
    """A conversion problem under the policy that stops the run."""


def convert_columns(df: DataFrame, targets: Mapping[str, str], now: Column | None = None) -> DataFrame:
    """Text columns to types; ``errors`` lists what did not fit, per row."""
    results = {name: typed_convert(F.col(name), kind, now=now) for name, kind in targets.items()}
    messages = F.filter(F.array(*[r["error"] for r in results.values()]), lambda e: e.isNotNull())
    kept = [F.col(c) for c in df.columns if c not in targets]
    return df.select(*kept, *[r["value"].alias(n) for n, r in results.items()], messages.alias("errors"))


def route_failures(converted: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of converted rows.

    best_effort keeps every row with the bad property left out; fail_object moves the row to the
    rejects; fail_run stops at the first problem.
    """
    bad = F.size("errors") > 0
    if policy == "best_effort":
        return converted, converted.filter(F.lit(False))
    if policy == "fail_object":
        return converted.filter(~bad), converted.filter(bad)
    if policy == "fail_run":
        first = converted.filter(bad).select("errors").first()
        if first is not None:
            raise StepFailed("; ".join(first["errors"]))
        return converted, converted.filter(F.lit(False))
    raise ValueError(f"unknown failure policy '{policy}': best_effort, fail_object, fail_run")
