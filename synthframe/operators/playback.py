"""Playback of run records: expected state, drift against a table, replay onto a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import snapshot, values_equal
from ..functions.convert import typed_convert
from ..spec import normalize
from .skew import join_per_key, last_before

WRITING_VERBS = ("Create", "Projection", "Update")


def playable(entities: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Records of persistent scenarios that ran, without dry-run rows."""
    kept = scenarios.filter((F.col("lifecycle") == "Persistent") & (F.col("outcome") != "Skipped")).select("scenario_seq")
    real = entities.filter(~F.col("persisted_via").eqNullSafe("dry-run"))
    return join_per_key(real, kept, ["scenario_seq"], "left_semi")


def row_key() -> Column:
    """One row of one table, whatever the case of names: by id, else by natural key."""
    handle = F.coalesce("id", F.concat(F.lit("nk:"), F.coalesce("natural_key", F.lit(""))))
    return F.lower(F.concat("domain", F.lit("|"), "entity", F.lit("|"), handle))


def _last_writes(records: DataFrame) -> DataFrame:
    position = F.struct("scenario_seq", "ordinal")
    kept = ("scenario_seq", "ordinal", "domain", "entity", "verb", "id", "natural_key", "values")
    return (records.withColumn("row_key", row_key()).groupBy("row_key")
            .agg(F.max_by(F.struct(*kept), position).alias("r"),
                 F.max(F.when(F.col("verb") == "Delete", position)).alias("_gone"),
                 F.max(F.when(F.col("verb").isin("Create", "Projection"), position)).alias("_made"))
            .select("row_key", "r.*", "_gone", "_made").withColumn("deleted", F.col("verb") == "Delete"))


def fold_expected(entities: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The end state the records promise: one row per ``row_key``, ``deleted`` for tombstones.

    The last write of a row wins. A delete-all recorded no ids, so it voids what was recorded
    before it for that entity.
    """
    records = playable(entities, scenarios)
    wipe = (F.col("verb") == "Delete") & F.col("id").isNull()
    voids = records.filter(wipe).groupBy(F.lower("domain").alias("_d"), F.lower("entity").alias("_e")).agg(
        F.max(F.struct("scenario_seq", "ordinal")).alias("_void"))
    writes = records.filter(F.col("verb").isin(*WRITING_VERBS) | ((F.col("verb") == "Delete") & F.col("id").isNotNull()))
    last = _last_writes(writes)
    # one row per entity type that was wiped
    marked = last.join(voids, (F.lower("domain") == F.col("_d")) & (F.lower("entity") == F.col("_e")), "left")
    survives = F.col("_void").isNull() | (F.struct("scenario_seq", "ordinal") > F.col("_void"))
    return marked.filter(survives).drop("_d", "_e", "_void", "_gone", "_made")


def find_recorded(expected: DataFrame, actual: DataFrame, row_id: str, natural_key: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``found`` and ``actual_values`` (text map): by id, and only without an id by natural key."""
    held = actual.select(F.col(row_id).cast("string").alias("id"), F.col(natural_key).cast("string").alias("_nk"),
                         snapshot(actual, columns).alias("actual_values"))
    with_id, without = expected.filter(F.col("id").isNotNull()), expected.filter(F.col("id").isNull())
    by_id = join_per_key(with_id, held.filter(F.col("id").isNotNull()).select("id", "actual_values"), ["id"])
    # only keys that are asked for, and of those only the ones a single row has
    asked = held.join(without.select(F.col("natural_key").alias("_nk")).distinct(), "_nk", "left_semi")
    single = asked.groupBy("_nk").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") == 1).select("_nk")
    one = asked.join(single, "_nk", "left_semi").select("_nk", "actual_values")
    by_key = join_per_key(without.withColumn("_nk", F.col("natural_key")), one, ["_nk"]).drop("_nk")
    found = by_id.unionByName(by_key)
    return found.withColumn("found", F.col("actual_values").isNotNull())


def drift_rows(found: DataFrame) -> DataFrame:
    """``row_key, drift``: a promised row is missing, or a deleted one exists again."""
    drift = F.when(F.col("deleted") & F.col("found"), "exists again").when(~F.col("deleted") & ~F.col("found"), "missing")
    return found.withColumn("drift", drift).filter(F.col("drift").isNotNull()).select("row_key", "drift")


def drift_values(found: DataFrame) -> DataFrame:
    """``row_key, property, recorded, current, finding``: changed values; vanished properties only warn."""
    cells = found.filter(F.col("found") & ~F.col("deleted")).select(
        "row_key", "actual_values", F.explode("values").alias("property", "recorded"))
    known = F.map_contains_key("actual_values", F.col("property"))
    current = F.try_element_at("actual_values", F.col("property"))
    finding = F.when(~known, "vanished").when(~values_equal(F.col("recorded"), current), "changed")
    return (cells.withColumn("finding", finding).filter(F.col("finding").isNotNull())
            .select("row_key", "property", "recorded", current.alias("current"), "finding"))


def unverifiable_bulk(bulk: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Bulk operations of played scenarios whose rows were only hashed: a warning each."""
    kept = scenarios.filter((F.col("lifecycle") == "Persistent") & (F.col("outcome") != "Skipped")).select("scenario_seq", "scenario")
    hashed = join_per_key(bulk.filter(F.col("hashed_rows") > 0), kept, ["scenario_seq"], "inner")
    return hashed.select("scenario_seq", "domain", "entity", F.concat(
        "scenario", F.lit(": "), F.col("sampled_rows").cast("string"), F.lit(" of "), F.col("count").cast("string"),
        F.lit(" bulk rows of "), "entity", F.lit(" were recorded one by one; the rest cannot be checked")).alias("warning"))


def drift_report(found: DataFrame, scenarios: DataFrame, warnings: int = 0) -> DataFrame:
    """One row ``rows_checked, skipped_scenarios, drift, warnings, exit_code`` (0 clean, 1 drift).

    Properties are compared inside each row, so the found rows are read once.
    """
    def current(name):
        return F.try_element_at("actual_values", name)

    known = F.map_filter("values", lambda k, v: F.map_contains_key("actual_values", k))
    changed = F.size(F.map_filter(known, lambda k, v: ~values_equal(v, current(k))))
    compared = F.col("found") & ~F.col("deleted") & F.col("values").isNotNull()
    moved = F.when(F.col("deleted") == F.col("found"), 1).otherwise(0)
    counted = found.agg(F.count(F.lit(1)).alias("rows_checked"),
                        F.coalesce(F.sum(moved + F.when(compared, changed).otherwise(0)), F.lit(0)).alias("drift"),
                        (F.coalesce(F.sum(F.when(compared, F.size("values") - F.size(known))), F.lit(0)) + F.lit(warnings)).alias("warnings"))
    skipped = scenarios.agg(F.count(F.when(~((F.col("lifecycle") == "Persistent") & (F.col("outcome") != "Skipped")), 1)).alias("_s"))
    return counted.select("rows_checked", skipped.scalar().alias("skipped_scenarios"), "drift", "warnings").withColumn(
        "exit_code", F.when(F.col("drift") > 0, 1).otherwise(0))


def apply_recorded_values(df: DataFrame, values: str, columns: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Recorded texts back into typed ``columns``; adds ``warnings``.

    A property without an entry keeps its value; a recorded null empties only nullable columns; a
    text that does not fit, and a property nobody knows, only warn.
    """
    updates, messages = {}, []
    held, spelled = F.map_values(values), F.transform(F.map_keys(values), lambda k: F.lower(F.translate(k, " _-", "")))
    for name in columns:
        kind = df.schema[name].dataType
        # the exact name, else the first one that differs in case, spaces, underscores or hyphens only
        place = F.array_position(spelled, normalize(name))
        exact = F.map_contains_key(values, F.lit(name))
        has = exact | (place > 0)
        raw = F.when(exact, F.try_element_at(F.col(values), F.lit(name))).otherwise(F.get(held, (place - 1).cast("int")))
        target = "timestamp" if isinstance(kind, T.TimestampNTZType) else kind.simpleString()
        result = typed_convert(raw, target)
        new = result["value"] if isinstance(kind, T.StringType) else result["value"].cast(kind)
        if isinstance(kind, T.StringType):
            new = F.when(F.lower(raw) == "null", F.lit(None)).otherwise(raw)
        null_value = F.lit(None).cast(kind) if name in nullable else F.col(name)
        updates[name] = (F.when(~F.coalesce(has, F.lit(False)), F.col(name)).when(raw.isNull(), null_value)
                         .when(result["error"].isNotNull(), F.col(name)).otherwise(new))
        messages.append(F.when(has, F.concat(F.lit(f"{name}: "), result["error"])))
    wanted = {normalize(c) for c in columns}
    unknown = F.filter(F.map_keys(values), lambda k: ~F.lower(F.translate(k, " _-", "")).isin(*wanted))
    strange = F.transform(unknown, lambda k: F.concat(F.lit("unknown property "), k))
    errors = F.filter(F.array(*messages), lambda m: m.isNotNull())
    warnings = F.concat(errors, F.coalesce(strange, F.array().cast("array<string>")))
    return df.withColumns({**updates, "warnings": warnings})


def key_counts(target: DataFrame, records: DataFrame, row_id: str, natural_key: str) -> DataFrame:
    """``_nk, _rows, _first, _last``: how many stored rows have a natural key that a record without an id names."""
    asked = records.filter(F.col("id").isNull() & F.col("natural_key").isNotNull()).select(F.col("natural_key").alias("_nk")).distinct()
    held = target.select(F.col(natural_key).cast("string").alias("_nk"), F.col(row_id).cast("string").alias("_id"))
    return held.join(asked, "_nk", "left_semi").groupBy("_nk").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))


def ambiguous_records(entities: DataFrame, scenarios: DataFrame, target: DataFrame, domain: str, entity: str, row_id: str, natural_key: str) -> DataFrame:
    """``natural_key, records, rows, first_id, last_id``: keys of records without an id that several stored rows share.

    Such records are not replayed; they are failures of ``replay_steps``.
    """
    mine = playable(entities, scenarios).filter((F.lower("domain") == domain.lower()) & (F.lower("entity") == entity.lower()) & F.col("id").isNull() & F.col("verb").isin(*WRITING_VERBS))
    per_key = mine.filter(F.col("natural_key").isNotNull()).groupBy(F.col("natural_key").alias("_nk")).agg(F.count(F.lit(1)).alias("records"))
    return per_key.join(key_counts(target, mine, row_id, natural_key).filter("_rows > 1"), "_nk").select(
        F.col("_nk").alias("natural_key"), "records", F.col("_rows").alias("rows"), F.col("_first").alias("first_id"), F.col("_last").alias("last_id"))


def replay(entities: DataFrame, scenarios: DataFrame, target: DataFrame, domain: str, entity: str, row_id: str,
           natural_key: str, columns: Sequence[str]) -> DataFrame:
    """The table after replaying the records of one entity: recorded values, not generators.

    Adds ``action`` kept, updated or created. Created and projected rows are inserted or get their
    values again, updates need the row, deletes by id tolerate its absence, delete-alls do nothing.
    A record without an id finds its row by natural key, and inserts it if it creates and no row has
    the key; of two writes that find one row, by id and by key, the later one decides. A key that several
    stored rows share names none of them: its records change and insert nothing (see ``ambiguous_records``).
    """
    mine = playable(entities, scenarios).filter((F.lower("domain") == domain.lower()) & (F.lower("entity") == entity.lower()))
    writes = mine.filter((F.col("verb").isin(*WRITING_VERBS) & F.col("natural_key").isNotNull()) | F.col("id").isNotNull())
    # an update alone cannot bring a row into being: a creation after the last delete can
    creates = F.col("_made").isNotNull() & (F.col("_gone").isNull() | (F.col("_made") > F.col("_gone")))
    last = _last_writes(writes).withColumn("_creates", creates).withColumn("_at", F.struct("scenario_seq", "ordinal"))
    by_id = last.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("_id"), F.col("natural_key").alias("_key"), "deleted", "_creates", F.col("_gone").isNotNull().alias("_was_deleted"),
        F.col("values").alias("_values"), "_at")
    by_key = last.filter(F.col("id").isNull()).select(
        F.col("natural_key").alias("_nk"), F.col("_creates").alias("_key_creates"), F.col("values").alias("_key_values"), F.col("_at").alias("_key_at"))
    by_key = by_key.join(key_counts(target, writes, row_id, natural_key).filter("_rows > 1").select("_nk"), "_nk", "left_anti")
    base = target.withColumn("_id", F.col(row_id).cast("string")).withColumn("_nk", F.col(natural_key).cast("string"))
    joined = join_per_key(join_per_key(base, by_id, ["_id"]), by_key, ["_nk"])
    there = joined.filter(~F.coalesce("deleted", F.lit(False)) & ~(F.coalesce("_was_deleted", F.lit(False)) & ~F.coalesce("_creates", F.lit(False))))
    later = F.col("_key_at").isNotNull() & (F.col("_at").isNull() | (F.col("_key_at") > F.col("_at")))
    there = there.withColumn("_values", F.when(later, F.col("_key_values")).otherwise(F.col("_values")))
    kept = apply_recorded_values(there, "_values", columns, nullable=columns).withColumn(
        "action", F.when(F.col("_at").isNull() & F.col("_key_at").isNull(), "kept").otherwise("updated"))
    fresh = by_id.filter(~F.col("deleted") & F.col("_creates")).join(base.select("_id"), "_id", "left_anti").select("_id", F.col("_key").alias("_nk"), "_values")
    taken = there.select("_nk").unionByName(fresh.select("_nk"))
    keyed = (by_key.filter("_key_creates").join(taken, "_nk", "left_anti")
             .select(F.lit(None).cast("string").alias("_id"), "_nk", F.col("_key_values").alias("_values")))
    given = {row_id: "_id", natural_key: "_nk"}
    empty = fresh.unionByName(keyed).select("_values", *[
        (F.col(given[f.name]).try_cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.schema.fields])
    created = apply_recorded_values(empty, "_values", columns, nullable=columns).withColumn("action", F.lit("created"))
    names = [*target.columns, "action"]
    return kept.select(*names).unionByName(created.select(*names))


def replay_steps(entities: DataFrame, scenarios: DataFrame, target: DataFrame, row_id: str, natural_key: str | None = None,
                 configured: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Every record with ``step``: created, updated, deleted, absent, failed, warning or skipped.

    Whether the row exists when a record is replayed follows from the last creation or deletion before
    it, else from the table: by id, and only without an id by natural key. A record whose (domain,
    entity) is not ``configured`` fails, as does one without an id whose key several rows of the table share.
    """
    played = scenarios.withColumn("_play", (F.col("lifecycle") == "Persistent") & (F.col("outcome") != "Skipped")).select("scenario_seq", "_play")
    marked = join_per_key(entities, played, ["scenario_seq"])
    dry = F.col("persisted_via").eqNullSafe("dry-run")
    live = F.coalesce("_play", F.lit(False)) & ~dry
    known_type = F.lit(True) if configured is None else F.concat(F.lower("domain"), F.lit("|"), F.lower("entity")).isin(
        *[f"{d}|{e}".lower() for d, e in configured])
    rest = marked.filter(~live).select("scenario_seq", "ordinal", F.lit("skipped").alias("step"))
    strange = marked.filter(live & ~F.coalesce(known_type, F.lit(False))).select("scenario_seq", "ordinal", F.lit("failed").alias("step"))
    live = live & known_type
    wipe = (F.col("verb") == "Delete") & F.col("id").isNull()
    wiped = marked.filter(live & wipe).select("scenario_seq", "ordinal", F.lit("warning").alias("step"))
    rows = (marked.filter(live & ~wipe).withColumn("row_key", row_key())
            .withColumn("_exists_after", F.when(F.col("verb").isin("Create", "Projection"), True).when(F.col("verb") == "Delete", False)))
    traced = last_before(rows.select("scenario_seq", "ordinal", "row_key", "id", "natural_key", "verb", "_exists_after"),
                         ["row_key"], "scenario_seq", "ordinal", "_exists_after", "_before")
    # ids and natural keys of the table in one list, so that the records are joined once
    stored = target.select(F.concat(F.lit("i"), F.col(row_id).cast("string")).alias("_handle"))
    if natural_key is not None:
        stored = stored.unionByName(target.select(F.concat(F.lit("k"), F.col(natural_key).cast("string")).alias("_handle")))
    stored = stored.filter(F.col("_handle").isNotNull()).groupBy("_handle").agg(F.lit(True).alias("_stored"), (F.count(F.lit(1)) > 1).alias("_several"))
    handle = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("k"), "natural_key"))
    known = join_per_key(traced.withColumn("_handle", handle), stored, ["_handle"])
    exists = F.coalesce("_before", "_stored", F.lit(False))
    step = (F.when(F.col("id").isNull() & F.col("_several"), "failed")
            .when(F.col("verb").isin("Create", "Projection"), F.when(exists, "updated").otherwise("created"))
            .when(F.col("verb") == "Update", F.when(exists, "updated").otherwise("failed"))
            .when(F.col("verb") == "Delete", F.when(exists, "deleted").otherwise("absent")).otherwise("skipped"))
    return known.select("scenario_seq", "ordinal", step.alias("step")).unionByName(wiped).unionByName(strange).unionByName(rest)


def replay_report(steps: DataFrame, bulk_warnings: int = 0) -> DataFrame:
    """One row ``created, updated, deleted, skipped, warnings, failures, exit_code``."""
    def times(name):
        return F.count(F.when(F.col("step") == name, 1))

    counted = steps.agg(times("created").alias("created"), times("updated").alias("updated"), times("deleted").alias("deleted"),
                        times("skipped").alias("skipped"), (times("warning") + F.lit(bulk_warnings)).alias("warnings"),
                        times("failed").alias("failures"))
    return counted.withColumn("exit_code", F.when(F.col("failures") > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0))
