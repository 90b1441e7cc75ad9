"""Run records: what was written, how it went, what can be cleaned up.

Tables (columns used here):
``entities``  scenario_seq, ordinal, domain, entity, verb, persisted_via, id, id_strategy,
natural_key, source, values map, overrides array, warnings array, duration_ms;
``scenarios`` scenario_seq, feature, scenario, line, seed, lifecycle, outcome, skipped, failed, warnings array;
``bulk`` scenario_seq, domain, entity, count, mode, sampled_rows, hashed_rows, duration_ms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row, canonical_text, snapshot
from ..spec import EntitySpec
from .skew import join_per_key

# Labels in run records.
CREATING_VERBS = ("Create", "Projection")
OUTCOMES = ("Succeeded", "CompletedWithWarnings", "Failed", "Skipped")
SOURCE_LABELS = {"plugin": "GeneratorPlugin", "distributions": "Distribution", "datasets": "DatasetPack"}

HASH_BLOCK = 4096


def id_strategy_label(spec: EntitySpec) -> str:
    if spec.id_strategy == "db_generated" and not spec.unique_guid_key:
        return "DbGenerated"
    return "Deterministic" if spec.deterministic else "ClientSet"


def id_strategy_column(store_assigned: Column, guid_key: Column, deterministic: Column) -> Column:
    """The same label from flags per row."""
    return F.when(store_assigned, "DbGenerated").when(guid_key & deterministic, "Deterministic").otherwise("ClientSet")


def record_entities(df: DataFrame, spec: EntitySpec, *, verb: str, ordinal: str, source: Column | str,
                    route: Column | str, overrides: Sequence[str] = ()) -> DataFrame:
    """One record per written row, with a text snapshot of the entity's columns."""
    def text(value):
        return value if isinstance(value, Column) else F.lit(value)

    natural = F.col(spec.natural_key).cast("string") if spec.natural_key else F.lit(None).cast("string")
    return df.select(
        F.col(ordinal).cast("bigint").alias("ordinal"), F.lit(spec.domain).alias("domain"), F.lit(spec.entity).alias("entity"),
        F.lit(verb).alias("verb"), text(route).alias("persisted_via"), F.col(spec.key).cast("string").alias("id"),
        F.lit(id_strategy_label(spec)).alias("id_strategy"), natural.alias("natural_key"), text(source).alias("source"),
        snapshot(df, [f.name for f in spec.schema.fields]).alias("values"),
        F.array(*[F.lit(o) for o in overrides]).cast("array<string>").alias("overrides"))


def sample_cuts(rows: DataFrame, by: Sequence[str], ordinal: str, k: int) -> DataFrame:
    """``by..., head_cut, tail_cut``: ordinal of the k-th first and k-th last row of each operation.

    Either end is a bounded top-k: a task sends ``k`` rows of an operation at most, whatever the operation's size.
    """
    keys = list(by)

    def end(order: Column, cut: Column, name: str) -> DataFrame:
        near = rows.select(*keys, ordinal).filter(F.col(ordinal).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        return near.filter(F.col("_place") <= k).groupBy(*keys).agg(cut.alias(name))

    head = end(F.asc(ordinal), F.max(ordinal), "head_cut").withColumn("tail_cut", F.lit(None).cast("bigint"))
    tail = end(F.desc(ordinal), F.min(ordinal), "tail_cut").withColumn("head_cut", F.lit(None).cast("bigint"))
    return head.unionByName(tail).groupBy(*keys).agg(F.max("head_cut").alias("head_cut"), F.max("tail_cut").alias("tail_cut"))


def head_tail_sample(rows: DataFrame, by: Sequence[str], ordinal: str, failed: str, mode: str = "Sample", k: int = 5) -> DataFrame:
    """Adds ``kept``: recorded one by one, or only hashed. Failed rows always keep their record.

    Sample keeps the first and last ``k`` successful rows per operation, All keeps all, None none.
    """
    if mode == "All":
        return rows.withColumn("kept", F.lit(True))
    if mode == "None":
        return rows.withColumn("kept", F.col(failed))
    cuts = sample_cuts(rows.filter(~F.col(failed)), by, ordinal, k)
    inside = (F.col(ordinal) <= F.col("head_cut")) | (F.col(ordinal) >= F.col("tail_cut"))
    return join_per_key(rows, cuts, by).withColumn("kept", F.col(failed) | F.coalesce(inside, F.lit(False))).drop("head_cut", "tail_cut")


def row_text(df: DataFrame, ordinal: str, row_id: str, key: str, columns: Sequence[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return canonical_row(F.col(ordinal), F.col(row_id), F.col(key), {c: canonical_text(F.col(c), types[c]) for c in columns})


def _hash_tree(rows: DataFrame, keys: Sequence[str], ordinal: str, text: Column, block: int, counted: Mapping[str, Column], merged: Mapping[str, Callable]) -> DataFrame:
    """``keys..., values_sha256`` and the aggregates ``counted``, which ``merged`` combines from level to level.

    Every row is hashed first, so blocks hold hashes only. Levels of blocks follow until any 64-bit ordinal has come
    down to one block; the upper ones are a row or two per key. Rows whose text is null are counted, not hashed.
    """
    level = rows.withColumn("_hash", F.sha2(text, 256)).withColumn("_pos", F.col(ordinal).cast("bigint"))
    first, levels = True, math.ceil(63 / math.log2(block))
    for depth in range(levels):
        last = depth == levels - 1
        level = level if last else level.withColumn("_pos", F.struct(F.floor(F.col("_pos") / F.lit(block)).alias("to"), F.col("_pos").alias("at")))
        at = F.col("_pos") if last else F.col("_pos.at")
        ordered = F.array_sort(F.collect_list(F.when(F.col("_hash").isNotNull(), F.struct(at.alias("p"), F.col("_hash").alias("t")))))
        folded = F.when(F.size(ordered) > 0, F.sha2(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n"), 256))
        group = list(keys) if last else [*keys, F.col("_pos.to").alias("_pos")]
        level = level.groupBy(*group).agg(folded.alias("_hash"), *[(c if first else merged[n](n)).alias(n) for n, c in counted.items()])
        first = False
    return level.withColumnRenamed("_hash", "values_sha256")


def values_hash(rows: DataFrame, by: Sequence[str], ordinal: str, text: str, block: int = HASH_BLOCK) -> DataFrame:
    """``by..., values_sha256``: an order-fixed hash tree over rows with unique ordinals.

    Row hashes are hashed in blocks of consecutive ordinals, block hashes in blocks of blocks, and so on, for any
    number of rows; no step collects more than ``block`` hashes.
    """
    return _hash_tree(rows, list(by), ordinal, F.coalesce(F.col(text), F.lit("")), block, {}, {})


def bulk_summary(sampled: DataFrame, by: Sequence[str], ordinal: str, failed: str, text: str, block: int = HASH_BLOCK) -> DataFrame:
    """One row per bulk operation from rows with ``kept`` (see head_tail_sample). Counts ride along with the hash tree: one pass."""
    hashed = ~F.col("kept") & ~F.col(failed)
    good = ~F.col(failed)
    counted = {
        "requested": F.count(F.lit(1)), "count": F.count(F.when(good, 1)), "failed": F.count(F.when(F.col(failed), 1)),
        "sampled_rows": F.count(F.when(F.col("kept") & good, 1)), "hashed_rows": F.count(F.when(hashed, 1)),
        "first_ordinal": F.min(ordinal), "last_ordinal": F.max(ordinal)}
    merged = {n: {"first_ordinal": F.min, "last_ordinal": F.max}.get(n, F.sum) for n in counted}
    return _hash_tree(sampled, list(by), ordinal, F.when(hashed, F.coalesce(F.col(text), F.lit(""))), block, counted, merged)


def attestation(entities: DataFrame) -> DataFrame:
    """One row ``synthetic_only, sources``: which generator kinds contributed. All are synthetic."""
    kinds = entities.select("source", (F.size("overrides") > 0).alias("o"), F.col("id_strategy").eqNullSafe("Deterministic").alias("d")).distinct()
    parts = F.split(F.coalesce("source", F.lit("")), r"\+")
    base = F.when(F.coalesce("source", F.lit("")) == "", F.lit(None)).when(parts[0] == "auto", "AutoFaker").otherwise("ConventionFaker")
    marks = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(F.startswith(p, F.lit("plugin:")), SOURCE_LABELS["plugin"])
                        .when(p == "distributions", SOURCE_LABELS["distributions"]).when(p == "datasets", SOURCE_LABELS["datasets"]))
    found = F.concat(F.array(base, F.when(F.col("o"), "Override"), F.when(F.col("d"), "IdentityContract")), marks)
    labels = kinds.select(F.explode(found).alias("label")).filter(F.col("label").isNotNull())
    # at most six labels exist
    return labels.agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("sources")).select(
        F.lit(True).alias("synthetic_only"), "sources")


def scenario_outcome(scenarios: DataFrame, entities: DataFrame, unmatched: DataFrame) -> DataFrame:
    """``scenario_seq, outcome``: Skipped by tag; Failed over CompletedWithWarnings over Succeeded."""
    noisy = (entities.filter(F.size("warnings") > 0).select("scenario_seq")
             .unionByName(unmatched.select("scenario_seq")).distinct().withColumn("_noisy", F.lit(True)))
    outcome = (F.when(F.col("skipped"), "Skipped").when(F.col("failed"), "Failed")
               .when(F.col("_noisy") | (F.size("warnings") > 0), "CompletedWithWarnings").otherwise("Succeeded"))
    return scenarios.join(noisy, "scenario_seq", "left").select(
        "scenario_seq", F.when(outcome.isNull(), "Succeeded").otherwise(outcome).alias("outcome"))


def run_outcome(outcomes: DataFrame, orphans: int = 0, aborted: bool = False) -> DataFrame:
    """One row ``outcome, exit_code`` (0 succeeded, 1 with warnings, 2 failed)."""
    flags = outcomes.agg(F.count(F.when(F.col("outcome") == "Failed", 1)).alias("f"),
                         F.count(F.when(F.col("outcome") == "CompletedWithWarnings", 1)).alias("w"))
    failed = F.lit(aborted) | (F.col("f") > 0)
    warned = (F.col("w") > 0) | F.lit(orphans > 0)
    return flags.select(F.when(failed, "Failed").when(warned, "CompletedWithWarnings").otherwise("Succeeded").alias("outcome"),
                        F.when(failed, 2).when(warned, 1).otherwise(0).alias("exit_code"))


def teardown_ids(entities: DataFrame) -> DataFrame:
    """Distinct ``domain, entity, id`` of created and projected rows: what a teardown removes."""
    return (entities.filter(F.col("verb").isin(*CREATING_VERBS) & F.col("id").isNotNull())
            .select("domain", "entity", "id").distinct())


def teardown_order(specs: Sequence[EntitySpec]) -> list[EntitySpec]:
    """Children before the parents they refer to; a cycle falls back to the given order."""
    left, order = list(specs), []
    while left:
        parents = {fk.entity for s in left for fk in s.foreign_keys if fk.entity != s.entity}
        ready = [s for s in left if s.entity not in parents] or left[:1]
        order += ready
        left = [s for s in left if s not in ready]
    return order


def teardown(target: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows that stay, counts)`` for one table; rows already gone are ignored.

    ``ids`` has one column named like the key.
    """
    wanted = ids.select(key).distinct()
    counts = (wanted.join(target.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
              .agg(F.count(F.lit(1)).alias("wanted"), F.count("_there").alias("deleted")))
    return join_per_key(target, wanted, [key], "left_anti"), counts.withColumn("gone", F.col("wanted") - F.col("deleted"))


def orphans(parent_ids: DataFrame, remaining_children: DataFrame, fk: str) -> DataFrame:
    """``id, children``: rows that cannot go because children still refer to them."""
    used = remaining_children.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return parent_ids.select("id").distinct().join(used, "id")


def run_summary(scenarios: DataFrame, entities: DataFrame) -> DataFrame:
    """Per scenario: outcome, seed, created rows, warnings (its own and its rows')."""
    per = entities.groupBy("scenario_seq").agg(
        F.count(F.when(F.col("verb").isin(*CREATING_VERBS), 1)).alias("created"), F.sum(F.size("warnings")).alias("_w"))
    return scenarios.join(per, "scenario_seq", "left").select(
        "scenario_seq", "scenario", "outcome", "seed", F.coalesce("created", F.lit(0)).alias("created"),
        (F.size("warnings") + F.coalesce("_w", F.lit(0))).cast("bigint").alias("warnings"))


def _exact_ms(column: str) -> Column:
    """Durations are summed as decimals, so the total does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(28,6)")).cast("double")


def scenario_duration(entities: DataFrame, bulk: DataFrame) -> DataFrame:
    """``scenario_seq, duration_ms``: entity plus bulk durations."""
    both = entities.select("scenario_seq", "duration_ms").unionByName(bulk.select("scenario_seq", "duration_ms"))
    return both.groupBy("scenario_seq").agg(F.bround(_exact_ms("duration_ms"), 3).alias("duration_ms"))


def suite_rollup(scenarios: DataFrame, entities: DataFrame, run_duration_ms: float) -> DataFrame:
    """``feature, tests, failures, skipped, seconds`` per feature and, with feature null, in total.

    A feature takes the sum of its rows' durations; the total row shows the run's own duration.
    """
    per = entities.groupBy("scenario_seq").agg(F.sum(F.col("duration_ms").cast("decimal(28,6)")).alias("_ms"))
    joined = scenarios.join(per, "scenario_seq", "left")
    rolled = joined.rollup("feature").agg(
        F.count(F.lit(1)).alias("tests"), F.count(F.when(F.col("outcome") == "Failed", 1)).alias("failures"),
        F.count(F.when(F.col("outcome") == "Skipped", 1)).alias("skipped"),
        F.coalesce(F.sum("_ms").cast("double"), F.lit(0.0)).alias("_ms"), F.grouping("feature").alias("_total"))
    ms = F.when(F.col("_total") == 1, F.lit(float(run_duration_ms))).otherwise(F.col("_ms"))
    return rolled.select("feature", "tests", "failures", "skipped", F.bround(ms / 1000, 3).alias("seconds"))


def findings(violations: DataFrame, unmatched: DataFrame, scenarios: DataFrame, entities: DataFrame,
             rule_prefix: str = "RUN") -> DataFrame:
    """``rule_id, level, message, scenario_seq, line``: everything a reviewer should see.

    0001 unmatched step, 0002 warning, 0003 failed scenario, 0004 rule violation.
    """
    def rows(df, number, level, message, seq, line):
        return df.select(F.lit(f"{rule_prefix}{number}").alias("rule_id"), F.lit(level).alias("level"), message.alias("message"),
                         seq.cast("bigint").alias("scenario_seq"), line.cast("bigint").alias("line"))

    names = scenarios.select("scenario_seq", "scenario", F.col("line").alias("at"))
    nothing = F.lit(None)
    broken = rows(violations, "0004", "error", F.concat("rule", F.lit(": "), "message"), nothing, F.lit(0))
    strays = rows(join_per_key(unmatched, names, ["scenario_seq"], "inner"), "0001", "warning", F.concat(
        F.lit("no rule for a step of "), "scenario", F.lit(": "), "text"), F.col("scenario_seq"), F.col("line"))
    raised = scenarios.select("scenario_seq", F.explode("warnings").alias("w")).unionByName(
        entities.select("scenario_seq", F.explode("warnings").alias("w")))
    warned = rows(join_per_key(raised, names, ["scenario_seq"], "inner"), "0002", "warning", F.concat(
        "scenario", F.lit(": "), "w"), F.col("scenario_seq"), F.col("at"))
    failed = rows(scenarios.filter(F.col("outcome") == "Failed"), "0003", "error", F.concat(
        "scenario", F.lit(" ended as failed")), F.col("scenario_seq"), F.col("line"))
    return broken.unionByName(strays).unionByName(warned).unionByName(failed)
