"""Journals of interrupted runs and what a resumed run still has to do.

Journal lines: ``kind, scenario, value, seed, ordinal, entity, verb, id, persisted, at_utc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_per_key

# Outcomes that a resumed run does not repeat.
COMPLETE = ("Succeeded", "CompletedWithWarnings", "Skipped")


def completed_scenarios(journal: DataFrame) -> DataFrame:
    return journal.filter((F.col("kind") == "scenario-complete") & F.col("value").isin(*COMPLETE)).select("scenario").distinct()


def persisted_ordinals(journal: DataFrame) -> DataFrame:
    return (journal.filter((F.col("kind") == "entity") & F.col("persisted") & F.col("ordinal").isNotNull())
            .select("scenario", "ordinal").distinct())


def recorded_seeds(journal: DataFrame) -> DataFrame:
    """``scenario, recorded_seed``: of the last start line, by time and, where times tie or lack, by ``position`` in the file.

    A null seed means that the last start line had none.
    """
    order = F.struct(*[c for c in ("at_utc", "position") if c in journal.columns])
    return (journal.filter(F.col("kind") == "scenario-start").groupBy("scenario")
            .agg(F.max_by(F.struct("seed"), order).alias("_last")).select("scenario", F.col("_last.seed").alias("recorded_seed")))


def resume_plan(plan: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of ``plan`` (``scenario, seed, ordinal, ...``) that still have to run.

    Complete scenarios are skipped whole; persisted ordinals are skipped one by one, unless the
    journal was written under another or an unknown seed, in which case everything of that scenario
    runs again. A scenario without a start line has nothing to compare.
    """
    open_rows = join_per_key(plan, completed_scenarios(journal), ["scenario"], "left_anti")
    seeded = join_per_key(open_rows, recorded_seeds(journal).withColumn("_started", F.lit(True)), ["scenario"])
    same_seed = F.col("_started").isNull() | F.col("recorded_seed").eqNullSafe(F.col("seed"))
    todo = seeded.filter(same_seed).join(persisted_ordinals(journal), ["scenario", "ordinal"], "left_anti")
    return todo.select(*plan.columns).unionByName(seeded.filter(~same_seed).select(*plan.columns))


def persisted_flag(route: Column, warnings: Column) -> Column:
    """Written for real: a route that is not a dry run, and no warning."""
    return route.isNotNull() & (route != "dry-run") & (F.size(warnings) == 0)
