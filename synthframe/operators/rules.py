"""Rule checks over planned work. Findings are ``rule, message``.

``steps``: scenario, line, verb, entity, count, inline_rows (null without an inline table);
``scenarios``: scenario, tags array, lifecycle override (null without one).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import singularize


# Names of the rules.
STEP_ROWS = "MaxBulkRowsPerStep"
RUN_ROWS = "MaxCreatedRowsPerRun"
BANNED = "BannedEntities"
TAGS = "RequiredTags"
LIFECYCLES = "AllowedLifecycles"
REGISTRY = "KeyRegistry"
NO_ENVIRONMENT = "UnknownEnvironment"


def _rows():
    return F.coalesce("inline_rows", "count")


def _finding(df: DataFrame, rule: str, *message) -> DataFrame:
    parts = [m if not isinstance(m, str) else F.lit(m) for m in message]
    return df.select(F.lit(rule).alias("rule"), F.concat(*parts).alias("message"))


def max_rows_per_step(steps: DataFrame, limit: int) -> DataFrame:
    big = steps.filter((F.col("verb") == "create") & (_rows() > limit))
    return _finding(big, STEP_ROWS, F.col("scenario"), ": a step asks for ", _rows().cast("string"), " rows of ",
                    F.col("entity"), f"; the limit is {limit}")


def max_rows_total(steps: DataFrame, limit: int) -> DataFrame:
    total = steps.filter(F.col("verb") == "create").agg(F.sum(_rows()).alias("total")).filter(F.col("total") > limit)
    return _finding(total, RUN_ROWS, "all steps ask for ", F.col("total").cast("string"), f" rows; the limit is {limit}")


def banned_entities(steps: DataFrame, banned: Sequence[str], environment: str) -> DataFrame:
    """Any verb, names in any case. The list comes from the settings."""
    hit = steps.filter(F.lower("entity").isin([b.lower() for b in banned]))
    return _finding(hit, BANNED, F.col("scenario"), ": ", F.col("entity"), f" is banned in {environment}")


def required_tags(scenarios: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Each required tag must appear as it is or as a ``tag:`` prefix, in any case."""
    wanted = F.array(*[F.lit(t) for t in tags])
    missing = F.filter(wanted, lambda need: ~F.exists("tags", lambda tag: (
        (F.lower(tag) == F.lower(need)) | F.startswith(F.lower(tag), F.concat(F.lower(need), F.lit(":"))))))
    lacking = scenarios.withColumn("_missing", missing).filter(F.size("_missing") > 0)
    return _finding(lacking, TAGS, F.col("scenario"), ": no tag ", F.array_join("_missing", ", "))


def allowed_lifecycles(scenarios: DataFrame, allowed: Sequence[str]) -> DataFrame:
    outside = scenarios.filter(F.col("lifecycle").isNotNull() & ~F.col("lifecycle").isin(*allowed))
    return _finding(outside, LIFECYCLES, F.col("scenario"), ": lifecycle ", F.col("lifecycle"), f" is not one of {', '.join(allowed)}")


def rule_report(spark: SparkSession, environments: Mapping[str, Mapping], environment: str, steps: DataFrame,
                scenarios: DataFrame) -> DataFrame:
    """All checks that the environment asks for; an unknown environment is a single finding."""
    rules = {name.lower(): r for name, r in environments.items()}.get(environment.lower())
    if rules is None:
        return spark.createDataFrame([(NO_ENVIRONMENT, f"no rules for environment {environment}")], "rule string, message string")
    found = spark.createDataFrame([], "rule string, message string")
    if rules.get("allowed_lifecycles"):
        found = found.unionByName(allowed_lifecycles(scenarios, rules["allowed_lifecycles"]))
    if rules.get("max_rows_per_step") is not None:
        found = found.unionByName(max_rows_per_step(steps, rules["max_rows_per_step"]))
    if rules.get("max_rows_total") is not None:
        found = found.unionByName(max_rows_total(steps, rules["max_rows_total"]))
    if rules.get("banned_entities"):
        found = found.unionByName(banned_entities(steps, rules["banned_entities"], environment))
    if rules.get("required_tags"):
        found = found.unionByName(required_tags(scenarios, rules["required_tags"]))
    return found


def key_registry(refs: DataFrame, keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """External references (``domain, entity, key``) whose key the owner has not published.

    ``keys`` is ``domain, entity, key``, ``patterns`` is ``domain, entity, pattern`` (null = none) with
    one row per governed entity; what is not governed passes. Keys match exactly, patterns as regex.
    """
    def named(df, *columns):
        return df.select(F.lower("domain").alias("_d"), F.lower("entity").alias("_e"), *columns)

    governed = named(patterns, "pattern").groupBy("_d", "_e").agg(F.max("pattern").alias("pattern"))
    asked = refs.withColumn("_d", F.lower("domain")).withColumn("_e", F.lower(singularize(F.col("entity"))))
    # distinct references first: a key that is used often is checked once
    distinct = asked.select("_d", "_e", "key", "domain", "entity").distinct()
    unknown = (distinct.join(governed, ["_d", "_e"]).join(named(keys, "key").distinct(), ["_d", "_e", "key"], "left_anti")
               .filter(~F.coalesce(F.expr("key rlike pattern"), F.lit(False))))
    return _finding(unknown, REGISTRY, F.col("domain"), " has not published ", singularize(F.col("entity")), " ", F.col("key"))
