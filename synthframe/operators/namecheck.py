"""Names in planned steps that the configured entities do not know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name, singularize
from ..session import scratch_path
from .references import resolve_entity


def _spellings(name):
    return F.array_distinct(F.array(normalize_name(name), normalize_name(singularize(name))))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unknown_names(steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """``kind, name, within, level`` findings, each distinct name once.

    ``steps`` is ``domain_pin, entity, property, ref_target`` (nulls allowed); ``catalog`` is ``domain,
    entity, property``. Unknown domains, entities and reference targets are errors; unknown
    properties and ambiguous entities are warnings.
    """
    def rows(df, kind, name, within, level):
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), within.alias("within"), F.lit(level).alias("level")).distinct()

    nothing = F.lit(None).cast("string")
    # distinct names are few next to the steps; both tables are read once and their names written
    catalog = _written(catalog.distinct(), "names-known")
    steps = _written(steps.select("domain_pin", "entity", "property", "ref_target").distinct(), "names-used")
    domains = catalog.select(F.lower("domain").alias("_d")).distinct()
    pins = steps.filter(F.col("domain_pin").isNotNull()).select("domain_pin").distinct()
    bad_pins = pins.withColumn("_d", F.lower("domain_pin")).join(domains, "_d", "left_anti").select("domain_pin")
    out = rows(bad_pins, "domain", F.col("domain_pin"), nothing, "error")

    named = steps.filter(F.col("entity").isNotNull()).join(bad_pins, "domain_pin", "left_anti")
    asked = named.select(F.col("entity").alias("name"), "domain_pin").distinct()
    resolved = _written(resolve_entity(asked, catalog.select("domain", "entity")), "names-resolved")
    out = out.unionByName(rows(resolved.filter(F.col("status") == "unknown"), "entity", F.col("name"), F.col("domain_pin"), "error"))
    out = out.unionByName(rows(resolved.filter(F.col("status") == "ambiguous"), "ambiguous entity", F.col("name"), F.col("domain_pin"), "warning"))

    # properties are looked up in the resolved entity
    known = catalog.select("domain", "entity", normalize_name(F.col("property")).alias("_p")).distinct()
    props = (named.filter(F.col("property").isNotNull()).select(F.col("entity").alias("name"), "domain_pin", "property").distinct()
             .join(resolved.filter(F.col("status") == "ok").withColumnRenamed("domain_pin", "_pin"), "name")
             .filter(F.col("domain_pin").eqNullSafe(F.col("_pin")))
             .select("domain", "entity", "property").distinct())
    hit = props.withColumn("_p", F.explode(_spellings(F.col("property")))).join(known, ["domain", "entity", "_p"], "left_semi")
    strange = props.join(hit.select("domain", "entity", "property").distinct(), ["domain", "entity", "property"], "left_anti")
    out = out.unionByName(rows(strange, "property", F.col("property"), F.col("entity"), "warning"))

    targets = steps.filter(F.col("ref_target").isNotNull()).select("ref_target").distinct()
    entities = catalog.select(normalize_name(F.col("entity")).alias("_n")).distinct()
    reached = targets.withColumn("_n", F.explode(_spellings(F.col("ref_target")))).join(entities, "_n", "left_semi")
    lost = targets.join(reached.select("ref_target").distinct(), "ref_target", "left_anti")
    return out.unionByName(rows(lost, "reference target", F.col("ref_target"), nothing, "error"))
