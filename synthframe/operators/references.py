"""Foreign keys by natural key: stored parents, scenario context, other domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import natural_name, uuid5_name, uuid5_natural
from ..functions.names import normalize_name, singularize
from ..spec import EntitySpec
from . import generate as gen
from .linking import FROM_CONTEXT, FROM_TABLE
from .skew import join_per_key


def parents_by_key(parent: DataFrame, natural_key: str, row_id: str) -> DataFrame:
    """One row per natural key: ``_nk, _rows, _id``; the id only where the key is unique."""
    return (parent.filter(F.col(natural_key).isNotNull()).groupBy(F.col(natural_key).alias("_nk"))
            .agg(F.count(F.lit(1)).alias("_rows"), F.min(row_id).alias("_only"))
            .select("_nk", "_rows", F.when(F.col("_rows") == 1, F.col("_only")).alias("_id")))


def resolve_fk(child: DataFrame, parent: DataFrame, child_key: str, natural_key: str, row_id: str, fk: str) -> DataFrame:
    """Write the parent's id to ``fk``. Parents are one row per key, so no child row multiplies."""
    found = parents_by_key(parent, natural_key, row_id).select("_nk", "_id")
    base = child.drop(fk) if fk in child.columns else child
    return join_per_key(base.withColumn("_nk", F.col(child_key)), found, ["_nk"]).withColumnRenamed("_id", fk).drop("_nk")


def unresolved_refs(child: DataFrame, parent: DataFrame, child_key: str, natural_key: str) -> DataFrame:
    """Child rows whose key matches no parent."""
    known = parent.select(F.col(natural_key).alias("_nk")).filter(F.col("_nk").isNotNull()).distinct()
    asked = child.filter(F.col(child_key).isNotNull()).withColumn("_nk", F.col(child_key))
    return join_per_key(asked, known, ["_nk"], "left_anti").drop("_nk")


def ambiguous_refs(child: DataFrame, parent: DataFrame, child_key: str, natural_key: str, row_id: str) -> DataFrame:
    """``key, parents, children``: keys with several parents; such references are not linked.

    Children are counted per key before the join.
    """
    doubled = parents_by_key(parent, natural_key, row_id).filter(F.col("_rows") > 1)
    per_key = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("children"))
    return per_key.join(doubled, F.col("key") == F.col("_nk")).select("key", F.col("_rows").alias("parents"), "children")


def self_reference(df: DataFrame, parent_key: str, natural_key: str, row_id: str, fk: str) -> DataFrame:
    """Parent in the same table; a missing parent stays null."""
    return resolve_fk(df, df.select(natural_key, row_id), parent_key, natural_key, row_id, fk)


def external_reference(domain: str, entity: str, key: Column) -> Column:
    """Foreign key into another domain: computed from its identity rule, never joined; null stays null."""
    return uuid5_name(natural_name(domain, entity, key))


def coerce_key(key: Column, target: str) -> Column:
    return key.try_cast(target)


def context_lookup(entries: DataFrame) -> DataFrame:
    """``entity, key, id, seq`` entries -> one per (normalised entity, key): the last registered."""
    return (entries.groupBy(normalize_name(F.col("entity")).alias("_entity"), F.col("key").alias("_key"))
            .agg(F.max_by("id", "seq").alias("_context_id")))


def lookup_in_context(refs: DataFrame, context: DataFrame) -> DataFrame:
    """Adds ``_context_id``: by the entity name as given, else by its singular."""
    out = refs
    for column, name in (("_as_given", F.col("entity")), ("_as_single", singularize(F.col("entity")))):
        asked = out.withColumn("_entity", normalize_name(name)).withColumn("_key", F.col("key"))
        out = join_per_key(asked, context.withColumnRenamed("_context_id", column), ["_entity", "_key"]).drop("_entity", "_key")
    return out.withColumn("_context_id", F.coalesce("_as_given", "_as_single")).drop("_as_given", "_as_single")


def resolve_precedence(refs: DataFrame, entries: DataFrame, table: DataFrame, natural_key: str, row_id: str) -> DataFrame:
    """Scenario context first, then the stored table, else not found.

    ``refs`` (``entity, key, ...``) gain ``id`` and ``resolved_from`` (null = not found).
    """
    with_context = lookup_in_context(refs, context_lookup(entries))
    stored = parents_by_key(table, natural_key, row_id).select("_nk", F.col("_id").alias("_stored_id"))
    return (join_per_key(with_context.withColumn("_nk", F.col("key")), stored, ["_nk"])
            .withColumn("id", F.coalesce("_context_id", "_stored_id"))
            .withColumn("resolved_from", F.when(F.col("_context_id").isNotNull(), FROM_CONTEXT)
                        .when(F.col("_stored_id").isNotNull(), FROM_TABLE))
            .drop("_context_id", "_stored_id", "_nk"))


def seed_projection(keys: DataFrame, existing: DataFrame, plan: gen.GenerationPlan, owner_domain: str,
                    owner_entity: str) -> DataFrame:
    """Read-model rows for external keys (``key, ordinal``), with the owner's derived id.

    A key that has a row already is left alone; a repeated key is seeded once, at its first
    ordinal. The other columns are generated.
    """
    spec: EntitySpec = plan.spec
    wanted = keys.groupBy("key").agg(F.min("ordinal").alias("ordinal"))
    fresh = wanted.join(existing.select(F.col(spec.natural_key).alias("key")).distinct(), "key", "left_anti")
    rows = gen.generate(fresh, plan)
    return (rows.withColumn(spec.natural_key, F.col("key"))
            .withColumn(spec.key, uuid5_natural(owner_domain, owner_entity, F.col("key")))
            .select("ordinal", *[f.name for f in spec.schema.fields]))


def verify_external(refs: DataFrame, owner: DataFrame, ref_id: str, owner_id: str, mode: str = "verify") -> DataFrame:
    """``verify_outcome`` Verified or Failed against the owner's table; other modes do not look."""
    if mode.lower() != "verify":
        return refs.withColumn("verify_outcome", F.lit(None).cast("string"))
    known = owner.select(F.col(owner_id).alias("_owner")).distinct()
    asked = refs.withColumn("_owner", F.col(ref_id))
    return join_per_key(asked, known.withColumn("_there", F.lit(True)), ["_owner"]).withColumn(
        "verify_outcome", F.when(F.col("_there"), "Verified").otherwise("Failed")).drop("_owner", "_there")


def catalog_frame(spark: SparkSession, specs: list[EntitySpec]) -> DataFrame:
    """``domain, entity, property`` of the configured entities: metadata, bounded by the settings."""
    rows = [(s.domain, s.entity, f.name) for s in specs for f in s.schema.fields]
    return spark.createDataFrame(rows, "domain string, entity string, property string")


def resolve_entity(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """``name, domain_pin`` -> ``status`` ok / unknown / ambiguous and the resolved entity.

    A pinned name looks only in its domain. Names match as given or in the singular.
    """
    known = catalog.select("domain", "entity").distinct().withColumn("_n", normalize_name(F.col("entity")))
    spelled = names.select("name", "domain_pin").distinct().withColumn("_n", F.explode(F.array_distinct(F.array(
        normalize_name(F.col("name")), normalize_name(singularize(F.col("name")))))))
    hits = spelled.join(known, "_n").filter(
        F.col("domain_pin").isNull() | (F.lower("domain_pin") == F.lower("domain")))
    found = hits.groupBy("name", "domain_pin").agg(
        F.count_distinct("domain", "entity").alias("matches"), F.min("domain").alias("domain"), F.min("entity").alias("entity"))
    joined = names.select("name", "domain_pin").distinct().alias("w").join(found.alias("f"), (
        F.col("w.name") == F.col("f.name")) & F.col("w.domain_pin").eqNullSafe(F.col("f.domain_pin")), "left")
    one = F.col("matches") == 1
    return joined.select(
        F.col("w.name").alias("name"), F.col("w.domain_pin").alias("domain_pin"),
        F.when(one, "ok").when(F.col("matches") > 1, "ambiguous").otherwise("unknown").alias("status"),
        F.when(one, F.col("domain")).alias("domain"), F.when(one, F.col("entity")).alias("entity"))
