"""The reference stage of generation and update: natural keys of other entities to foreign keys.

A reference is looked up in the scenario context first, then in the stored table, then, for an entity of another
domain, computed from its identity rule. Context and table are folded to one row per key before the join, so each
reference costs one join with one partner per row, whatever the two hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import natural_name, uuid5_name
from ..functions.names import normalize_name, singularize
from ..spec import EntitySpec
from .skew import join_per_key

# Where a reference was resolved.
FROM_CONTEXT = "contextBag"
FROM_TABLE = "database"
FROM_IDENTITY = "identityContract"
NOT_FOUND, AMBIGUOUS = "not found", "ambiguous"


@dataclass(frozen=True)
class Reference:
    """``key_column`` of the rows names a row of ``entity``; its id goes to ``fk``.

    ``table`` holds the stored rows of the entity (``natural_key``, ``row_id``), if it is of the same domain.
    ``domain`` names the owner of an entity that is neither stored here nor has to be: its id is computed.
    """

    fk: str
    entity: str
    key_column: str
    table: DataFrame | None = None
    natural_key: str | None = None
    row_id: str | None = None
    domain: str | None = None

    @property
    def outcome(self) -> str:
        """Column with the outcome: ``struct<key, resolved_from, problem>``."""
        return f"{self.fk}_reference"


def reference_for(spec: EntitySpec, entity: str, key_column: str, **where) -> Reference:
    """The reference to ``entity`` over the foreign key that the specification declares for it."""
    fk = spec.foreign_key_for(entity)
    if fk is None:
        raise ValueError(f"{spec.entity}: no foreign key to {entity}")
    return Reference(fk, entity, key_column, **where)


def _known(reference: Reference, context: DataFrame | None) -> DataFrame | None:
    """One row per key: ``_nk, _context, _rows, _stored``; None where nothing can be looked up."""
    sides = []
    if context is not None:
        name = normalize_name(F.col("entity"))
        given, single = (name == normalize_name(n) for n in (F.lit(reference.entity), singularize(F.lit(reference.entity))))
        sides.append(context.filter(given | single).filter(F.col("key").isNotNull()).groupBy(F.col("key").alias("_nk")).agg(
            F.max_by("id", F.when(given, F.col("seq"))).alias("_given"), F.max_by("id", F.when(single, F.col("seq"))).alias("_single"))
            .select("_nk", F.coalesce("_given", "_single").cast("string").alias("_context"), F.lit(0).cast("bigint").alias("_rows"), F.lit(None).cast("string").alias("_stored")))
    if reference.table is not None:
        sides.append(reference.table.filter(F.col(reference.natural_key).isNotNull()).groupBy(F.col(reference.natural_key).cast("string").alias("_nk")).agg(
            F.lit(None).cast("string").alias("_context"), F.count(F.lit(1)).alias("_rows"), F.min(F.col(reference.row_id).cast("string")).alias("_stored")))
    if not sides:
        return None
    both = reduce(DataFrame.unionByName, sides)
    return both if len(sides) == 1 else both.groupBy("_nk").agg(F.max("_context").alias("_context"), F.max("_rows").alias("_rows"), F.max("_stored").alias("_stored"))


def link(df: DataFrame, references: Sequence[Reference], context: DataFrame | None = None) -> DataFrame:
    """``df`` with every reference's foreign key and outcome set.

    ``context`` holds ``entity, key, id, seq`` of the rows that the scenario made so far; of several entries of a key
    the last counts, and the name as given goes before its singular. A null key asks for nothing: the foreign key
    keeps its value, or is null if the rows have none. A key with several stored rows, or with none, leaves the
    foreign key as it was and says so in the outcome.
    """
    for reference in references:
        known = _known(reference, context)
        asked = df.withColumn("_nk", F.col(reference.key_column).cast("string"))
        if known is None:
            asked = asked.withColumns({"_context": F.lit(None).cast("string"), "_rows": F.lit(None).cast("bigint"), "_stored": F.lit(None).cast("string")})
        else:
            asked = join_per_key(asked, known, ["_nk"])
        wanted, several = F.col("_nk").isNotNull(), F.coalesce(F.col("_rows"), F.lit(0)) > 1
        outside: Column = F.lit(None).cast("string")
        if reference.domain is not None:
            outside = F.when(~several, uuid5_name(natural_name(reference.domain, reference.entity, F.col("_nk"))))
        stored = F.when(~several, F.col("_stored"))
        found = F.coalesce("_context", stored, outside)
        source = (F.when(F.col("_context").isNotNull(), FROM_CONTEXT).when(stored.isNotNull(), FROM_TABLE).when(outside.isNotNull(), FROM_IDENTITY))
        problem = F.when(wanted & found.isNull(), F.when(several, AMBIGUOUS).otherwise(NOT_FOUND))
        held = {f.name: f.dataType for f in df.schema.fields}.get(reference.fk)
        value = found if held is None else F.coalesce(found.cast(held), F.col(reference.fk))
        df = asked.withColumns({
            reference.fk: value,
            reference.outcome: F.struct(F.col("_nk").alias("key"), F.when(wanted, source).alias("resolved_from"), problem.alias("problem")),
        }).drop("_nk", "_context", "_rows", "_stored")
    return df


def reference_findings(linked: DataFrame, references: Sequence[Reference], row_id: str) -> DataFrame:
    """``row, entity, key, problem`` for each reference of ``linked`` rows that could not be resolved. Read in one pass."""
    entries = F.array(*[F.struct(F.lit(r.entity).alias("entity"), F.col(r.outcome)["key"].alias("key"), F.col(r.outcome)["problem"].alias("problem")) for r in references])
    return (linked.select(F.col(row_id).alias("row"), F.explode(F.filter(entries, lambda e: e["problem"].isNotNull())).alias("_e"))
            .select("row", "_e.entity", "_e.key", "_e.problem"))
