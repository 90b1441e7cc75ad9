"""Layered configuration: packs under local settings.

Layers are ``layer`` (local or the pack's name), ``position`` (order of packs), ``kind``, ``name``, ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = "local"


def merge_layers(layers: DataFrame) -> DataFrame:
    """One row per (kind, name in any case): the local one, else the first pack's."""
    rank = F.when(F.col("layer") == LOCAL, -1).otherwise(F.col("position"))
    best = layers.groupBy("kind", F.lower("name").alias("_n")).agg(F.min_by(F.struct("layer", "name", "value"), F.struct(rank, "layer")).alias("b"))
    return best.select("kind", "b.*")


def layer_conflicts(layers: DataFrame) -> DataFrame:
    """Names that two packs define: ``kind, name, packs, first_pack, second_pack``. Local rows never conflict."""
    packs = layers.filter(F.col("layer") != LOCAL)
    return (packs.groupBy("kind", F.lower("name").alias("name"))
            .agg(F.count_distinct("layer").alias("packs"), F.min("layer").alias("first_pack"), F.max("layer").alias("last_pack"))
            .filter(F.col("packs") > 1))


def merge_registries(own: DataFrame, packs: DataFrame) -> DataFrame:
    """``domain, key, source``: a domain's own registry whole, else that of the one pack that has it.

    ``own`` is ``domain, key``; ``packs`` is ``pack, domain, key``. A domain that two packs define is left
    out, for neither may win: see ``registry_conflicts``.
    """
    covered = own.select(F.lower("domain").alias("_d")).distinct()
    open_ = packs.withColumn("_d", F.lower("domain")).join(covered, "_d", "left_anti")
    added = open_.join(registry_conflicts(packs).select(F.col("domain").alias("_d")), "_d", "left_anti")
    return own.select("domain", "key", F.lit("own").alias("source")).unionByName(
        added.select("domain", "key", F.col("pack").alias("source")))


def registry_conflicts(packs: DataFrame) -> DataFrame:
    """Domains for which two packs publish a registry."""
    return (packs.groupBy(F.lower("domain").alias("domain")).agg(
        F.count_distinct("pack").alias("packs"), F.min("pack").alias("first_pack"), F.max("pack").alias("last_pack"))
        .filter(F.col("packs") > 1))


def ordered_union(packs: DataFrame, local: DataFrame) -> DataFrame:
    """Pack rows before local rows; adds ``layer_rank, position`` so that (rank, position, name) is the order.

    ``packs`` is ``position, name, ...``; ``local`` is ``name, ...``.
    """
    first = packs.withColumn("layer_rank", F.lit(0))
    last = local.withColumn("position", F.lit(0).cast(packs.schema["position"].dataType)).withColumn("layer_rank", F.lit(1))
    return first.unionByName(last)
