"""Tables of a run registry: latest runs, live leases, lease conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .skew import join_per_key

LATEST = 100


def latest_runs(runs: DataFrame, env: str | None = None, k: int = LATEST) -> DataFrame:
    """The newest ``k`` runs, optionally of one environment."""
    chosen = runs if env is None else runs.filter(F.col("env") == env)
    return chosen.orderBy(F.desc("started_utc"), F.desc("run_id")).limit(k)


def active_leases(leases: DataFrame, now: Column) -> DataFrame:
    return leases.filter(F.col("expires_utc") > now).orderBy("acquired_utc")


def lease_blocks(leases: DataFrame, blocks: int = 32) -> DataFrame:
    """``leases`` with ``_env``, ``_key`` and ``_block``: the time blocks of each (environment, domain, database), nulls being keys.

    Blocks are cut at the quantiles of a sketch of the key's own leases, so a database that took most of its leases in one
    day, or one hour, still fills all its blocks. Leases of one instant stay together. The cuts are written once: what a
    sketch answers depends on the order in which its parts arrive, and whoever reads the blocks twice needs the same ones.
    """
    spark = leases.sparkSession
    rows = leases.withColumn("_env", F.coalesce("environment", F.lit(""))).withColumn("_at", F.unix_micros(F.col("acquired_utc").cast("timestamp")))
    rows = rows.withColumn("_key", F.struct("_env", "domain", "database_id"))
    path = scratch_path(spark, "lease-cuts")
    rows.groupBy("_key").agg(F.percentile_approx("_at", [i / blocks for i in range(1, blocks)], 1000).alias("_cuts")).write.parquet(path)
    cuts = spark.read.parquet(path)
    return join_per_key(rows, cuts, ["_key"], "inner").withColumn("_block", F.size(F.coalesce(F.filter("_cuts", lambda c: c < F.col("_at")), F.array().cast("array<bigint>")))).drop("_cuts", "_at")


def lease_conflicts(leases: DataFrame, blocks: int = 32) -> DataFrame:
    """Leases taken while an earlier one of the same (environment, domain, database) was alive.

    ``lease_id, held_until``: one row per offending lease, however many leases it overlaps. Earlier is by (acquired, id,
    expiry), nulls last; a lease without a time of its own neither offends nor holds. A running maximum of the expiry replaces
    a join of all pairs; it is taken inside time blocks (see ``lease_blocks``) and then over the blocks, so one busy database
    is spread over many tasks.
    """
    rows = lease_blocks(leases.filter(F.col("acquired_utc").isNotNull()), blocks)
    tops = rows.groupBy("_key", "_block").agg(F.max("expires_utc").alias("_top"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_key", "_block", F.max("_top").over(earlier).alias("_carried"))
    order = [F.asc_nulls_last(c) for c in ("acquired_utc", "lease_id", "expires_utc")]
    inside = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_local", F.max("expires_utc").over(inside)).join(carried, ["_key", "_block"])
    return (held.withColumn("held_until", F.greatest("_local", "_carried")).filter(F.col("held_until") > F.col("acquired_utc"))
            .select("lease_id", "held_until"))
