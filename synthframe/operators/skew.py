"""Joins of many rows to one row per key, and running values of long keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_per_key(rows: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined (left, inner, left_semi, left_anti) to ``per_key``, one row per key at most.

    One join that reads each side once. A key, or the null key, that holds most rows is split at run time
    (adaptive skew joins, see ``session.configure``): with one partner per key only ``rows`` can be skewed,
    and in all these joins Spark splits the left side.
    """
    return rows.join(per_key, list(on), how)


def last_before(df: DataFrame, keys: Sequence[str], major: str, minor: str, value: str, name: str, blocks: int = 32) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of earlier rows of the key, in (major, minor) order.

    The table's positions are cut into ``blocks`` ranges at the quantiles of a sketch of ``major`` (numbers
    that grow with time, so a key's history spreads over them). A window runs inside each block of a key
    and another over the ends of its blocks, so a key that owns most rows is spread over as many tasks
    and brings at most ``blocks`` rows to the second window.
    """
    keys = list(keys)
    cuts = df.agg(F.percentile_approx(major, [i / blocks for i in range(1, blocks)], 1000).alias("_cuts"))
    cut = df.withColumn("_cuts", cuts.scalar()).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(major)))).drop("_cuts")
    place = [*keys, "_block"]
    position = F.struct(major, minor)
    ends = cut.groupBy(*place).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), position)).alias("_end"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*place, F.last("_end", ignorenulls=True).over(over_blocks).alias("_carried"))
    inside = Window.partitionBy(*place).orderBy(major, minor).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    return (local.join(carried, place).withColumn(name, F.coalesce("_local", "_carried"))
            .drop("_block", "_local", "_carried"))
