"""Exact order statistics per group, with no large group held in one task.

A group's distinct values are cut into blocks at the quantiles of a sketch. Running counts are taken
inside each block and over the blocks' totals, so a group that owns most rows is spread over as many
tasks as it has blocks. A poor sketch makes uneven blocks, never another result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Blocks of a group, and the sketch's accuracy: a block is off by at most 1 / _ACCURACY of the group.
BLOCKS = 32
_ACCURACY = 1000


@dataclass(frozen=True)
class Rank:
    """A wanted order statistic: 1-based rank as a function of the group's row count."""

    name: str
    fraction: float
    rank: Callable[[Column], Column]


def nearest_rank(name: str, percent: int) -> Rank:
    """The smallest value with at least ``percent`` % of the rows at or below it."""
    return Rank(name, percent / 100.0, lambda n: F.greatest(
        F.floor((n * F.lit(percent) + F.lit(99)) / F.lit(100)).cast("bigint"), F.lit(1).cast("bigint")))


def upper_median(name: str) -> Rank:
    """``sorted[n / 2]``: of two middle values the larger one."""
    return Rank(name, 0.5, lambda n: (F.floor(n / F.lit(2)) + 1).cast("bigint"))


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[Rank], blocks: int = BLOCKS, count: str | None = None) -> DataFrame:
    """``by..., <rank name>...``: one row per group with at least one non-null value, in the value's own type.

    A row stands for as many rows as its ``count`` says, if that column is named.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    held = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    rows = df.select(*held, F.col(value).alias("_v"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("_c")).filter(F.col("_v").isNotNull())
    values = rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", [i / blocks for i in range(1, blocks)], _ACCURACY).alias("_cuts"))
    placed = _with_keys(values, cuts, keys).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")

    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    totals = placed.groupBy(*keys, "_block").agg(F.sum("_c").alias("_t")).withColumn("_upto", F.sum("_t").over(over_blocks))
    totals = totals.withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys)))
    # only the blocks that hold a wanted rank are ranked
    wanted = reduce(lambda a, b: a | b, [_inside(r, "_upto", "_t") for r in ranks])
    hit = totals.filter(wanted).select(*keys, "_block", "_n", (F.col("_upto") - F.col("_t")).alias("_before"))
    near = _with_keys(placed, hit, [*keys, "_block"])
    inside = Window.partitionBy(*keys, "_block").orderBy("_v")
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    out = ranked.groupBy(*keys).agg(*[F.max(F.when(_inside(r, "_upto", "_c"), F.col("_v"))).alias(r.name) for r in ranks])
    return out.withColumnsRenamed(dict(zip(keys, by))) if by else out.drop("_g0")


def _inside(rank: Rank, upto: str, count: str) -> Column:
    """The wanted rank falls into the last ``count`` of the first ``upto`` rows."""
    wanted = rank.rank(F.col("_n"))
    return (wanted <= F.col(upto)) & (wanted > F.col(upto) - F.col(count))


def _with_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which nulls match nulls."""
    other = right.withColumnsRenamed({k: f"{k}_r" for k in on})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on])
    return left.join(other, condition).drop(*[f"{k}_r" for k in on])
