"""Dense sequence keys over a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_root

_ROWS_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def dense_sequence(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """``name`` = start, start+1, ... in ``order``, which must be unique per row.

    A global window would pull all rows into one task. Here the rows are range-partitioned on the
    order columns and sorted locally; the result is checkpointed, because positions in a
    partition must not move when an executor is lost; then one count per partition (as many rows
    as partitions) turns local positions into global ones.
    """
    scratch_root(df.sparkSession)
    placed = (df.repartitionByRange(*[F.col(c) for c in order])
                .sortWithinPartitions(*order)
                .withColumn("_place", F.monotonically_increasing_id())
                .checkpoint()
                .withColumn("_part", F.shiftright("_place", _ROWS_BITS)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_place").bitwiseAND(F.lit((1 << _ROWS_BITS) - 1))
    # one row per partition: bounded by the partition count, not by the data
    return (placed.join(F.broadcast(offsets), "_part")
                  .withColumn(name, (F.col("_before") + local + F.lit(start)).cast("bigint"))
                  .drop("_part", "_place", "_before"))


def assign_sequence_key(df: DataFrame, order: Sequence[str], name: str, existing: DataFrame | None = None,
                        existing_key: str | None = None, start: int = 1) -> DataFrame:
    """Integer keys as a store would hand them out: after the largest existing key."""
    if existing is not None:
        top = existing.agg(F.max(existing_key or name)).first()[0]
        start = start if top is None else int(top) + 1
    return dense_sequence(df, order, name, start)
