"""Sharding by best-fit-decreasing bin packing.

Indivisible groups are sorted by size and enter the bin with the least room that still holds them; bins are kept in a
tree ordered by remaining capacity. Groups of one size follow each other, so what is packed are size classes with exact
counts from Spark: the tightest bin takes as many of a class as it has room for, which is what it would take one by one.
The plan is a list of runs (size, ranks from and to, bin), and each group looks its bin up by its rank among the groups
of its size, which blocks and their offsets give without sorting a class in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..session import scratch_path

#: Ranks of a class that a run is looked up by; a rank has so many runs to compare at most.
RANKS = 64
#: Rows that one numbering task sorts, as a target; more rows make more blocks.
BLOCK_ROWS = 200_000


class CapacityTree:
    """Balanced search tree (a treap) of open bins ordered by (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @dataclass(slots=True)
    class Node:
        key: tuple[int, int]
        weight: int
        left: CapacityTree.Node | None = None
        right: CapacityTree.Node | None = None

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        return ((key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) >> 7) & 0xFFFFFFFFFFFF

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, self.Node(key, self._weight(key))), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the open bin with the least room that is still ``size`` or more."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node.left is not None:
            path.append(node)
            node = node.left
        if path:
            path[-1].left = node.right
        else:
            high = node.right
        self.root = self._merge(low, high)
        return node.key

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low.weight >= high.weight:
            low.right = self._merge(low.right, high)
            return low
        high.left = self._merge(low, high.left)
        return high


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item. An item above the capacity gets a bin of its own; bins are numbered as opened."""
    tree, bins, opened = CapacityTree(), [0] * len(sizes), 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[item])
        if found is None:
            found, opened = (max(capacity, sizes[item]), opened), opened + 1
        bins[item] = found[1]
        tree.insert((found[0] - sizes[item], found[1]))
    return bins


def pack_classes(classes: Sequence[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first rank, end rank, bin) of best-fit-decreasing over (size, count) classes.

    The same bins as ``best_fit_decreasing`` over the single items: of equal items, each enters the bin that the one before
    it left, until that is too small. An item above the capacity has a bin of its own.
    """
    tree, runs, opened = CapacityTree(), [], 0
    for size, count in sorted(classes, reverse=True):
        first = 0
        while first < count:
            found = tree.take_tightest(size)
            if found is None:
                found, opened = (max(capacity, size), opened), opened + 1
            fits = count - first if size == 0 else min(count - first, found[0] // size)
            runs.append((size, first, first + fits, found[1]))
            tree.insert((found[0] - fits * size, found[1]))
            first += fits
    return runs


def pack_classes_evenly(classes: Sequence[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs over bins 0..shards-1 of near equal sums: the least capacity that needs no more than ``shards`` bins.

    Items above the mean of what is left take a bin alone first, for they would set everyone's capacity.
    """
    left = {size: count for size, count in sorted(classes, reverse=True) if count}
    total, free, alone, runs = sum(s * c for s, c in left.items()), shards, 0, []
    for size, count in list(left.items()):
        taken = 0
        while taken < count and free > 1 and size * free > total:
            runs.append((size, taken, taken + 1, alone))
            total, free, alone, taken = total - size, free - 1, alone + 1, taken + 1
        left[size] = count - taken
        if left[size]:
            break
    rest = [(s, c) for s, c in left.items() if c]
    if not rest:
        return runs
    # with room for the mean and one more item, a bin is opened only while all others hold more than the mean
    low = max(rest[0][0], -(-total // free))
    high = max(low, -(-total // free) + rest[0][0])
    while low < high:
        middle = (low + high) // 2
        if max(r[3] for r in pack_classes(rest, middle)) < free:
            high = middle
        else:
            low = middle + 1
    ahead = {size: sum(1 for r in runs if r[0] == size) for size, _ in rest}
    return runs + [(size, first + ahead[size], end + ahead[size], alone + found) for size, first, end, found in pack_classes(rest, low)]


def _packed(rows: DataFrame, key: str, size: str, plan) -> DataFrame:
    """``rows`` with the ``shard`` that ``plan`` (classes to runs) gives their group."""
    spark = rows.sparkSession
    sized = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long")
    groups = _written(rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.sum(sized).alias("_size")), "pack-groups")
    # sizes that differ: their number is at most the root of twice the total, so 14 million for 100 TB
    classes = [(r["_size"], r["n"]) for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    runs = spark.createDataFrame(plan(classes), "_size long, _from long, _to long, shard int")
    step = F.explode(F.sequence(F.floor(F.col("_from") / RANKS), F.floor((F.col("_to") - 1) / RANKS))).alias("_step")
    ranked = number_slots(groups, "_size", ["_key"], "_rank").withColumn("_step", F.floor(F.col("_rank") / RANKS))
    placed = ranked.join(runs.select("*", step), ["_size", "_step"]).filter("_rank >= _from AND _rank < _to").select("_key", "shard")
    placed = _written(placed, "pack-bins")
    return rows.drop("shard").join(placed, F.col(f"`{key}`").eqNullSafe(F.col("_key"))).drop("_key")


def pack_groups(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to shards-1): rows of equal ``key`` stay together, sums of ``size`` near equal.

    Every group is placed by best-fit-decreasing. Null keys are one group; null sizes count as zero; sizes are not negative.
    An empty table gives an empty result. A column ``shard`` of the input is replaced. What returns to the driver is one
    row per different group size.
    """
    return _packed(rows, key, size, lambda classes: pack_classes_evenly(classes, shards))


def pack_to_capacity(rows: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``rows`` with ``shard``: as few shards of at most ``capacity`` as best-fit-decreasing needs (11/9 of the optimum and one, at most).

    A group above the capacity has a shard of its own. Otherwise as ``pack_groups``.
    """
    return _packed(rows, key, size, lambda classes: pack_classes(classes, capacity))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_slots(rows: DataFrame, group: str, order: Sequence[str], name: str = "slot",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``name`` (long): 0, 1, … without gaps within each ``group``.

    A group is cut into blocks by the hash of ``order``, each block is numbered by its own task, and the
    blocks' row counts give the offsets, so that no task sorts a whole group. Rows equal in ``order``
    may swap numbers. There are as many blocks as rows / ``block_rows``. The rows are written once with their block, so
    that counting and numbering see the same.
    """
    held = _written(rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in order])), "slots")
    blocks = max(1, held.count() // block_rows)
    cut = held.withColumn("_block", F.pmod(F.col("_hash"), F.lit(blocks)).cast("int")).drop("_hash")
    counts = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))
            .withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_offset", "_block", "_group", "_of"))
