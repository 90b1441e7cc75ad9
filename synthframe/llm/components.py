"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..session import scratch_path


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) to (u, v, m): m is the smallest of u and its neighbours v. The minimum is combined before the shuffle."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return pairs.join(smallest, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another one.

    Large-star hangs each node's larger neighbours on its smallest one, small-star does so with the
    smaller ones; a few rounds leave only stars. Each round is a written table in the shared folder, so a
    lost executor repeats one round at most. Null ends, loops and repeated links are ignored.
    """
    spark = edges.sparkSession
    links = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.filter(links[2]).select("u", "v").distinct()
    before = None
    while True:
        path = scratch_path(spark, "components")
        links.write.parquet(path)
        links = spark.read.parquet(path)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        links = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                 .filter("u > v").distinct())
