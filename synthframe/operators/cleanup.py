"""Teardown of a recorded run over all its tables, children before the parents they refer to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..spec import EntitySpec, ForeignKey
from .records import teardown_ids
from .skew import join_per_key

NOT_CONFIGURED = "entity not configured"


@dataclass(frozen=True)
class Teardown:
    """What a teardown leaves behind.

    ``rest`` per ``Domain.Entity`` the rows that stay; ``counts`` one row per table: ``domain, entity, wanted, deleted,
    gone`` (no longer there) and ``orphaned``; ``orphans`` the rows that had to stay: ``domain, entity, id, children,
    reason``; ``warnings`` the bulk operations of which only a sample was recorded.
    """

    rest: dict[str, DataFrame]
    counts: DataFrame
    orphans: DataFrame
    warnings: DataFrame


def _name(spec: EntitySpec) -> str:
    return f"{spec.domain}.{spec.entity}"


def _parents(spec: EntitySpec, specs: Mapping[str, EntitySpec]) -> list[tuple[str, ForeignKey]]:
    return [(target, fk) for fk in spec.foreign_keys if (target := f"{fk.domain or spec.domain}.{fk.entity}") in specs]


def teardown_components(specs: Sequence[EntitySpec]) -> list[list[EntitySpec]]:
    """Children before parents; entities that refer to each other in a circle stand together."""
    known = {_name(s): s for s in specs}
    ahead = {n: {p for p, _ in _parents(s, known)} for n, s in known.items()}
    reach = {n: set(found) for n, found in ahead.items()}
    for _ in known:
        reach = {n: found | {far for p in found for far in reach[p]} for n, found in reach.items()}
    groups: list[list[str]] = []
    for n in known:
        if not any(n in g for g in groups):
            groups.append([m for m in known if m == n or (m in reach[n] and n in reach[m])])
    # a group goes once no group left refers to it
    order: list[list[str]] = []
    while groups:
        ready = [g for g in groups if not any(p in g for o in groups if o is not g for n in o for p in reach[n])]
        order += ready
        groups = [g for g in groups if g not in ready]
    return [[known[n] for n in g] for g in order]


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _united(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))


def _referred(children: Sequence[tuple[DataFrame, ForeignKey, str]]) -> DataFrame:
    """``_id, children``: how many of the given rows refer to each id. Counted before any join."""
    refs = [rows.filter(F.col(fk.column).isNotNull()).select(F.col(fk.column).cast("string").alias("_id")) for rows, fk, _ in children]
    return reduce(DataFrame.unionByName, refs).groupBy("_id").agg(F.count(F.lit(1)).alias("children"))


def teardown_run(entities: DataFrame, bulk: DataFrame, specs: Sequence[EntitySpec], tables: Mapping[str, DataFrame]) -> Teardown:
    """Remove every row that ``entities`` records as created or projected.

    ``tables`` maps ``Domain.Entity`` to the table of each specification. A row that a staying row refers to stays as
    well, and is an orphan; so do its own parents in turn. Where foreign keys form a circle, or a table refers to itself, a row
    stays if a staying row leads to it along foreign keys: rows that only refer to each other all go. Each table is one
    anti-join against ids; the ids' states are written once per table, a circle takes one written round per
    step of its longest chain of staying rows.
    """
    spark = entities.sparkSession
    known = {_name(s): s for s in specs}
    wanted = _written(teardown_ids(entities), "teardown-ids")
    of = F.lower(F.concat_ws(".", "domain", "entity"))
    rest: dict[str, DataFrame] = {}
    counts, orphans = [], []
    for component in teardown_components(specs):
        names = [_name(s) for s in component]
        own = {n: wanted.filter(of == n.lower()).select(F.col("id").alias("_id")).distinct() for n in names}
        keyed = {n: tables[n].withColumn("_id", F.col(known[n].key).cast("string")) for n in names}
        inner = [(n, target, fk) for n in names for target, fk in _parents(known[n], known) if target in names]
        outer = {n: [(rest[c], fk, c) for c in rest for target, fk in _parents(known[c], known) if target == n] for n in names}
        stays = _staying(spark, names, own, keyed, inner, outer) if inner else None
        state = {}
        for n in names:
            there = keyed[n].select("_id").distinct().withColumn("_there", F.lit(True))
            flags = own[n].join(there, "_id", "left")
            if stays is not None:
                flags = flags.join(stays.filter(F.col("entity") == n).select("_id", F.lit(True).alias("_stays")), "_id", "left")
            elif outer[n]:
                flags = flags.join(_referred(outer[n]), "_id", "left").withColumn("_stays", F.col("children").isNotNull())
            else:
                flags = flags.withColumn("_stays", F.lit(False))
            flags = flags.select("_id", F.coalesce("_there", F.lit(False)).alias("_there"), (F.coalesce("_there", F.lit(False)) & F.coalesce("_stays", F.lit(False))).alias("_stays"))
            state[n] = _written(flags, "teardown-state")
            rest[n] = join_per_key(keyed[n], state[n].filter("_there AND NOT _stays").select("_id"), ["_id"], "left_anti").drop("_id")
        for n in names:
            who = [F.lit(known[n].domain).alias("domain"), F.lit(known[n].entity).alias("entity")]
            counts.append(state[n].agg(F.count(F.lit(1)).alias("wanted"), F.count(F.when(F.col("_there") & ~F.col("_stays"), 1)).alias("deleted"),
                                       F.count(F.when(~F.col("_there"), 1)).alias("gone"), F.count(F.when(F.col("_stays"), 1)).alias("orphaned")).select(*who, "*"))
            children = [*outer[n], *((rest[c], fk, c) for c, target, fk in inner if target == n)]
            if children:
                kinds = ", ".join(sorted({c.split(".")[1] for _, _, c in children}))
                orphans.append(state[n].filter("_stays").select("_id").join(_referred(children), "_id").select(
                    *who, F.col("_id").alias("id"), "children", F.concat(F.col("children").cast("string"), F.lit(f" row(s) of {kinds} refer to it")).alias("reason")))
    strange = wanted.filter(~of.isin([n.lower() for n in known]))
    orphans.append(strange.select("domain", "entity", "id", F.lit(None).cast("bigint").alias("children"), F.lit(NOT_CONFIGURED).alias("reason")))
    warnings = bulk.filter(F.col("hashed_rows") > 0).select("scenario_seq", "domain", "entity", "count", "sampled_rows", "hashed_rows", F.concat(
        F.lit("only "), F.col("sampled_rows").cast("string"), F.lit(" of "), F.col("count").cast("string"), F.lit(" "), "entity", F.lit(" rows were recorded one by one and can be removed")).alias("warning"))
    return Teardown(rest, _united(spark, counts, "domain string, entity string, wanted long, deleted long, gone long, orphaned long"),
                    _united(spark, orphans, "domain string, entity string, id string, children long, reason string"), warnings)


def _staying(spark: SparkSession, names: Sequence[str], own: Mapping[str, DataFrame], keyed: Mapping[str, DataFrame],
             inner: Sequence[tuple[str, str, ForeignKey]], outer: Mapping[str, list]) -> DataFrame:
    """``entity, _id`` of the wanted rows of a circle that staying rows lead to."""
    def ends(rows: DataFrame, target: str, fk: ForeignKey) -> DataFrame:
        return rows.filter(F.col(fk.column).isNotNull()).select(F.lit(target).alias("entity"), F.col(fk.column).cast("string").alias("_id"))

    node = "entity string, _id string"
    wanted = _united(spark, [own[n].select(F.lit(n).alias("entity"), "_id") for n in names], node)
    kept = {n: keyed[n].join(own[n], "_id", "left_anti") for n in names}
    seeds = [ends(kept[n], target, fk) for n, target, fk in inner] + [ends(rows, n, fk) for n in names for rows, fk, _ in outer[n]]
    edges = [keyed[n].join(own[n], "_id", "left_semi").filter(F.col(fk.column).isNotNull()).select(
        F.lit(n).alias("_child"), F.col("_id").alias("_from"), F.lit(target).alias("entity"), F.col(fk.column).cast("string").alias("_id")) for n, target, fk in inner]
    edges = _written(reduce(DataFrame.unionByName, edges), "teardown-edges")
    frontier = _written(_united(spark, seeds, node).distinct().join(wanted, ["entity", "_id"], "left_semi"), "teardown-front")
    found = frontier
    while not frontier.isEmpty():
        came = frontier.select(F.col("entity").alias("_child"), F.col("_id").alias("_from"))
        step = edges.join(came, ["_child", "_from"], "left_semi").select("entity", "_id").distinct()
        frontier = _written(step.join(wanted, ["entity", "_id"], "left_semi").join(found, ["entity", "_id"], "left_anti"), "teardown-front")
        found = found.unionByName(frontier)
    return found
