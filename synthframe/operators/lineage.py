"""Lineage of created rows: nodes, counted edges, dependency depth.

References are ``scenario_seq, source_ordinal, target`` (``Entity:key``), ``id, owning_domain, resolved_from``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .records import CREATING_VERBS
from .skew import join_per_key

# Kinds of node ids, and from how many rows on a scenario's entity is one node.
SINGLE, AGGREGATE, OUTSIDE = "ent", "agg", "ext"
AGGREGATE_FROM = 10


def node_of_rows(entities: DataFrame, bulk: DataFrame, threshold: int = AGGREGATE_FROM) -> DataFrame:
    """Created rows with their ``node_id, title, subtitle``.

    A row is its own node, shared with rows of the same key in other scenarios; many rows of one
    entity in a scenario, or a bulk operation, are one node per scenario.
    """
    created = entities.filter(F.col("verb").isin(*CREATING_VERBS)).select("scenario_seq", "ordinal", "domain", "entity", "id", "natural_key")
    group = ["scenario_seq", "_d", "_e"]
    named = created.withColumn("_d", F.lower("domain")).withColumn("_e", F.lower("entity"))
    sizes = named.groupBy(*group).agg(F.count(F.lit(1)).alias("_members"))
    bulks = bulk.groupBy("scenario_seq", F.lower("domain").alias("_d"), F.lower("entity").alias("_e")).agg(F.max("count").alias("_bulk"))
    sizes = sizes.join(bulks, group, "left")
    rows = join_per_key(named, sizes, group)
    many = F.col("_bulk").isNotNull() | (F.col("_members") >= threshold)
    key = F.coalesce("natural_key", "id")
    single = F.coalesce(key, F.concat(F.col("scenario_seq").cast("string"), F.lit("#"), F.col("ordinal").cast("string")))
    node = F.when(many, F.concat_ws(":", F.lit(AGGREGATE), F.col("scenario_seq").cast("string"), "domain", "entity")).otherwise(
        F.concat_ws(":", F.lit(SINGLE), "domain", "entity", single))
    title = F.when(many, F.concat(F.coalesce("_bulk", "_members").cast("string"), F.lit(" × "), "entity")).otherwise(F.col("entity"))
    subtitle = F.when(many | key.isNull(), F.col("domain")).otherwise(F.concat(key, F.lit(" · "), "domain"))
    return rows.select("scenario_seq", "ordinal", "domain", "entity", "id", "natural_key", many.alias("aggregate"),
                       node.alias("node_id"), title.alias("title"), subtitle.alias("subtitle"))


def resolve_targets(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``target_id, external``: the created row by id, else by ``Entity:key``, else an outside node."""
    position = F.struct("scenario_seq", "ordinal")
    by_id = rows.filter(F.col("id") != "").groupBy(F.lower("id").alias("_id")).agg(F.min_by("node_id", position).alias("_by_id"))
    by_key = (rows.filter((F.col("natural_key") != "") & ~F.col("aggregate"))
              .groupBy(F.lower(F.concat("entity", F.lit(":"), "natural_key")).alias("_key")).agg(F.min_by("node_id", position).alias("_by_key")))
    outside = refs.groupBy(F.lower("target").alias("_key")).agg(
        F.min_by(F.concat(F.lit(f"{OUTSIDE}:"), F.coalesce("owning_domain", F.lit("")), F.lit(":"), "target"), position_of_refs()).alias("_outside"))
    found = join_per_key(refs.withColumn("_id", F.lower("id")), by_id, ["_id"])
    found = join_per_key(found.withColumn("_key", F.lower("target")), outside.join(by_key, "_key", "left"), ["_key"])
    known = F.coalesce("_by_id", "_by_key")
    return (found.withColumn("target_id", F.coalesce(known, F.col("_outside"))).withColumn("external", known.isNull())
            .drop("_id", "_key", "_by_id", "_by_key", "_outside"))


def _node_table(entities: DataFrame, bulk: DataFrame, threshold: int) -> DataFrame:
    """``node_of_rows`` as a written table: it is read by id, by key and by position."""
    rows = node_of_rows(entities, bulk, threshold)
    path = scratch_path(rows.sparkSession, "lineage-rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def position_of_refs():
    return F.struct("scenario_seq", "source_ordinal")


def lineage_nodes(entities: DataFrame, bulk: DataFrame, refs: DataFrame, threshold: int = AGGREGATE_FROM) -> DataFrame:
    """``node_id, title, subtitle, domain, external``: created nodes and the outside targets."""
    rows = _node_table(entities, bulk, threshold)
    made = rows.select("node_id", "title", "subtitle", "domain").distinct()  # the node decides its texts
    texts = F.split("target_id", ":", 3)
    beyond = resolve_targets(refs, rows).filter("external").select("target_id").distinct().select(
        "target_id", texts[2].alias("t"), texts[1].alias("d"))
    name = F.when(F.contains("t", F.lit(":")), F.substring_index("t", ":", 1)).otherwise(F.col("t"))
    key = F.when(F.contains("t", F.lit(":")), F.expr("substring(t, instr(t, ':') + 1)")).otherwise("")
    outside = beyond.select(F.col("target_id").alias("node_id"), name.alias("title"),
                            F.when(F.coalesce("d", F.lit("")) != "", F.concat(key, F.lit(" · "), "d")).otherwise(key).alias("subtitle"),
                            F.coalesce("d", F.lit("")).alias("domain"))
    return made.withColumn("external", F.lit(False)).unionByName(outside.withColumn("external", F.lit(True)))


def lineage_edges(entities: DataFrame, bulk: DataFrame, refs: DataFrame, threshold: int = AGGREGATE_FROM) -> DataFrame:
    """``source_id, target_id, label, count``; references without a created source add no edge."""
    rows = _node_table(entities, bulk, threshold)
    sources = rows.select("scenario_seq", F.col("ordinal").alias("source_ordinal"), F.col("node_id").alias("source_id"))
    placed = join_per_key(resolve_targets(refs, rows), sources, ["scenario_seq", "source_ordinal"], "inner")
    return (placed.filter(F.col("source_id") != F.col("target_id"))
            .groupBy("source_id", "target_id", F.col("resolved_from").alias("label")).agg(F.count(F.lit(1)).alias("count")))


def lineage_depth(edges: DataFrame) -> DataFrame:
    """``node_id, depth, cyclic``: the longest path to a node that depends on nothing, however long it is.

    Chains are contracted first: a node that depends on one other node only points past it, and past the next, twice as
    far each round (pointer jumping), so a chain of n nodes takes log2(n) rounds. What is left are nodes that depend on
    several others; they are peeled: one goes when all it depends on has gone, and its depth is then known. What
    cannot go lies on a cycle or depends on one: ``cyclic``, without a depth. Each round writes what is left, so the plan does
    not grow, and a lost executor repeats one round at most. Null ends and repeated edges are ignored.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "lineage")

    def written(df: DataFrame, name: str, *before: str) -> DataFrame:
        """``df`` as a table, read back together with the tables ``before``."""
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(*[f"{root}/{n}" for n in (*before, name)])

    whole = written(edges.select("source_id", "target_id").filter("source_id IS NOT NULL AND target_id IS NOT NULL").distinct(), "edges")
    degrees = written(whole.groupBy(F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("target_id")), "degrees")
    done, stuck = _contracted(degrees.filter("n = 1").select("node_id", "target_id", F.lit(1).cast("bigint").alias("steps")), written)

    # edges of the others, past the chains; an edge into a chain that never ends stays as it is and is never freed
    several = whole.join(degrees.filter("n > 1").select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    jumps = done.select(F.col("node_id").alias("target_id"), F.col("target_id").alias("_end"), "steps")
    left = written(join_per_key(several, jumps, ["target_id"]).select("source_id", F.coalesce("_end", "target_id").alias("target_id"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
                   .groupBy("source_id", "target_id").agg(F.max("steps").alias("steps")), "left-0")
    sinks = whole.select(F.col("target_id").alias("node_id")).distinct().join(degrees.select("node_id"), "node_id", "left_anti")
    last = written(sinks.withColumn("depth", F.lit(0).cast("bigint")), "level-0")
    reached = left.select("source_id", F.lit(0).cast("bigint").alias("depth")).limit(0)
    rounds = 0
    while not last.isEmpty():
        rounds += 1
        gone = last.select(F.col("node_id").alias("target_id"), F.col("depth").alias("_below"))
        hit = join_per_key(left, gone, ["target_id"], "inner").select("source_id", (F.col("_below") + F.col("steps")).alias("depth"))
        rest = written(join_per_key(left, gone, ["target_id"], "left_anti"), f"left-{rounds}")
        best = written(hit.unionByName(reached).groupBy("source_id").agg(F.max("depth").alias("depth")), f"reached-{rounds}")
        waiting = rest.select("source_id").distinct()
        freed = join_per_key(hit.select("source_id").distinct(), waiting, ["source_id"], "left_anti")
        last = written(best.join(freed, "source_id").select(F.col("source_id").alias("node_id"), "depth"), f"level-{rounds}")
        reached = best.join(waiting, "source_id", "left_semi")
        left = rest
    found = spark.read.schema(last.schema).parquet(*[f"{root}/level-{d}" for d in range(rounds + 1)])
    ends = done.select(F.col("target_id").alias("_end"), "node_id", "steps").join(found.select(F.col("node_id").alias("_end"), F.col("depth").alias("_below")), "_end", "left")
    chains = ends.select("node_id", (F.col("_below") + F.col("steps")).alias("depth"))
    never = stuck.select("node_id").unionByName(left.select(F.col("source_id").alias("node_id")).distinct()).withColumn("depth", F.lit(None).cast("bigint"))
    every = found.unionByName(chains).unionByName(never)
    return every.select("node_id", F.col("depth").cast("int").alias("depth"), F.col("depth").isNull().alias("cyclic"))


def _contracted(chain: DataFrame, written) -> tuple[DataFrame, DataFrame]:
    """(done, stuck) of ``node_id, target_id, steps``: nodes that point to the end of their chain, and nodes that run into a circle.

    Only nodes that do not yet point past their chain are carried on; after as many doublings as their number has
    bits, what still points into a chain goes round.
    """
    chain = written(chain, "chain")
    within = chain.select(F.col("node_id").alias("target_id"))
    parts = ["ended-0"]
    done = written(join_per_key(chain, within, ["target_id"], "left_anti").select(chain.columns), parts[0])
    open_ = written(join_per_key(chain, within, ["target_id"], "left_semi").select(chain.columns), "open-0")
    limit = open_.count().bit_length() + 1
    rounds = 0
    while rounds < limit and not open_.isEmpty():
        rounds += 1
        ahead = open_.withColumn("_ended", F.lit(False)).unionByName(done.withColumn("_ended", F.lit(True)))
        ahead = ahead.select(F.col("node_id").alias("target_id"), F.col("target_id").alias("_to"), F.col("steps").alias("_more"), "_ended")
        jumped = written(join_per_key(open_, ahead, ["target_id"], "inner").select(
            "node_id", F.col("_to").alias("target_id"), (F.col("steps") + F.col("_more")).alias("steps"), "_ended"), f"jumped-{rounds}")
        done = written(jumped.filter("_ended").drop("_ended"), f"ended-{rounds}", *parts)
        parts.append(f"ended-{rounds}")
        open_ = jumped.filter("NOT _ended").drop("_ended")
    return done, open_


