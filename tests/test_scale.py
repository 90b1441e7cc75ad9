"""The paths that only large or skewed tables take give the same rows as the plain ones."""

import hashlib
import math
import os
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from check_oracle import compare
from synthframe.operators import lineage as ln, profiling as pr, quantiles as q, records as rc, registry as rg, skew
from synthframe.plans.catalogue import all_queries
from synthframe.streaming import streams as st
from .conftest import SMALL


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which a third carry one key and a tenth none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")))
    return spark.range(6000).select("id", key.alias("k"), (F.col("id") * 37 % 1009).cast("double").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_and_null_keys_are_split_in_joins(spark, how, rows):
    """A key, or the null key, with most rows: the join keeps one scan per side, splits the hot partition and loses nothing."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for hot in ("hot", None):
            many = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 10 < 8, F.lit(hot).cast("string")).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("k"))
            one = spark.createDataFrame([("hot", 1), ("k19", 2), ("k58", 3)], "k string, n int")
            joined = skew.join_per_key(many, one, ["k"], how)
            found = rows(joined)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan or how == "inner" and hot is None or how == "left_semi" and hot is None
            want = {"hot": 1, "k19": 2, "k58": 3}
            keys = [(i, hot if i % 10 < 8 else f"k{i % 400}") for i in range(60_000)]
            assert len(found) == {"left": len(keys), "inner": sum(k in want for _, k in keys), "left_semi": sum(k in want for _, k in keys), "left_anti": sum(k not in want for _, k in keys)}[how]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("blocks", [2, 16, 32])
def test_ranks_equal_sorted_values_with_any_blocks(hot, rows, by, blocks):
    ranks = [q.nearest_rank("p50", 50), q.nearest_rank("p95", 95), q.upper_median("median"), q.Rank("first", 0.0, lambda n: F.least(n, F.lit(3).cast("bigint")))]
    groups = {}
    for r in hot.collect():
        groups.setdefault((r.k,) if by else (), []).append(r.v)
    want = []
    for key, values in groups.items():
        values, n = sorted(values), len(values)
        want.append((*key, values[max(1, -(-n * 50 // 100)) - 1], values[max(1, -(-n * 95 // 100)) - 1], values[n // 2], values[min(n, 3) - 1]))
    assert rows(q.order_statistics(hot, by, "v", ranks, blocks)) == sorted(want, key=str)


def test_ranks_keep_the_type_and_every_digit(spark):
    big = spark.createDataFrame([(9007199254740993,), (9007199254740993,), (9007199254740992,)], "v long")
    assert q.order_statistics(big, [], "v", [q.upper_median("m")]).first()["m"] == 9007199254740993


def test_joins_ranks_and_drift_run_no_job_while_they_are_planned(spark, monkeypatch):
    def touched(*args, **kwargs):
        raise AssertionError("a job while planning")

    for method in ("collect", "first", "head", "take", "count", "isEmpty", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, method, touched)
    for name in all_queries():
        # vrb2 is an assertion about a count; a teardown writes the state of its ids, streams and stored runs are written first
        if name.split("_")[0].rstrip("0123456789") in ("jn", "vrb", "drf", "jrn", "man", "ben", "reg") and name not in ("vrb2_assert_count", "ben10_trend_series", "ben_compare_from_store") and "teardown_run" not in name:
            all_queries()[name](spark, SMALL)


def test_blocked_last_value_equals_a_window(hot, rows):
    seen = hot.select(F.coalesce("k", F.lit("none")).alias("k"), (F.col("id") % 3).alias("major"), "id", F.when(F.col("id") % 4 == 0, F.col("v")).alias("s"))
    blocked = skew.last_before(seen, ["k"], "major", "id", "s", "before", blocks=7)
    whole = seen.withColumn("before", F.last("s", ignorenulls=True).over(
        Window.partitionBy("k").orderBy("major", "id").rowsBetween(Window.unboundedPreceding, -1)))
    assert rows(blocked.select("k", "major", "id", "before")) == rows(whole.select("k", "major", "id", "before"))


def _leases(spark, seconds):
    return spark.range(3000).select(
        F.col("id").alias("lease_id"), F.when(F.col("id") % 2 == 0, "e").alias("environment"), F.lit("d").alias("domain"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("database_id"),
        F.timestamp_seconds(F.col("id") * seconds).alias("acquired_utc"), F.timestamp_seconds(F.col("id") * seconds + F.col("id") * 97 % 900).alias("expires_utc"))


def test_lease_blocks_do_not_matter(spark, rows):
    leases = _leases(spark, 61)
    one = rows(rg.lease_conflicts(leases, 1))
    assert one and rows(rg.lease_conflicts(leases, 7)) == one and rows(rg.lease_conflicts(leases)) == one
    by_hand, top = [], {}
    for r in sorted(leases.collect(), key=lambda r: (r.acquired_utc, r.lease_id)):
        key = (r.environment, r.database_id)
        if top.get(key) and top[key] > r.acquired_utc:
            by_hand.append((r.lease_id, top[key]))
        top[key] = max(top.get(key, r.expires_utc), r.expires_utc)
    assert one == sorted(by_hand, key=str)


def test_lease_sketches_that_answer_differently_each_time_do_not_matter(spark, rows, monkeypatch):
    leases = _leases(spark, 61)
    one, sketch = rows(rg.lease_conflicts(leases, 1)), F.percentile_approx
    moved = F.udf(lambda cuts: sorted(c + uuid.uuid4().int % 20_000_000_000 for c in cuts), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(rg.F, "percentile_approx", lambda *args: moved(sketch(*args)))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # reuse hides a second reading in small plans only
    try:
        assert all(rows(rg.lease_conflicts(leases, 7)) == one for _ in range(3))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_lease_conflicts_with_nulls_ties_and_halves_equal_the_sql(spark, con, tmp_path):
    """The registered query on events without type, user, time or id, on equal times and ids, and on half seconds."""
    start = "timestamp_ntz '2024-01-01 00:00:00'"
    spark.range(400).select(
        F.expr("if(id % 11 = 3, null, id div 3)").alias("event_id"),
        F.expr(f"if(id % 13 = 5, null, {start} + make_dt_interval(0, 0, 0, id div 4))").alias("ts"), F.expr("if(id % 7 = 2, null, id % 2)").alias("user_id"),
        F.expr("if(id % 5 = 1, null, 'view')").alias("event_type"), F.expr("if(id % 17 = 4, null, (id * 29 % 50) / 200D)").alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    other = con.cursor()
    other.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(spark, other, str(tmp_path), "reg3_lease_conflicts")[0] is None


def test_one_busy_day_of_one_database_is_spread(spark):
    busy = _leases(spark, 20).withColumn("environment", F.lit("e")).withColumn("database_id", F.lit("only"))
    assert busy.agg(F.count_distinct(F.to_date("acquired_utc"))).first()[0] == 1
    spread = rg.lease_blocks(busy).repartition(64, "_env", "domain", "database_id", "_block").groupBy("_block", F.spark_partition_id().alias("task")).count()
    assert spread.agg(F.count_distinct("task")).first()[0] >= 8 and spread.agg(F.max("count")).first()[0] < 3000 / 8


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(items, block):
    """The hash tree by hand: row hashes, then levels for any 63-bit ordinal."""
    levels = math.ceil(63 / math.log2(block))
    items = [(n, _sha(t)) for n, t in items]
    for _ in range(levels - 1):
        blocks = {}
        for n, h in sorted(items):
            blocks.setdefault(n // block, []).append(h)
        items = [(b, _sha("\n".join(hs))) for b, hs in blocks.items()]
    return _sha("\n".join(h for _, h in sorted(items)))


def test_hash_tree_by_hand_beyond_three_levels(spark):
    n, block = 5000, 16  # more than 16 ** 3
    df = spark.range(1, n + 1).select(F.lit("a").alias("g"), F.col("id").alias("n"), F.concat(F.lit("row"), F.col("id").cast("string")).alias("t"))
    want = _tree([(i, f"row{i}") for i in range(1, n + 1)], block)
    for parts in (1, 5):
        assert rc.values_hash(df.repartition(parts), ["g"], "n", "t", block=block).first()["values_sha256"] == want
    far = spark.createDataFrame([("a", 5, "x"), ("a", 2**62, "y"), ("b", 0, None)], "g string, n long, t string")
    assert {r["g"]: r["values_sha256"] for r in rc.values_hash(far, ["g"], "n", "t", block=64).collect()} == {"a": _tree([(5, "x"), (2**62, "y")], 64), "b": _tree([(0, "")], 64)}


def test_head_and_tail_leave_the_first_stage_as_a_few_rows(spark):
    rows_ = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("g"), F.col("id").alias("n"), (F.col("id") % 97 == 5).alias("failed"))
    cuts = rc.sample_cuts(rows_.filter("NOT failed"), ["g"], "n", 5)
    plan = cuts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "Partial" in plan
    good = [(("hot" if i % 3 == 0 else "b"), i) for i in range(40_000) if i % 97 != 5]
    for r in cuts.collect():
        own = [i for g, i in good if g == r["g"]]
        assert (r["head_cut"], r["tail_cut"]) == (own[4], own[-5])
    kept = rc.head_tail_sample(rows_, ["g"], "n", "failed", k=3).filter("kept AND NOT failed").groupBy("g").count().collect()
    assert {r["count"] for r in kept} == {6}
    few = spark.createDataFrame([("g", 1, False), ("g", 2, False)], "g string, n long, failed boolean")
    assert rc.head_tail_sample(few, ["g"], "n", "failed").filter("kept").count() == 2


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 100_000, []
    ids = F.concat(F.lit("n"), F.col("id").cast("string"))
    chain = spark.range(n).select(ids.alias("source_id"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("target_id"))
    # a fork at its start, a ring, what runs into the ring, and what forks into both
    extra = spark.createDataFrame([("f", "n0"), ("f", "n99990"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("t", "s"), ("s", "r1"), ("q", "n5"), ("q", "t"), ("n7", None), ("self", "self")], "source_id string, target_id string")
    path = ln.scratch_path
    monkeypatch.setattr(ln, "scratch_path", lambda s, label: tables.append(path(s, label)) or tables[-1])
    depth = ln.lineage_depth(chain.unionByName(extra)).cache()
    rounds = len([d for d in os.listdir(tables[0]) if d.startswith(("jumped-", "reached-"))])
    assert rounds <= 25
    got = {r["node_id"]: (r["depth"], r["cyclic"]) for r in depth.filter("node_id IN ('f', 'n0', 'n99999', 'n100000') OR node_id NOT LIKE 'n%'").collect()}
    never = dict.fromkeys(("r0", "r1", "r2", "s", "t", "q", "self"), (None, True))
    assert got == {"f": (n + 1, False), "n0": (n, False), "n99999": (1, False), "n100000": (0, False)} | never
    assert depth.count() == n + 1 + 8 and depth.filter("cyclic").count() == 7


def test_depth_of_random_graphs(spark):
    r = random.Random(9)
    pairs = [(g, r.randint(0, n), r.randint(0, n)) for g, n in (("u", 60), ("v", 40), ("w", 90)) for _ in range(70)]
    # one graph as it comes, two without circles
    edges = {(f"{g}{x}", f"{g}{y}") if g == "u" else (f"{g}{max(x, y) + 1}", f"{g}{min(x, y)}") for g, x, y in pairs}
    want = {v: 0 for _, v in edges if v not in {a for a, _ in edges}}
    nodes = {x for e in edges for x in e}
    while True:
        ready = {a for a in nodes - set(want) if all(t in want for s, t in edges if s == a)}
        if not ready:
            break
        want |= {a: 1 + max(want[t] for s, t in edges if s == a) for a in ready}
    assert max(want.values()) > 5 and len(want) < len(nodes)
    got = {row["node_id"]: row["depth"] for row in ln.lineage_depth(spark.createDataFrame(sorted(edges), "source_id string, target_id string")).collect()}
    assert got == {v: want.get(v) for v in nodes}


def test_profile_reads_a_table_three_times(spark, monkeypatch):
    scans = []
    write = pr._written
    monkeypatch.setattr(pr, "_written", lambda df, label: scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")) or write(df, label))
    table = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    found = {r["property"]: r for r in pr.profile(table).collect()}
    assert sum(scans[:3]) == 3 and len(found) == len(table.columns)
    exact = table.agg(*[F.count_distinct(c).alias(c) for c in table.columns]).first()
    assert {c: found[c]["distinct"] for c in table.columns} == exact.asDict()
    weights = {r["property"]: r for r in pr.profile(table, approximate=True).collect()}
    assert weights["l_returnflag"]["weights"] == found["l_returnflag"]["weights"] and weights["l_quantity"]["median"] == found["l_quantity"]["median"]


def test_pair_hints_scan_once_and_hold_few_entries(spark):
    table = spark.range(0, 30_000, 1, 4).select(F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("city"), F.concat(F.lit("z"), (F.col("id") % 3).cast("string")).alias("zone"),
                                               F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("kind"), F.col("id").cast("string").alias("unique"))
    assert pr.few_valued(table, table.columns) == ["city", "zone", "kind"]
    got = {(r["left"], r["right"]): r["pairs"] for r in pr.correlation_hints(table, table.columns).collect()}
    assert got == {("city", "zone"): 6}
    for cap in (5, 6):  # the cap counts values, null not among them
        assert (("city", "zone") in {(r["left"], r["right"]) for r in pr.correlation_hints(table, table.columns, cap).collect()}) == (cap >= 6)


def test_sketch_never_drops_a_column_at_the_cap(spark):
    for cap in (1, 10, 100, 1000):
        table = spark.range(5 * cap).select(F.concat(F.lit("v"), (F.col("id") % cap).cast("string")).alias("v"), F.col("id").cast("string").alias("w"))
        assert pr.few_valued(table, ["v", "w"], cap) == ["v"]


def test_alerts_by_panes_equal_ranks_in_windows(spark, rows):
    r = random.Random(4)
    data = [(i, 1_700_000_000 + r.randint(0, 4000), r.choice([None, 250.0, 250.0000001, r.uniform(0, 300), r.uniform(240, 400)])) for i in range(3000)]
    events = spark.createDataFrame(data, "id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    want = st.p95_by(events, "ts", "value", "10 minutes", slide="1 minute").filter("p95 > 250").select("window_start", "window_end", "p95")
    assert rows(st.latency_alerts(events, "ts", "value")) == rows(want) and want.count() > 5
    assert st.latency_alerts(events.limit(0), "ts", "value").collect() == []


def test_filter_reaches_the_scan(spark):
    plan = all_queries()["vrb1_filter_eq"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(o_orderstatus,O)" in plan and "o_totalprice" not in plan
