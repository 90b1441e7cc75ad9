"""Queries of the timing analytics section. Samples are the events: type, user bucket, value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as bn
from ..session import scratch_path
from ..sources.sinks import publish_run
from .base import Registry, dbl

reg = Registry()

_SAMPLES_SQL = "(SELECT event_type AS operation, 'U' || (user_id % 4)::VARCHAR AS entity, value AS ms, date_trunc('day', ts) AS day FROM events)"


def _samples(t):
    return t.events.select(F.col("event_type").alias("operation"), F.concat(F.lit("U"), (F.col("user_id") % 4).cast("string")).alias("entity"),
                           F.col("value").alias("ms"), F.date_trunc("day", "ts").alias("day"))


def _stats_sql(keys, source):
    exact = "CAST(sum(CAST(ms AS DECIMAL(28,6))) AS DOUBLE)"
    return (f"SELECT {keys}, count(*) AS count, round_even({exact}, 3) AS \"totalMs\", round_even({exact} / count(*), 3) AS \"meanMs\", "
            f"round_even(quantile_disc(ms, 0.5), 3) AS \"p50Ms\", round_even(quantile_disc(ms, 0.95), 3) AS \"p95Ms\", "
            f"round_even(max(ms), 3) AS \"maxMs\" FROM {source} GROUP BY {keys}")


@reg.add("ben1_bench_stats", _stats_sql("operation", _SAMPLES_SQL))
def _(t):
    return bn.bench_stats(_samples(t), ["operation"])


_TWO_SQL = f"(SELECT operation AS key, ms, day FROM {_SAMPLES_SQL} UNION ALL SELECT operation || ':' || entity, ms, day FROM {_SAMPLES_SQL})"


@reg.add("ben2_bench_two_grains", _stats_sql("key", _TWO_SQL))
def _(t):
    return bn.bench_two_grains(_samples(t))


_MERGED_SQL = (f"(SELECT operation, ms FROM {_SAMPLES_SQL} UNION ALL SELECT o_orderstatus, o_totalprice / {dbl(1000.0)} FROM orders)")


@reg.add("ben3_merge_samples", _stats_sql("operation", _MERGED_SQL))
def _(t):
    other = t.orders.select(F.col("o_orderstatus").alias("operation"), F.lit("Order").alias("entity"),
                            (F.col("o_totalprice") / F.lit(1000.0)).alias("ms"))
    return bn.bench_stats(bn.merge_samples([_samples(t).drop("day"), other]), ["operation"])


# One run per day; its statistics per operation.
_RUN_STATS_SQL = f"({_stats_sql('day, operation', _SAMPLES_SQL)})"


def _run_stats(t):
    return bn.bench_stats(_samples(t), ["day", "operation"])


def _stored_stats(t):
    """The statistics of all runs, stored: baselines and trends read them several times."""
    store = scratch_path(t.spark, "statistics")
    _run_stats(t).select(F.col("day").alias("started_utc"), F.col("operation").alias("key"), "count", *bn.STATS).write.parquet(store)
    return t.spark.read.parquet(store)


@reg.add("ben4_median_baseline", f"""
SELECT operation, CAST(round_even(quantile_cont(count::DOUBLE, 0.5), 0) AS BIGINT) AS count, {', '.join(
    f'round_even(quantile_cont("{s}", 0.5), 3) AS "{s}"' for s in bn.STATS)} FROM {_RUN_STATS_SQL} GROUP BY operation""")
def _(t):
    return bn.median_baseline(_stored_stats(t).withColumnRenamed("key", "operation"), key="operation")


_RUNS_SQL = """(SELECT date_trunc('day', ts) AS started_utc, CASE WHEN day(ts) % 2 = 0 THEN 'ci' ELSE 'CI' END AS env,
  CASE WHEN day(ts) % 3 = 0 THEN 'Nightly' ELSE 'smoke' END AS run_name, count(*) AS rows FROM events GROUP BY 1, 2, 3)"""


def _runs(t):
    day = F.dayofmonth("ts")
    return t.events.groupBy(
        F.date_trunc("day", "ts").alias("started_utc"), F.when(day % 2 == 0, "ci").otherwise("CI").alias("env"),
        F.when(day % 3 == 0, "Nightly").otherwise("smoke").alias("run_name")).agg(F.count(F.lit(1)).alias("rows"))


def _stamp(df):
    return df.withColumn("started_utc", F.date_format("started_utc", "yyyy-MM-dd HH:mm:ss"))


@reg.add("ben5_recent_runs", f"""
SELECT strftime(started_utc, '%Y-%m-%d %H:%M:%S') AS started_utc, env, run_name, rows FROM {_RUNS_SQL}
QUALIFY row_number() OVER (PARTITION BY lower(env), lower(run_name) ORDER BY started_utc DESC) <= 4""")
def _(t):
    return _stamp(bn.recent_runs(_runs(t), 4))


@reg.add("ben6_exclude_current", f"""
SELECT strftime(started_utc, '%Y-%m-%d %H:%M:%S') AS started_utc, env, run_name, rows FROM {_RUNS_SQL}
WHERE lower(run_name) = 'smoke' AND started_utc <> (SELECT max(started_utc) FROM {_RUNS_SQL} WHERE lower(run_name) = 'smoke')
ORDER BY 1 DESC LIMIT 5""")
def _(t):
    mine = _runs(t)
    newest = mine.filter(F.lower("run_name") == "smoke").agg(F.max("started_utc")).scalar()
    older = bn.exclude_current(mine, newest)
    return _stamp(bn.recent_runs(older, 5, env="Ci", name="SMOKE"))


_HALF_SQL = f"(SELECT operation AS key, ms FROM {_SAMPLES_SQL} WHERE day {{}} TIMESTAMP '2024-01-16')"
_CUR_SQL = f"({_stats_sql('key', _HALF_SQL.format('>='))})"
_BASE_SQL = f"({_stats_sql('key', _HALF_SQL.format('<'))})"


def _half(t, current):
    rows = _samples(t).withColumnRenamed("operation", "key")
    cut = F.lit("2024-01-16").cast("timestamp")
    return bn.bench_stats(rows.filter(F.col("day") >= cut if current else F.col("day") < cut), ["key"])


@reg.add("ben7_compare", f"""
SELECT coalesce(c.key, b.key) AS key, b."p95Ms" AS baseline_ms, c."p95Ms" AS current_ms,
  CASE WHEN b."p95Ms" > 0 THEN round_even((c."p95Ms" - b."p95Ms") / b."p95Ms" * 100, 1) END AS regression_pct
FROM (SELECT * FROM {_CUR_SQL} WHERE key <> 'view') c FULL JOIN (SELECT * FROM {_BASE_SQL} WHERE key <> 'click') b ON c.key = b.key""")
def _(t):
    current = _half(t, True).filter(F.col("key") != "view").withColumn("key", F.col("key"))
    return bn.compare(current, _half(t, False).filter(F.col("key") != "click"))


_NIGHTLY_SQL = f"(SELECT * FROM {_RUN_STATS_SQL} WHERE day(day) % 2 = 0)"
_NEWEST_SQL = f"(SELECT max(day) FROM {_NIGHTLY_SQL})"


@reg.add("ben_compare_from_store", f"""
WITH c AS (SELECT * FROM {_NIGHTLY_SQL} WHERE day = {_NEWEST_SQL}),
b AS (SELECT operation, round_even(quantile_cont("p95Ms", 0.5), 3) AS base FROM {_NIGHTLY_SQL} WHERE day IN (
  SELECT DISTINCT day FROM {_NIGHTLY_SQL} WHERE day <> {_NEWEST_SQL} ORDER BY day DESC LIMIT 5) GROUP BY operation),
r AS (SELECT 'P95Ms' AS stat, 5.0::DOUBLE AS max_regression_pct, c.operation, base AS baseline_ms, "p95Ms" AS current_ms,
  CASE WHEN base > 0 THEN round_even(("p95Ms" - base) / base * 100, 1) END AS regression_pct,
  CASE WHEN base IS NULL THEN 'skipped: no baseline data' END AS reason FROM c LEFT JOIN b ON c.operation = b.operation)
SELECT *, reason IS NOT NULL OR regression_pct <= max_regression_pct AS passed FROM r""")
def _(t):
    runs = _run_stats(t).withColumnsRenamed({"operation": "key", "day": "started_utc"})
    runs = runs.withColumn("env", F.when(F.dayofmonth("started_utc") % 2 == 0, "CI").otherwise("prod")).withColumn("run_name", F.lit("Nightly"))
    store = scratch_path(t.spark, "statistics")
    publish_run(runs, store)
    rules = t.events.select(F.col("event_type").alias("operation")).distinct().select("operation", F.lit("P95Ms").alias("stat"), F.lit(5.0).alias("max_regression_pct"))
    return bn.compare_from_store(t.spark.read.parquet(store), "ci", "nightly", rules=rules)


@reg.add("ben8_gates", f"""
WITH g AS (SELECT DISTINCT event_type AS operation, s.stat, -1.0::DOUBLE AS max_regression_pct FROM events
    CROSS JOIN (VALUES ('P95MS'), ('meanMs'), ('typo')) s(stat) UNION ALL
  SELECT DISTINCT event_type || '?', 'maxMs', 20.0 FROM events),
j AS (SELECT g.*, CASE lower(stat) WHEN 'p95ms' THEN b."p95Ms" WHEN 'meanms' THEN b."meanMs" WHEN 'maxms' THEN b."maxMs" END AS baseline_ms,
  CASE lower(stat) WHEN 'p95ms' THEN c."p95Ms" WHEN 'meanms' THEN c."meanMs" WHEN 'maxms' THEN c."maxMs" END AS current_ms
  FROM g LEFT JOIN {_CUR_SQL} c ON c.key = operation LEFT JOIN (SELECT * FROM {_BASE_SQL} WHERE key <> 'view') b ON b.key = operation),
r AS (SELECT *, CASE WHEN baseline_ms > 0 THEN round_even((current_ms - baseline_ms) / baseline_ms * 100, 1) END AS regression_pct,
  CASE WHEN stat = 'typo' THEN 'skipped: unknown stat' WHEN current_ms IS NULL THEN 'skipped: not in the current run'
    WHEN baseline_ms IS NULL THEN 'skipped: no baseline data' END AS reason FROM j)
SELECT *, reason IS NOT NULL OR regression_pct <= max_regression_pct AS passed FROM r""")
def _(t):
    types = t.events.select("event_type").distinct()
    rules = types.select(F.col("event_type").alias("operation"), F.explode(F.array(F.lit("P95MS"), F.lit("meanMs"), F.lit("typo"))).alias("stat"),
                         F.lit(-1.0).alias("max_regression_pct"))
    rules = rules.unionByName(types.select(F.concat("event_type", F.lit("?")).alias("operation"), F.lit("maxMs").alias("stat"),
                                           F.lit(20.0).alias("max_regression_pct")))
    return bn.gates(_half(t, True), _half(t, False).filter(F.col("key") != "view"), rules)


@reg.add("ben9_pick_stat", f"""
SELECT key, s AS stat, CASE lower(s) WHEN 'p50ms' THEN "p50Ms" WHEN 'totalms' THEN "totalMs" END AS ms
FROM {_CUR_SQL} CROSS JOIN (VALUES ('P50MS'), ('totalms'), ('stdDev')) v(s)""")
def _(t):
    asked = _half(t, True).withColumn("stat", F.explode(F.array(F.lit("P50MS"), F.lit("totalms"), F.lit("stdDev"))))
    return asked.select("key", "stat", bn.stat_column(F.col("stat")).alias("ms"))


_HISTORY_SQL = f"(SELECT * FROM {_RUN_STATS_SQL} WHERE NOT (operation = 'view' AND day(day) % 4 = 0))"


@reg.add("ben10_trend_series", f"""
WITH h AS (SELECT * FROM {_HISTORY_SQL} WHERE day < TIMESTAMP '2024-01-28'),
r AS (SELECT DISTINCT day FROM h ORDER BY day DESC LIMIT 10),
c AS (SELECT operation AS key, "p95Ms" AS current_ms FROM {_RUN_STATS_SQL} WHERE day = TIMESTAMP '2024-01-28'),
x AS (SELECT key, current_ms, r.day, "p95Ms" AS v FROM c CROSS JOIN r LEFT JOIN h ON h.operation = key AND h.day = r.day),
y AS (SELECT key, current_ms, string_agg(coalesce(CAST(CAST(v AS DECIMAL(18,3)) AS VARCHAR), '-'), ' ' ORDER BY day) AS values,
  round_even(quantile_cont(v, 0.5), 3) AS baseline_ms FROM x GROUP BY key, current_ms)
SELECT *, round_even((current_ms - baseline_ms) / baseline_ms * 100, 1) AS delta_pct,
  CASE WHEN (current_ms - baseline_ms) / baseline_ms * 100 > 5 THEN 'worse' WHEN (current_ms - baseline_ms) / baseline_ms * 100 < -5 THEN 'better' END AS verdict
FROM y""")
def _(t):
    stats = _stored_stats(t)
    kept = stats.filter(~((F.col("key") == "view") & (F.dayofmonth("started_utc") % 4 == 0)))
    now = F.lit("2024-01-28").cast("timestamp")
    out = bn.trend_series(kept.filter(F.col("started_utc") < now), stats.filter(F.col("started_utc") == now))
    shown = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("decimal(18,3)").cast("string"), F.lit("-"))), " ")
    return out.withColumn("values", shown)


@reg.add("ben11_relative_bar", f"""
SELECT key, "p50Ms", "p95Ms", round_even("p50Ms" / top * 100, 1) AS p50_pct, round_even("p95Ms" / top * 100, 1) AS p95_pct
FROM {_CUR_SQL}, (SELECT greatest(max("p95Ms"), {dbl(0.001)}) AS top FROM {_CUR_SQL})""")
def _(t):
    return bn.relative_bar(_half(t, True)).select("key", "p50Ms", "p95Ms", "p50_pct", "p95_pct")


@reg.add("ben12_best_chunk", """
SELECT chunk, round_even(rate, 3) AS rows_per_sec FROM (
  SELECT chunk, rows / greatest(ms / 1000, CAST('0.001' AS DOUBLE)) AS rate FROM (
    SELECT 100 * (1 + user_id % 5) AS chunk, count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS ms FROM events GROUP BY 1))
ORDER BY rate DESC, chunk LIMIT 1""")
def _(t):
    measured = t.events.groupBy(((F.col("user_id") % 5 + 1) * 100).alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("ms"))
    return bn.best_chunk(measured)
