"""Timing analytics: statistics, baselines, comparison, gates, trends.

Samples are ``operation, entity, ms``; statistics are one row per key with
``count, totalMs, meanMs, p50Ms, p95Ms, maxMs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import Rank, nearest_rank, order_statistics, upper_median

# Names of the statistics and the band in which a trend counts as unchanged.
STATS = ("meanMs", "p50Ms", "p95Ms", "maxMs", "totalMs")
TREND_BAND_PCT = 5.0
DIGITS = 3


def bench_stats(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, total, mean, nearest-rank p50 and p95, and max per group, three digits half-even.

    Totals are summed as decimals (to a millionth of a millisecond), so they do not depend on
    the order of rows.
    """
    exact = F.sum(F.col("ms").cast("decimal(28,6)")).cast("double")
    totals = samples.filter(F.col("ms").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.bround(exact, DIGITS).alias("totalMs"),
        F.bround(exact / F.count(F.lit(1)), DIGITS).alias("meanMs"), F.bround(F.max("ms"), DIGITS).alias("maxMs"))
    ranks = order_statistics(samples, by, "ms", [nearest_rank("p50Ms", 50), nearest_rank("p95Ms", 95)])
    return totals.join(ranks, list(by)).select(
        *by, "count", "totalMs", "meanMs", F.bround("p50Ms", DIGITS).alias("p50Ms"), F.bround("p95Ms", DIGITS).alias("p95Ms"), "maxMs")


def empty_stats() -> dict[str, float]:
    """What an operation without samples reports."""
    return {"count": 0, **{s: 0.0 for s in STATS}}


def two_grains(samples: DataFrame) -> DataFrame:
    """``key, ms``: every sample under ``operation`` and under ``operation:entity``."""
    keys = F.array("operation", F.concat("operation", F.lit(":"), "entity"))
    return samples.select(F.explode(keys).alias("key"), "ms").filter(F.col("key").isNotNull())


def bench_two_grains(samples: DataFrame) -> DataFrame:
    return bench_stats(two_grains(samples), ["key"])


def merge_samples(parts: Sequence[DataFrame]) -> DataFrame:
    """Samples of all scenarios as one: percentiles are computed after merging, never averaged."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def median_baseline(stats: DataFrame, key: str = "key") -> DataFrame:
    """Per key and statistic, the midpoint median over the runs that have the key (any case).

    The two middle values are ranked in blocks (see ``order_statistics``), so a long history fills no task.
    """
    names = ["count", *STATS]
    keyed = stats.withColumn("_k", F.lower(key))
    long = keyed.select("_k", F.col(key).alias("_key"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["_k", "_key"], names, "_stat", "_value")
    middle = order_statistics(long, ["_k", "_stat"], "_value", [
        Rank("_low", 0.5, lambda n: F.floor((n + 1) / F.lit(2)).cast("bigint")), upper_median("_high")])
    value = lambda n: F.max(F.when(F.col("_stat") == n, (F.col("_low") + F.col("_high")) / 2))
    medians = middle.groupBy("_k").agg(F.bround(value("count"), 0).cast("bigint").alias("count"), *[F.bround(value(s), DIGITS).alias(s) for s in STATS])
    spelled = keyed.groupBy("_k").agg(F.min(key).alias(key))
    return spelled.join(medians, "_k", "left").drop("_k")


def recent_runs(runs: DataFrame, n: int, env: str | None = None, name: str | None = None) -> DataFrame:
    """The latest ``n`` runs per (env, run_name), names in any case. The limit applies before the shuffle."""
    if env is not None:
        runs = runs.filter(F.lower("env") == env.lower())
    if name is not None:
        runs = runs.filter(F.lower("run_name") == name.lower())
    newest = Window.partitionBy(F.lower("env"), F.lower("run_name")).orderBy(F.desc("started_utc"))
    return runs.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def exclude_current(runs: DataFrame, started: Column) -> DataFrame:
    """A run is never compared with itself."""
    return runs.filter(~F.col("started_utc").eqNullSafe(started))


def pick_stat(stats: DataFrame, name: str) -> DataFrame:
    """Adds ``ms``: the statistic of that name in any case, null for an unknown name."""
    known = {s.lower(): s for s in STATS}
    column = F.col(known[name.lower()]) if name.lower() in known else F.lit(None)
    return stats.withColumn("ms", column.cast("double"))


def stat_column(name: Column) -> Column:
    """The statistic that a column of names asks for, null for unknown names."""
    chain = F.lit(None).cast("double")
    for s in STATS:
        chain = F.when(F.lower(name) == s.lower(), F.col(s)).otherwise(chain)
    return chain


def regression_pct(baseline: Column, current: Column) -> Column:
    """Change in percent, one digit; null without a positive baseline."""
    return F.when(baseline > 0, F.bround((current - baseline) / F.when(baseline > 0, baseline) * 100, 1))


def compare(current: DataFrame, baseline: DataFrame, stat: str = "p95Ms", key: str = "key") -> DataFrame:
    """``key, baseline_ms, current_ms, regression_pct`` for every key of either side (any case)."""
    def side(stats, value):
        picked = pick_stat(stats, stat)
        return picked.groupBy(F.lower(key).alias("_k")).agg(F.min(key).alias(f"_name_{value}"), F.max("ms").alias(value))

    joined = side(current, "current_ms").join(side(baseline, "baseline_ms"), "_k", "full")
    return joined.select(F.coalesce("_name_current_ms", "_name_baseline_ms").alias("key"), "baseline_ms", "current_ms",
                         regression_pct(F.col("baseline_ms"), F.col("current_ms")).alias("regression_pct"))


def gates(current: DataFrame, baseline: DataFrame, rules: DataFrame, key: str = "key") -> DataFrame:
    """Gate results for ``operation, stat, max_regression_pct``.

    Missing data and a baseline without a positive value pass, with the reason.
    """
    def side(stats, prefix):
        return stats.groupBy(F.lower(key).alias("_k")).agg(*[F.max(s).alias(f"{prefix}_{s}") for s in STATS])

    def chosen(prefix):
        chain = F.lit(None).cast("double")
        for s in STATS:
            chain = F.when(F.lower("stat") == s.lower(), F.col(f"{prefix}_{s}")).otherwise(chain)
        return chain

    joined = (rules.withColumn("_k", F.lower("operation")).join(side(current, "c"), "_k", "left").join(side(baseline, "b"), "_k", "left")
              .withColumn("current_ms", chosen("c")).withColumn("baseline_ms", chosen("b")))
    change = regression_pct(F.col("baseline_ms"), F.col("current_ms"))
    known = F.lower("stat").isin(*[s.lower() for s in STATS])
    reason = (F.when(~known, "skipped: unknown stat").when(F.col("current_ms").isNull(), "skipped: not in the current run")
              .when(F.col("baseline_ms").isNull(), "skipped: no baseline data").when(change.isNull(), "skipped: baseline is zero"))
    return joined.select("operation", "stat", "max_regression_pct", "baseline_ms", "current_ms", change.alias("regression_pct"),
                         (reason.isNotNull() | (change <= F.col("max_regression_pct"))).alias("passed"), reason.alias("reason"))


def compare_from_store(stored: DataFrame, env: str, name: str, n: int = 5, stat: str = "p95Ms", rules: DataFrame | None = None) -> DataFrame:
    """The newest published run of (env, name) against the median of the ``n`` runs before it.

    ``stored`` has ``env, run_name, started_utc, key`` and the statistics, as ``sinks.publish_run`` stores them.
    With ``rules`` the gates' results, else the comparison of ``stat``.
    """
    mine = stored.filter((F.lower("env") == env.lower()) & (F.lower("run_name") == name.lower()))
    starts = mine.select("env", "run_name", "started_utc").distinct()
    newest = starts.agg(F.max("started_utc")).scalar()
    earlier = recent_runs(exclude_current(starts, newest), n).select("started_utc")
    current, baseline = mine.filter(F.col("started_utc") == newest), median_baseline(mine.join(earlier, "started_utc", "left_semi"))
    return compare(current, baseline, stat) if rules is None else gates(current, baseline, rules)


def _array_median(values: Column) -> Column:
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(known)
    half = F.floor(n / 2).cast("int")
    odd = F.try_element_at(known, half + 1)
    even = (F.try_element_at(known, F.greatest(half, F.lit(1))) + odd) / 2
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd).otherwise(even)


def trend_series(history: DataFrame, current: DataFrame, n: int = 10, stat: str = "p95Ms") -> DataFrame:
    """Per operation of the current run its last ``n`` values, oldest first, gaps as null.

    ``history`` is ``started_utc, key, <stats>``. Adds the median, the change against it in percent
    and a verdict beyond the band. At most ``n`` values are gathered per operation.
    """
    starts = history.select("started_utc").distinct().orderBy(F.desc("started_utc")).limit(n)
    ordered = starts.agg(F.array_sort(F.collect_list("started_utc"))).scalar()
    picked = pick_stat(history, stat).join(F.broadcast(starts), "started_utc", "left_semi")
    per_key = picked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("started_utc", "ms"))).alias("_at"))
    joined = pick_stat(current, stat).select("key", F.col("ms").alias("current_ms")).join(per_key, "key", "left")
    with_values = joined.withColumn("_runs", ordered).withColumn(
        "values", F.transform("_runs", lambda r: F.try_element_at(F.col("_at"), r)))
    base = with_values.withColumn("baseline_ms", F.bround(_array_median(F.col("values")), DIGITS))
    delta = F.when(F.col("baseline_ms") > 0, (F.col("current_ms") - F.col("baseline_ms")) / F.col("baseline_ms") * 100)
    return base.withColumn("delta_pct", F.bround(delta, 1)).select(
        "key", "values", "baseline_ms", "current_ms", "delta_pct",
        F.when(delta > TREND_BAND_PCT, "worse").when(delta < -TREND_BAND_PCT, "better").alias("verdict"))


def relative_bar(stats: DataFrame) -> DataFrame:
    """Adds ``p50_pct, p95_pct``: shares of the largest p95, which is at least 0.001."""
    top = stats.agg(F.greatest(F.max("p95Ms"), F.lit(0.001))).scalar()
    return (stats.withColumn("_top", top).withColumn("p50_pct", F.bround(F.col("p50Ms") / F.col("_top") * 100, 1))
            .withColumn("p95_pct", F.bround(F.col("p95Ms") / F.col("_top") * 100, 1)).drop("_top"))


def best_chunk(measurements: DataFrame) -> DataFrame:
    """One row ``chunk, rows_per_sec`` with the highest throughput (smaller chunk on a tie)."""
    rate = F.col("rows") / F.greatest(F.col("ms") / 1000, F.lit(0.001))
    rated = measurements.withColumn("rows_per_sec", rate)
    best = rated.agg(F.max_by(F.struct("chunk", "rows_per_sec"), F.struct(F.col("rows_per_sec"), -F.col("chunk"))).alias("b"))
    return best.select("b.chunk", F.bround("b.rows_per_sec", 3).alias("rows_per_sec"))
