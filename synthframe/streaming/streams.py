"""Incremental journals and metrics.

Every metric is one function of a DataFrame, batch or streaming: the batch result over the same
rows is what a finished stream must show.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import nearest_rank, order_statistics
from ..session import scratch_path
from ..sources.readers import JOURNAL_SCHEMA

# Alert windows and budget.
FAILURE_WINDOW = "5 minutes"
LATENCY_WINDOW, LATENCY_SLIDE, LATENCY_BUDGET_MS = "10 minutes", "1 minute", 250.0


@dataclass(frozen=True)
class Counted:
    """A metric over a stream in two steps: counts by ``keys`` that the stream keeps, and a batch step over their table."""

    counts: DataFrame
    keys: Sequence[str]
    finish: Callable[[DataFrame], DataFrame]

    def filter(self, condition: Column) -> Counted:
        return Counted(self.counts, self.keys, lambda table: self.finish(table).filter(condition))


def _bounds(df: DataFrame, dims: Sequence[str], *values) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *dims, *values)


def throughput(events: DataFrame, time: str, dims: Sequence[str], window: str) -> DataFrame:
    """``window_start, window_end, dims..., rows, rows_per_sec`` per tumbling window."""
    counted = events.groupBy(F.window(time, window).alias("w"), *dims).agg(F.count(F.lit(1)).alias("rows"))
    seconds = F.unix_seconds(F.col("window_end").cast("timestamp")) - F.unix_seconds(F.col("window_start").cast("timestamp"))
    return _bounds(counted, dims, "rows").withColumn("rows_per_sec", F.bround(F.col("rows") / seconds, 6))


def failure_ratio(events: DataFrame, time: str, failed, window: str, dims: Sequence[str] = ()) -> DataFrame:
    """``..., failed, total, ratio`` per tumbling window: failed / (created + failed)."""
    counted = events.groupBy(F.window(time, window).alias("w"), *dims).agg(
        F.count(F.when(failed, 1)).alias("failed"), F.count(F.lit(1)).alias("total"))
    return _bounds(counted, dims, "failed", "total").withColumn("ratio", F.bround(F.col("failed") / F.col("total"), 6))


def p95_by(events: DataFrame, time: str, value: str, window: str, dims: Sequence[str] = (), slide: str | None = None) -> DataFrame | Counted:
    """``..., p95``, exact; over a stream from the counts of each value, which ``stream_metric`` brings to a table."""
    placed = F.window(time, window, slide) if slide else F.window(time, window)
    group, rank = ["window_start", "window_end", *dims], [nearest_rank("p95", 95)]
    if events.isStreaming:
        found = events.filter(F.col(value).isNotNull()).groupBy(placed.alias("w"), *dims, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
        return Counted(_bounds(found, dims, "_value", "_rows"), [*group, "_value"], lambda table: order_statistics(table, group, "_value", rank, count="_rows"))
    framed = events.withColumn("w", placed).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *dims, value)
    return order_statistics(framed, group, value, rank)


def failure_alerts(events: DataFrame, time: str, failed) -> DataFrame:
    """Windows of five minutes with any failure."""
    return failure_ratio(events, time, failed, FAILURE_WINDOW).filter(F.col("failed") > 0).select("window_start", "window_end", "failed")


def latency_alerts(events: DataFrame, time: str, value: str, budget_ms: float = LATENCY_BUDGET_MS) -> DataFrame | Counted:
    """Ten-minute windows, one starting every minute, whose p95 is over the budget.

    Values are counted once, per minute; all values within the budget count as one, since they cannot be an alert's
    p95. Sums over ten minutes then say which windows are alerts, and only their counts are laid into windows and ranked.
    """
    pane = F.window(time, LATENCY_SLIDE)
    over = F.greatest(F.col(value).cast("double"), F.lit(float(budget_ms)))
    counts = (events.filter(F.col(value).isNotNull()).groupBy(pane.alias("w"), over.alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
              .select(F.col("w.start").alias("_pane"), "_value", "_rows"))
    finish = lambda table: _over_budget(table, float(budget_ms))
    return Counted(counts, ["_pane", "_value"], finish) if events.isStreaming else finish(counts)


def _over_budget(counts: DataFrame, budget: float) -> DataFrame:
    """Alerts from ``_pane, _value, _rows``, values raised to the budget."""
    minutes = int(LATENCY_WINDOW.split()[0])
    starts = F.transform(F.sequence(F.lit(0), F.lit(minutes - 1)), lambda k: F.col("_pane") - F.make_dt_interval(F.lit(0), F.lit(0), k))

    def windows(panes: DataFrame) -> DataFrame:
        return panes.withColumn("window_start", F.explode(starts))

    rank = nearest_rank("p95", 95)
    totals = counts.groupBy("_pane").agg(F.sum("_rows").alias("_n"), F.sum(F.when(F.col("_value") <= budget, F.col("_rows")).otherwise(0)).alias("_low"))
    sums = windows(totals).groupBy("window_start").agg(F.sum("_n").alias("_n"), F.sum("_low").alias("_low"))
    alerts = sums.filter(F.col("_low") < rank.rank(F.col("_n"))).select("window_start")
    ranked = order_statistics(windows(counts).join(alerts, "window_start", "left_semi"), ["window_start"], "_value", [rank], count="_rows")
    return ranked.select("window_start", (F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("window_end"), "p95")


def run_to_table(metric: DataFrame, keys: Sequence[str], checkpoint: str | None = None, trigger: dict | None = None,
                 path: str | None = None) -> DataFrame:
    """Run a streaming aggregation over what is there now and return its current values.

    Update mode: each micro-batch writes only the groups it changed, in a folder of its own, so a
    repeated batch replaces itself; the last batch of a group holds its value.
    """
    spark = metric.sparkSession
    out = path or scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (metric.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*metric.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    values = [c for c in metric.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Journal lines as they are appended; broken lines and lines without a scenario are ignored."""
    lines = spark.readStream.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    return lines.withColumnRenamed("atUtc", "at_utc").filter(F.col("scenario").isNotNull())


def persisted_stream(lines: DataFrame) -> DataFrame:
    """``scenario, ordinal`` of every line that records a persisted row, however late it comes.

    The stream keeps no state and drops nothing; a reader of the table removes repeats.
    """
    return lines.filter((F.col("kind") == "entity") & F.col("persisted") & F.col("ordinal").isNotNull()).select("scenario", "ordinal")


def append_to_table(rows: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an append-mode stream over what is there now into Parquet and read it back."""
    spark = rows.sparkSession
    out = path or scratch_path(spark, "stream")
    query = (rows.writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def scenario_progress(persisted: DataFrame) -> DataFrame:
    """``scenario, persisted`` rows so far."""
    return persisted.distinct().groupBy("scenario").agg(F.count(F.lit(1)).alias("persisted"))


def stream_metric(events: DataFrame, time: str, late: str, metric: Callable[[DataFrame], DataFrame | Counted], keys: Sequence[str]) -> DataFrame:
    """A metric over a stream with a watermark, run to its current values."""
    found = metric(events.withWatermark(time, late))
    return found.finish(run_to_table(found.counts, found.keys)) if isinstance(found, Counted) else run_to_table(found, keys)
