"""Queries of the streaming section: batch twins for the oracle, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.sinks import write_journal
from ..streaming import streams as st
from . import fixtures as fx
from .base import Registry

reg = Registry()

STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamped(df):
    return df.withColumns({c: F.date_format(c, STAMP) for c in ("window_start", "window_end")})


def _stream(t):
    source = t.events
    rows = t.spark.readStream.schema(source.schema).parquet(f"{t.folder}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def _window_sql(seconds):
    return (f"strftime(to_timestamp(epoch(ts)::BIGINT // {seconds} * {seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, "
            f"strftime(to_timestamp((epoch(ts)::BIGINT // {seconds} + 1) * {seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_end")


_EVENTS_SQL = "(SELECT event_type, value, ts FROM (SELECT event_type, value, date_trunc('second', ts) AS ts FROM events))"

_PROGRESS_SQL = f"SELECT scenario, count(DISTINCT ordinal) AS persisted FROM {fx.JOURNAL_SQL} WHERE kind = 'entity' AND persisted GROUP BY scenario"


@reg.add("str1_journal_stream", _PROGRESS_SQL)
def _(t):
    folder = scratch_path(t.spark, "journal")
    write_journal(fx.journal(t), folder)
    return st.scenario_progress(st.append_to_table(st.persisted_stream(st.journal_stream(t.spark, folder))))


_THROUGHPUT_SQL = f"""
SELECT {_window_sql(3600)}, event_type, count(*) AS rows, round_even(count(*) / CAST(3600 AS DOUBLE), 6) AS rows_per_sec
FROM {_EVENTS_SQL} GROUP BY 1, 2, 3"""


def _throughput(events):
    return st.throughput(events, "ts", ["event_type"], "1 hour")


@reg.add("str2_throughput", _THROUGHPUT_SQL)
def _(t):
    return _stamped(_throughput(t.events))


@reg.add("str2_throughput_stream", _THROUGHPUT_SQL)
def _(t):
    return _stamped(st.stream_metric(_stream(t), "ts", "2 days", _throughput, ["window_start", "window_end", "event_type"]))


_RATIO_SQL = f"""
SELECT {_window_sql(21600)}, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total,
  round_even(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS ratio FROM {_EVENTS_SQL} GROUP BY 1, 2"""


def _ratio(events):
    return st.failure_ratio(events, "ts", F.col("event_type") == "error", "6 hours")


@reg.add("str3_failure_ratio", _RATIO_SQL)
def _(t):
    return _stamped(_ratio(t.events))


@reg.add("str3_failure_ratio_stream", _RATIO_SQL)
def _(t):
    return _stamped(st.stream_metric(_stream(t), "ts", "2 days", _ratio, ["window_start", "window_end"]))


def _p95(events):
    return st.p95_by(events, "ts", "value", "1 day", ["event_type"])


_P95_SQL = f"SELECT {_window_sql(86400)}, event_type, quantile_disc(value, 0.95) AS p95 FROM {_EVENTS_SQL} GROUP BY 1, 2, 3"


@reg.add("str4_p95_by", _P95_SQL)
def _(t):
    return _stamped(_p95(t.events))


@reg.add("str4_p95_by_stream", _P95_SQL)
def _(t):
    """Counts of each value over the stream, and the rank from their table."""
    return _stamped(st.stream_metric(_stream(t), "ts", "2 days", _p95, ["window_start", "window_end", "event_type"]))


@reg.add("str5_failure_alerts", f"SELECT {_window_sql(300)}, count(*) AS failed FROM {_EVENTS_SQL} WHERE event_type = 'error' GROUP BY 1, 2")
def _(t):
    return _stamped(st.failure_alerts(t.events, "ts", F.col("event_type") == "error"))


@reg.add("str5_latency_alerts", """
SELECT strftime(to_timestamp(m * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(to_timestamp(m * 60 + 600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_end, quantile_disc(value, 0.95) AS p95 FROM (
  SELECT value, unnest(range(epoch(date_trunc('second', ts))::BIGINT // 60 - 9, epoch(date_trunc('second', ts))::BIGINT // 60 + 1)) AS m FROM events)
GROUP BY m HAVING quantile_disc(value, 0.95) > 250""")
def _(t):
    return _stamped(st.latency_alerts(t.events, "ts", "value"))
