"""Queries of the conversion and naming section. Raw texts are derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as cv, names as nm
from ..functions.canonical import snapshot_long, values_equal
from .base import Registry

reg = Registry()

NOW = "2024-03-31 15:30:00"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _now():
    return F.lit(NOW).cast("timestamp")


def _stamp(column):
    return F.date_format(column, STAMP)


# Eight spellings of a value of props.k, picked by event_id.
_RAW_SQL = """(SELECT event_id, CASE event_id % 8 WHEN 0 THEN k WHEN 1 THEN 'null' WHEN 2 THEN 'NULL'
  WHEN 3 THEN k || '.50' WHEN 4 THEN 'k' || k WHEN 5 THEN ' ' || k || ' ' WHEN 6 THEN '-' || k ELSE NULL END AS raw
  FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events))"""


def _raw(t):
    k = F.get_json_object("props", "$.k")
    choice = F.col("event_id") % 8
    return t.events.select("event_id", F.when(choice == 0, k).when(choice == 1, "null").when(choice == 2, "NULL")
                           .when(choice == 3, F.concat(k, F.lit(".50"))).when(choice == 4, F.concat(F.lit("k"), k))
                           .when(choice == 5, F.concat(F.lit(" "), k, F.lit(" ")))
                           .when(choice == 6, F.concat(F.lit("-"), k)).alias("raw"))


_INT = "'^[+-]?[0-9]+$'"
_NUM = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@reg.add("cnv1_typed_convert", f"""
SELECT event_id, CASE WHEN regexp_matches(trim(raw), {_INT}) THEN TRY_CAST(trim(raw) AS INTEGER) END AS int_value,
  CASE WHEN lower(raw) <> 'null' AND NOT regexp_matches(trim(raw), {_INT})
       THEN 'Cannot convert "' || raw || '" to int' END AS int_error,
  CASE WHEN regexp_matches(trim(raw), {_NUM}) THEN CAST(TRY_CAST(trim(raw) AS DECIMAL(18,2)) AS DOUBLE) END AS decimal_value,
  CASE WHEN lower(raw) <> 'null' AND NOT regexp_matches(trim(raw), {_NUM})
       THEN 'Cannot convert "' || raw || '" to decimal(18,2)' END AS decimal_error,
  CASE WHEN lower(raw) <> 'null' THEN raw END AS string_value
FROM {_RAW_SQL}""")
def _(t):
    whole, exact, text = (cv.typed_convert(F.col("raw"), x) for x in ("int", "decimal(18,2)", "string"))
    return _raw(t).select(
        "event_id", whole["value"].alias("int_value"), whole["error"].alias("int_error"),
        exact["value"].cast("double").alias("decimal_value"), exact["error"].alias("decimal_error"),
        text["value"].alias("string_value"))


@reg.add("cnv2_null_literal", f"""
SELECT event_id, CASE WHEN lower(raw) = 'null' THEN NULL ELSE raw END AS nullable_value,
  CASE WHEN NOT regexp_matches(trim(raw), {_INT}) THEN 'Cannot convert "' || raw || '" to bigint' END AS required_error
FROM {_RAW_SQL}""")
def _(t):
    return _raw(t).select("event_id", cv.null_literal(F.col("raw")).alias("nullable_value"),
                          cv.typed_convert(F.col("raw"), "bigint", nullable=False)["error"].alias("required_error"))


_TOKEN_SQL = """(SELECT event_id, [ 'today', 'now', 'Today+' || n || 'd', 'now - ' || n || ' w', ' today -' || n || 'M ',
  'NOW+' || n || 'y', 'yesterday', 'today+' || n ][(event_id % 8 + 1)::INT] AS raw,
  (event_id % 8)::INT AS kind, n::INT AS n FROM (SELECT event_id, (event_id % 50)::VARCHAR AS n FROM events))"""


def _tokens(t):
    n = (F.col("event_id") % 50).cast("string")
    spellings = F.array(
        F.lit("today"), F.lit("now"), F.concat(F.lit("Today+"), n, F.lit("d")), F.concat(F.lit("now - "), n, F.lit(" w")),
        F.concat(F.lit(" today -"), n, F.lit("M ")), F.concat(F.lit("NOW+"), n, F.lit("y")), F.lit("yesterday"),
        F.concat(F.lit("today+"), n))
    return t.events.select("event_id", F.element_at(spellings, (F.col("event_id") % 8 + 1).cast("int")).alias("raw"))


@reg.add("cnv3_relative_date", f"""
SELECT event_id, raw, strftime(CASE kind WHEN 0 THEN d WHEN 1 THEN ts WHEN 2 THEN d + to_days(n) WHEN 3 THEN ts - to_days(7 * n)
  WHEN 4 THEN d - to_months(n) WHEN 5 THEN ts + to_years(n) END, '%Y-%m-%d %H:%M:%S.%f') AS resolved
FROM (SELECT *, TIMESTAMP '{NOW}' AS ts, date_trunc('day', TIMESTAMP '{NOW}') AS d FROM {_TOKEN_SQL})""")
def _(t):
    return _tokens(t).select("event_id", "raw", _stamp(cv.relative_date(F.col("raw"), _now())).alias("resolved"))


@reg.add("cnv4_parse_timestamp_utc", f"""
SELECT event_id, strftime(CASE kind WHEN 0 THEN ts WHEN 1 THEN ts - to_hours(2) WHEN 2 THEN date_trunc('day', ts)
   WHEN 3 THEN TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S.%f') AS at_utc,
  strftime(CASE kind WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', TIMESTAMP '{NOW}') END, '%Y-%m-%d') AS on_date
FROM (SELECT event_id, ts, event_id % 5 AS kind FROM events)""")
def _(t):
    kind = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = (F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, F.concat(iso, F.lit("+02:00")))
            .when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).when(kind == 3, "now").otherwise("soon"))
    rows = t.events.select("event_id", raw.alias("raw"))
    at = cv.typed_convert(F.col("raw"), "timestamp", now=_now())
    on = cv.typed_convert(F.col("raw"), "date", now=_now())
    return rows.select("event_id", _stamp(at["value"]).alias("at_utc"), F.date_format(on["value"], "yyyy-MM-dd").alias("on_date"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOTSPECIFIED", "5-LOW")


@reg.add("cnv5_parse_enum", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE replace(o_orderpriority, ' ', '') END AS priority,
  ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOTSPECIFIED', '5-LOW'][(o_orderkey % 7 + 1)::INT] AS by_number FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 10 == 0, "urgent?").otherwise(F.lower("o_orderpriority"))
    number = (F.col("o_orderkey") % 7).cast("string")
    return t.orders.select("o_orderkey", cv.parse_enum(raw, _PRIORITIES).alias("priority"),
                           cv.parse_enum(number, _PRIORITIES).alias("by_number"))


@reg.add("cnv6_parse_scalars", """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||
    substr(h,17,4)||'-'||substr(h,21,12) END AS guid,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
  CASE WHEN hh < 24 THEN lpad(hh::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0') || ':00' END AS time_of_day,
  CASE WHEN hh < 24 THEN CAST(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * ((event_id % 4) * 86400 + hh * 3600 + mi * 60) AS BIGINT)
    END AS span_seconds
FROM (SELECT event_id, md5(event_id::VARCHAR) AS h, event_id % 26 AS hh, event_id % 60 AS mi FROM events)""")
def _(t):
    i = F.col("event_id")
    h = F.md5(i.cast("string"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                         F.substring(h, 21, 12))
    guid = F.when(i % 3 == 0, F.upper(h)).when(i % 3 == 1, F.concat(F.lit("{"), dashed, F.lit("}"))).otherwise(F.substring(h, 2, 31))
    flag = F.when(i % 3 == 0, " True ").when(i % 3 == 1, "FALSE").otherwise("yes")
    clock = F.concat((i % 26).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"))
    span = F.concat(F.when(i % 2 == 0, "-").otherwise(""), (i % 4).cast("string"), F.lit("."), clock)
    rows = t.events.select("event_id", guid.alias("guid"), flag.alias("flag"), clock.alias("clock"), span.alias("span"))
    return rows.select("event_id", cv.parse_guid(F.col("guid")).alias("guid"), cv.parse_bool(F.col("flag")).alias("flag"),
                       cv.parse_time(F.col("clock")).alias("time_of_day"),
                       cv.parse_timespan_seconds(F.col("span")).cast("bigint").alias("span_seconds"))


@reg.add("cnv7_normalize_name", "SELECT p_partkey, lower(translate(p_name || '_' || p_type || '-Key', ' _-', '')) AS name FROM part")
def _(t):
    name = F.concat("p_name", F.lit("_"), "p_type", F.lit("-Key"))
    return t.part.select("p_partkey", nm.normalize_name(name).alias("name"))


_PLURALS = ("Categories", "Boxes", "addresses", "People", "status", "Order Lines", "Invoices", "wolves", "knives",
            "series", "children", "analyses", "Customer", "branches", "days", "heroes")
_SINGULARS = ("Category", "Box", "address", "Person", "status", "Order Line", "Invoice", "wolf", "knife",
              "series", "child", "analysis", "Customer", "branch", "day", "hero")


def _words(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@reg.add("cnv8_singularize", f"""
SELECT p_partkey, p_name || ' ' || {_words(_PLURALS)}[(p_partkey % 16 + 1)::INT] AS plural,
  p_name || ' ' || {_words(_SINGULARS)}[(p_partkey % 16 + 1)::INT] AS singular FROM part""")
def _(t):
    word = F.element_at(F.array(*[F.lit(w) for w in _PLURALS]), (F.col("p_partkey") % 16 + 1).cast("int"))
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(" "), word).alias("plural"))
    return rows.select("p_partkey", "plural", nm.singularize(F.col("plural")).alias("singular"))


@reg.add("cnv9_name_matches", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN false ELSE true END AS matches FROM part""")
def _(t):
    given = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("S")))
              .when(F.col("p_partkey") % 3 == 1, F.translate("p_name", " ", "_")).otherwise(F.concat("p_name", F.lit("x"))))
    return t.part.select("p_partkey", nm.name_matches(given, F.col("p_name")).alias("matches"))


@reg.add("cnv10_strip_pattern", "SELECT p_partkey, p_name AS name, 'entity' AS kept FROM part")
def _(t):
    wrapped = F.concat(F.lit("TBL"), "p_name", F.lit("ENTITY"))
    return t.part.select("p_partkey", nm.strip_pattern(wrapped, "Tbl{Name}Entity").alias("name"),
                         nm.strip_pattern(F.lit("entity"), "{Name}Entity").alias("kept"))


@reg.add("cnv11_expand_pattern", "SELECT p_partkey, 'I' || p_name || 'Repository' AS name FROM part")
def _(t):
    return t.part.select("p_partkey", nm.expand_pattern("I{Name}Repository", F.col("p_name")).alias("name"))


_SNAP_SQL = """
SELECT o_orderkey, 'o_orderstatus' AS property, o_orderstatus AS value FROM orders UNION ALL
SELECT o_orderkey, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL
SELECT o_orderkey, 'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') FROM orders UNION ALL
SELECT o_orderkey, 'o_custkey', CASE WHEN o_custkey % 5 <> 0 THEN o_custkey::VARCHAR END FROM orders"""


@reg.add("cnv12_snapshot", _SNAP_SQL)
def _(t):
    rows = t.orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return snapshot_long(rows, ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey"])


@reg.add("cnv13_values_equal", """
SELECT o_orderkey, CASE (o_orderkey % 11)::INT WHEN 8 THEN false WHEN 9 THEN true WHEN 10 THEN false WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true
  WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN true ELSE false END AS same FROM orders""")
def _(t):
    i = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    key = i.cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    case = i % 11
    recorded = (F.when(case == 0, key).when(case == 1, price).when(case == 2, F.concat(F.lit("007"), key))
                 .when(case == 3, F.concat(iso, F.lit("Z"))).when(case == 4, iso).when(case == 5, key)
                 .when(case == 8, F.lit("0.00000000001")).when(case == 9, F.concat(F.lit("+0"), key, F.lit("."), F.repeat(F.lit("0"), 40), F.lit("10"))).when(case == 10, F.lit("9007199254740993.0")))
    current = (F.when(case == 0, key).when(case == 1, F.concat(price, F.lit("00"))).when(case == 2, F.concat(F.lit("7"), key))
                .when(case == 3, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".0000004")))
                .when(case == 4, F.concat(iso, F.lit(".000001"))).when(case == 7, key)
                .when(case == 8, F.lit("0.00000000002")).when(case == 9, F.concat(key, F.lit("."), F.repeat(F.lit("0"), 40), F.lit("1"))).when(case == 10, F.lit("9007199254740992.0")))
    return t.orders.select("o_orderkey", values_equal(recorded, current).alias("same"))
