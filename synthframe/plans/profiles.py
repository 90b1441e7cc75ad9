"""Queries of the profiling section."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as pr
from .base import Registry

reg = Registry()


def _count_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS property, '{kind}' AS type, count(*) AS count, count(*) - count({e}) AS null_count, "
        f"count(DISTINCT {e}) AS \"distinct\" FROM {table}" for c, kind, e in columns)


def _customers(t):
    return t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")))


@reg.add("prf1_profile_counts", _count_sql("customer", [
    ("c_name", "string", "c_name"), ("c_acctbal", "double", "c_acctbal"),
    ("c_mktsegment", "string", "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END")]))
def _(t):
    return pr.profile_counts(_customers(t), ["c_name", "c_acctbal", "c_mktsegment"])


_NUMBERS = (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"))


def _moment_sql(table, c):
    return (f"SELECT '{c}' AS property, round_even(min({c}), 4) AS min, round_even(max({c}), 4) AS max, "
            f"round_even(avg({c}), 4) AS mean, round_even(stddev_pop({c}), 4) AS std_dev, "
            f"(SELECT round_even({c}, 4) FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n "
            f"FROM {table}) WHERE r = n // 2 + 1) AS median FROM {table}")


@reg.add("prf2_profile_moments", " UNION ALL ".join(_moment_sql(a, b) for a, b in _NUMBERS))
def _(t):
    return pr.profile_moments(t.lineitem, [c for _, c in _NUMBERS])


def _skew_sql(table, c):
    return (f"SELECT '{c}' AS property, round_even(avg(power(({c} - m) / s, 3)), 4) AS skewness FROM {table}, "
            f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table})")


@reg.add("prf3_skewness", _skew_sql("events", "value"))
def _(t):
    return pr.skewness(t.events, ["value"])


def _fit_sql(table, c):
    return f"""
SELECT '{c}' AS property, CASE WHEN heavy THEN 'lognormal' ELSE 'normal' END AS distribution,
  round_even(CASE WHEN heavy THEN median ELSE m END, 4) AS mean, round_even(CASE WHEN heavy THEN ls ELSE s END, 4) AS sigma,
  CASE WHEN heavy THEN 0.0::DOUBLE END AS min
FROM (SELECT any_value(m) AS m, any_value(s) AS s, any_value(ls) AS ls, any_value(median) AS median,
    any_value(lo) >= 0 AND avg(power(({c} - m) / s, 3)) > 1 AS heavy
  FROM {table}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, min({c}) AS lo,
      stddev_pop(CASE WHEN {c} > 0 THEN ln({c}) END) AS ls FROM {table}),
    (SELECT {c} AS median FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {table})
     WHERE r = n // 2 + 1))"""


@reg.add("prf4_fit_distribution", _fit_sql("events", "value") + " UNION ALL " + _fit_sql("lineitem", "l_extendedprice"))
def _(t):
    return pr.fit_distribution(t.events, ["value"]).unionByName(pr.fit_distribution(t.lineitem, ["l_extendedprice"]))


@reg.add("prf5_category_weights", """
SELECT 'o_orderstatus' AS property, o_orderstatus AS label, round_even(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS weight
FROM orders GROUP BY o_orderstatus UNION ALL
SELECT 'o_orderpriority', o_orderpriority, round_even(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 4)
FROM orders GROUP BY o_orderpriority""")
def _(t):
    rows = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return pr.category_weights(rows, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@reg.add("prf6_suppress_values", _count_sql("orders", [
    ("o_orderstatus", "string", "o_orderstatus"), ("o_orderpriority", "string", "o_orderpriority")]))
def _(t):
    return pr.profile(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), skip=["o_orderkey"],
                      include_values=False)


@reg.add("prf7_correlation_hints", """
SELECT 'n_name' AS "left", 'r_name' AS "right", pairs FROM (
  SELECT count(DISTINCT n_name) AS a, count(DISTINCT r_name) AS b, count(DISTINCT (n_name, r_name)) AS pairs
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
WHERE a >= 2 AND b >= 2 AND pairs <= greatest(a, b) * 1.2::DOUBLE UNION ALL
SELECT 'n_name', 'c_mktsegment', pairs FROM (
  SELECT count(DISTINCT n_name) AS a, count(DISTINCT c_mktsegment) AS b, count(DISTINCT (n_name, c_mktsegment)) AS pairs
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE pairs <= greatest(a, b) * 1.2::DOUBLE UNION ALL
SELECT 'r_name', 'c_mktsegment', pairs FROM (
  SELECT count(DISTINCT r_name) AS a, count(DISTINCT c_mktsegment) AS b, count(DISTINCT (r_name, c_mktsegment)) AS pairs
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
WHERE pairs <= greatest(a, b) * 1.2::DOUBLE""")
def _(t):
    placed = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return pr.correlation_hints(placed, ["n_name", "r_name", "c_mktsegment"], categorical_max=25)


@reg.add("prf8_to_config", """
SELECT 'Order' AS entity, 'o_orderstatus' AS property, 'weights ' || string_agg(o_orderstatus || '=' ||
  CAST(CAST(w AS DECIMAL(10,4)) AS VARCHAR), ',' ORDER BY o_orderstatus) AS setting
FROM (SELECT o_orderstatus, round_even(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS w FROM orders GROUP BY 1)
UNION ALL SELECT 'Order', 'o_totalprice', 'normal mean=' || CAST(CAST(round_even(avg(o_totalprice), 4) AS DECIMAL(18,4)) AS VARCHAR)
  || ' sigma=' || CAST(CAST(round_even(stddev_pop(o_totalprice), 4) AS DECIMAL(18,4)) AS VARCHAR) FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return pr.config_rows(pr.profile(rows, skip=["o_orderkey"]), "Order")


@reg.add("prf9_merge_profiles", """
SELECT domain, entity, property, "distinct", CASE WHEN entity = 'Account' THEN
  'entity Account is profiled in several domains; kept Billing' END AS warning FROM (
  SELECT 'Billing' AS domain, 'Account' AS entity, 's_acctbal' AS property, count(DISTINCT s_acctbal) AS "distinct" FROM supplier
  UNION ALL SELECT 'Orders', 'Product', 'p_brand', count(DISTINCT p_brand) FROM part)""")
def _(t):
    def tagged(df, domain, entity, column):
        return pr.profile_counts(df, [column]).select(
            F.lit(domain).alias("domain"), F.lit(entity).alias("entity"), "property", "distinct")
    everything = (tagged(t.customer, "Orders", "Account", "c_acctbal").unionByName(tagged(t.supplier, "Billing", "Account", "s_acctbal"))
                  .unionByName(tagged(t.part, "Orders", "Product", "p_brand")))
    return pr.merge_profiles(everything, ["Billing", "Orders"])
