"""Queries of the reference section."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import uuid5_natural
from ..operators import generate as gen, references as rf
from ..spec import EntitySpec
from .base import Registry, sql_draw, sql_pick, sql_uuid5
from ..functions.autofake import CURRENCIES

reg = Registry()

_CUSTOMER_ID_SQL = sql_uuid5("'Orders|Customer|' || c_name")


def customers(t):
    return t.customer.select("c_custkey", "c_name", uuid5_natural("Orders", "Customer", F.col("c_name")).alias("id"))


def order_keys(t, extra=2000):
    """Orders with the name of their customer; every ninth points past the stored customers."""
    key = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    return t.orders.select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0")).alias("customer_name"))


ORDER_KEYS_SQL = """(SELECT o_orderkey, 'Customer#' || lpad(CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 10000000 ELSE o_custkey END::VARCHAR,
  9, '0') AS customer_name FROM orders)"""


@reg.add("jn1_resolve_fk", f"""
SELECT o_orderkey, customer_name, CASE WHEN c_name IS NOT NULL THEN {_CUSTOMER_ID_SQL} END AS customer_id
FROM {ORDER_KEYS_SQL} LEFT JOIN customer ON customer_name = c_name""")
def _(t):
    return rf.resolve_fk(order_keys(t), customers(t), "customer_name", "c_name", "id", "customer_id")


CONTEXT_SQL = """(SELECT lower(CASE WHEN event_id % 2 = 0 THEN 'Customer' ELSE 'Order' END) AS entity,
  'Customer#' || lpad((user_id * 5)::VARCHAR, 9, '0') AS key, event_id, 'ctx-' || event_id::VARCHAR AS id FROM events)"""


def context(t):
    return t.events.select(
        F.when(F.col("event_id") % 2 == 0, "Customer").otherwise("ORDER").alias("entity"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 5).cast("string"), 9, "0")).alias("key"),
        F.col("event_id").alias("seq"), F.concat(F.lit("ctx-"), F.col("event_id").cast("string")).alias("id"))


@reg.add("jn2_resolve_precedence", f"""
SELECT o_orderkey, coalesce(ctx, CASE WHEN c_name IS NOT NULL THEN {_CUSTOMER_ID_SQL} END) AS id,
  CASE WHEN ctx IS NOT NULL THEN 'contextBag' WHEN c_name IS NOT NULL THEN 'database' END AS resolved_from
FROM {ORDER_KEYS_SQL} LEFT JOIN (SELECT key, max_by(id, event_id) AS ctx FROM {CONTEXT_SQL} WHERE entity = 'customer' GROUP BY key)
  ON customer_name = key LEFT JOIN customer ON customer_name = c_name""")
def _(t):
    refs = order_keys(t).select("o_orderkey", F.lit("customers").alias("entity"), F.col("customer_name").alias("key"))
    return rf.resolve_precedence(refs, context(t), customers(t), "c_name", "id").select("o_orderkey", "id", "resolved_from")


@reg.add("jn3_context_lookup", f"""
SELECT c_custkey, id FROM (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'order' ELSE 'part' END AS e
  FROM customer) LEFT JOIN (SELECT entity, key, max_by(id, event_id) AS id FROM {CONTEXT_SQL} GROUP BY entity, key)
  ON e = entity AND c_name = key""")
def _(t):
    refs = t.customer.select("c_custkey", F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "Customers")
                             .when(F.col("c_custkey") % 3 == 1, "or_der").otherwise("Part").alias("entity"))
    return rf.lookup_in_context(refs, rf.context_lookup(context(t))).select("c_custkey", F.col("_context_id").alias("id"))


@reg.add("jn4_unresolved_refs", f"""
SELECT o_orderkey, customer_name FROM {ORDER_KEYS_SQL} WHERE customer_name NOT IN (SELECT c_name FROM customer)""")
def _(t):
    return rf.unresolved_refs(order_keys(t), t.customer, "customer_name", "c_name")


@reg.add("jn5_ambiguous_refs", """
SELECT key, parents, children FROM (SELECT p_name AS key, count(*) AS children FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)
JOIN (SELECT p_name, count(*) AS parents FROM part GROUP BY p_name HAVING count(*) > 1) ON key = p_name""")
def _(t):
    named = t.lineitem.select("l_partkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rf.ambiguous_refs(named, t.part, "p_name", "p_name", "p_partkey")


@reg.add("jn6_self_reference", """
SELECT c.c_custkey, p.c_custkey AS parent_id FROM customer c LEFT JOIN customer p
  ON 'Customer#' || lpad((c.c_custkey // 10 - 1)::VARCHAR, 9, '0') = p.c_name""")
def _(t):
    tree = t.customer.select("c_custkey", "c_name", F.concat(F.lit("Customer#"), F.lpad(
        (F.floor(F.col("c_custkey") / 10) - 1).cast("string"), 9, "0")).alias("parent_name"))
    return rf.self_reference(tree, "parent_name", "c_name", "c_custkey", "parent_id").select("c_custkey", "parent_id")


@reg.add("jn7_external_reference", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN {sql_uuid5("'Orders|Customer|' || customer_name")} END AS customer_id FROM {ORDER_KEYS_SQL}""")
def _(t):
    key = F.when(F.col("o_orderkey") % 9 != 0, F.col("customer_name"))
    return order_keys(t).select("o_orderkey", rf.external_reference("Orders", "Customer", key).alias("customer_id"))


SUMMARY = EntitySpec("Billing", "CustomerSummary", T.StructType([
    T.StructField("Id", T.StringType()), T.StructField("Name", T.StringType()), T.StructField("Currency", T.StringType())]),
    key="Id", natural_key="Name")


@reg.add("jn8_seed_projection", f"""
SELECT id, name, currency FROM (
  SELECT {sql_uuid5("'Orders|Customer|' || key")} AS id, key AS name,
    {sql_pick(sql_draw(9, 'Billing|CustomerSummary', 'Currency', 'ordinal'), CURRENCIES)} AS currency
  FROM (SELECT customer_name AS key, min(o_orderkey) AS ordinal FROM {ORDER_KEYS_SQL} GROUP BY 1)
  WHERE key NOT IN (SELECT c_name FROM customer WHERE c_custkey % 4 = 0))""")
def _(t):
    keys = order_keys(t).select(F.col("customer_name").alias("key"), F.col("o_orderkey").alias("ordinal"))
    existing = t.customer.filter(F.col("c_custkey") % 4 == 0).select(F.col("c_name").alias("Name"))
    plan = gen.GenerationPlan(spec=SUMMARY, seed=9)
    return rf.seed_projection(keys, existing, plan, "Orders", "Customer").select(
        F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("Currency").alias("currency"))


@reg.add("jn9_verify_external", f"""
SELECT o_orderkey, CASE WHEN customer_name IN (SELECT c_name FROM customer) THEN 'Verified' ELSE 'Failed' END AS verify_outcome
FROM {ORDER_KEYS_SQL}""")
def _(t):
    refs = order_keys(t).withColumn("ref_id", rf.external_reference("Orders", "Customer", F.col("customer_name")))
    return rf.verify_external(refs, customers(t), "ref_id", "id").select("o_orderkey", "verify_outcome")


@reg.add("jn10_coerce_key", """
SELECT event_id, TRY_CAST(raw AS BIGINT) AS key FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' || user_id::VARCHAR ELSE user_id::VARCHAR END AS raw FROM events)""")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return t.events.select("event_id", rf.coerce_key(raw, "bigint").alias("key"))


_CATALOG_SQL = """(SELECT 'Orders' AS domain, p_name AS entity FROM part WHERE p_name < 'm'
  UNION SELECT 'Stock', p_name FROM part WHERE p_name > 'g')"""


def _catalog(t):
    orders = t.part.filter(F.col("p_name") < "m").select(F.lit("Orders").alias("domain"), F.col("p_name").alias("entity"))
    return orders.unionByName(t.part.filter(F.col("p_name") > "g").select(F.lit("Stock").alias("domain"), F.col("p_name").alias("entity")))


@reg.add("jn11_resolve_entity", f"""
SELECT name, domain_pin, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
  CASE WHEN n = 1 THEN domain END AS domain, CASE WHEN n = 1 THEN entity END AS entity FROM (
  SELECT name, domain_pin, count(c.entity) AS n, min(c.domain) AS domain, min(c.entity) AS entity FROM (
    SELECT DISTINCT p_name AS base, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || 'S' WHEN 1 THEN replace(p_name, ' ', '_') ELSE p_name || '?' END AS name,
      CASE WHEN p_partkey % 2 = 0 THEN 'orders' END AS domain_pin FROM part) w
  LEFT JOIN {_CATALOG_SQL} c ON c.entity = base AND name NOT LIKE '%?' AND (domain_pin IS NULL OR lower(c.domain) = domain_pin)
  GROUP BY name, domain_pin)""")
def _(t):
    i = F.col("p_partkey")
    names = t.part.select(F.when(i % 3 == 0, F.concat(F.upper("p_name"), F.lit("S"))).when(i % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("_")))
                          .otherwise(F.concat("p_name", F.lit("?"))).alias("name"), F.when(i % 2 == 0, "orders").alias("domain_pin"))
    return rf.resolve_entity(names, _catalog(t))
