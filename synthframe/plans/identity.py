"""Queries of the identity section."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import uuid5_name, uuid5_natural, uuid5_ordinal
from ..operators.generate import assign_identity
from ..operators.integrity import audit_identity, natural_key_collisions
from ..operators.sequence import assign_sequence_key
from ..spec import EntitySpec
from .base import Registry, sql_uuid5

reg = Registry()

PART = EntitySpec("Orders", "Product", T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("name_key", T.StringType()),
    T.StructField("p_partkey", T.LongType()),
]), key="product_id", natural_key="name_key")


@reg.add("id1_uuid5_name", f"SELECT c_custkey, {sql_uuid5('c_name')} AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", uuid5_name(F.col("c_name")).alias("id"))


@reg.add("id2_uuid5_natural",
         f"""SELECT c_custkey, {sql_uuid5("'Orders|Customer|' || c_name")} AS customer_id FROM customer""")
def _(t):
    return t.customer.select("c_custkey", uuid5_natural("Orders", "Customer", F.col("c_name")).alias("customer_id"))


@reg.add("id3_uuid5_ordinal",
         f"""SELECT event_id, {sql_uuid5("'Ops|Event|' || event_type || '|42|' || event_id::VARCHAR")} AS id FROM events""")
def _(t):
    return t.events.select("event_id", uuid5_ordinal(
        "Ops", "Event", F.col("event_type"), 42, F.col("event_id")).alias("id"))


@reg.add("id4_assign_identity", f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'fixed-' || p_partkey::VARCHAR
  WHEN p_size % 5 <> 0 THEN {sql_uuid5("'Orders|Product|' || p_name || ' ' || p_partkey::VARCHAR")}
  ELSE {sql_uuid5("'Orders|Product|load|7|' || p_partkey::VARCHAR")} END AS product_id
FROM part""")
def _(t):
    rows = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
         .otherwise("").alias("name_key"),
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("fixed-"), F.col("p_partkey").cast("string"))).alias("explicit"))
    out = assign_identity(rows, PART, scenario=F.lit("load"), seed=F.lit(7), ordinal=F.col("p_partkey"),
                          override="explicit")
    return out.select("p_partkey", "product_id")


@reg.add("id5_assign_sequence_key", """
SELECT s_suppkey, s_name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_name, s_suppkey) AS id
FROM supplier""")
def _(t):
    return assign_sequence_key(t.supplier.select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], "id",
                               existing=t.nation, existing_key="n_nationkey")


@reg.add("id6_audit_identity", f"""
SELECT o_orderkey, stored_id, derived_id FROM (
  SELECT o_orderkey, {sql_uuid5("'Orders|Order|' || o_orderkey::VARCHAR")} AS derived_id,
    CASE WHEN o_orderkey % 89 = 0 THEN 'moved-' || o_orderkey::VARCHAR
         ELSE {sql_uuid5("'Orders|Order|' || o_orderkey::VARCHAR")} END AS stored_id
  FROM orders) WHERE stored_id <> derived_id""")
def _(t):
    derived = uuid5_natural("Orders", "Order", F.col("o_orderkey").cast("string"))
    stored = t.orders.select("o_orderkey", F.when(
        F.col("o_orderkey") % 89 == 0, F.concat(F.lit("moved-"), F.col("o_orderkey").cast("string")))
        .otherwise(derived).alias("stored_id"))
    return audit_identity(stored, "Orders", "Order", "stored_id", F.col("o_orderkey").cast("string"))


@reg.add("id7_natural_key_collisions", """
SELECT p_name AS natural_key, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return natural_key_collisions(t.part, "p_name")
