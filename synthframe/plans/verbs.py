"""Queries of the keyed verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import uuid5_natural
from ..operators import generate as gen, verbs as vb
from ..operators.linking import Reference
from ..session import scratch_path
from .base import Registry, sql_uuid5
from .generation import _STATUS_SQL, _TOTAL_SQL, order_plan

reg = Registry()


@reg.add("vrb1_filter_eq", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def _(t):
    return vb.filter_eq(t.orders, {"o orderstatus": "O", "O_OrderPriority": "1-URGENT"}).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


@reg.add("vrb2_assert_count", """
SELECT 100::BIGINT AS expected, count(*) AS actual, count(*) = 100 AS ok FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R'""")
def _(t):
    return vb.assert_count(t.lineitem, {"l_linenumber": "3", "l_returnflag": "R"}, 100)


_WANTED_SQL = """(SELECT DISTINCT p_name AS key FROM part WHERE p_size <= 25 UNION
  SELECT p_name || ' ' || p_partkey::VARCHAR FROM part WHERE p_partkey % 50 = 0)"""


def _wanted(t):
    return (t.part.filter(F.col("p_size") <= 25).select(F.col("p_name").alias("key"))
            .unionByName(t.part.filter(F.col("p_partkey") % 50 == 0).select(
                F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("key"))))


# p_name plus the one numbered copy of every tenth part: unique, ambiguous and missing keys.
_CATALOG_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_name || ' ' || p_partkey::VARCHAR ELSE p_name END AS name FROM part)"""


def _catalog(t):
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat(
        "p_name", F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("name"))


@reg.add("vrb3_find_by_natural_key", f"""
SELECT key, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
  coalesce(n, 0) AS rows, first_id, last_id FROM {_WANTED_SQL}
LEFT JOIN (SELECT name, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM {_CATALOG_SQL} GROUP BY name) ON key = name""")
def _(t):
    return vb.find_by_natural_key(_catalog(t), _wanted(t), "name", "p_partkey")


@reg.add("vrb4_find_by_id", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    ids = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return vb.find_by_id(t.customer.select("c_custkey", "c_name"), ids, "c_custkey")


@reg.add("vrb5_assert_exists", """
WITH e AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 13 = 0 THEN '?' ELSE '' END AS key,
    CASE c_custkey % 4 WHEN 0 THEN 'c_mktsegment' WHEN 1 THEN 'c_acctbal' WHEN 2 THEN 'tier' END AS property,
    CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment ELSE 'NONE' END
      WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'much' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '0' END
      WHEN 2 THEN 'Gold' END AS expected FROM customer)
SELECT key, property, CASE WHEN property = 'c_acctbal' AND expected <> 'much' THEN
    CAST(CAST(expected AS DOUBLE) AS VARCHAR) ELSE expected END AS expected,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE property WHEN 'c_mktsegment' THEN c_mktsegment
    WHEN 'c_acctbal' THEN CAST(c_acctbal AS VARCHAR) END END AS actual, finding FROM (
  SELECT e.*, c.c_mktsegment, c.c_acctbal, CASE WHEN e.c_custkey % 13 = 0 THEN 'missing row' WHEN property = 'tier' THEN 'unknown property'
    WHEN expected = 'much' THEN 'Cannot convert "much" to double'
    WHEN property = 'c_mktsegment' AND expected <> c.c_mktsegment THEN 'value differs' END AS finding
  FROM e JOIN customer c ON e.c_custkey = c.c_custkey) WHERE finding IS NOT NULL""")
def _(t):
    i = F.col("c_custkey")
    price = F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("0"))
    expectations = t.customer.select(
        F.concat("c_name", F.when(i % 13 == 0, "?").otherwise("")).alias("key"),
        F.when(i % 4 == 0, "c_mktsegment").when(i % 4 == 1, "c_acctbal").when(i % 4 == 2, "tier").alias("property"),
        F.when(i % 4 == 0, F.when(i % 8 == 0, F.col("c_mktsegment")).otherwise("NONE"))
         .when(i % 4 == 1, F.when(i % 3 == 0, "much").otherwise(price)).when(i % 4 == 2, "Gold").alias("expected"))
    return vb.assert_exists(t.customer.select("c_name", "c_mktsegment", "c_acctbal"), expectations, "c_name")


# A batch of order events: the key is an order number, some stored, some new, all repeated.
_BATCH_SQL = """(SELECT event_id, 'ORD-' || (user_id * 40)::VARCHAR AS nk, 'gen-' || event_id::VARCHAR AS note,
  value AS total, CASE WHEN event_type = 'purchase' THEN 'S' WHEN event_type = 'error' THEN 'X' END AS set_status FROM events)"""
_STORED_SQL = """(SELECT o_orderkey, 'ORD-' || CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_orderkey END::VARCHAR AS nk,
  'stored' AS note, o_totalprice AS total, o_orderstatus AS status FROM orders)"""


def _batch(t):
    return t.events.select(
        "event_id", F.concat(F.lit("ORD-"), (F.col("user_id") * 40).cast("string")).alias("nk"),
        F.concat(F.lit("gen-"), F.col("event_id").cast("string")).alias("note"), F.col("value").alias("total"),
        F.lit("N").alias("status"), (-F.col("event_id") - 1).alias("o_orderkey"),
        F.when(F.col("event_type") == "purchase", "S").when(F.col("event_type") == "error", "X").alias("set_status"))


def _stored(t):
    return t.orders.select(
        "o_orderkey", F.concat(F.lit("ORD-"), F.when(F.col("o_orderkey") % 100 == 0, 0).otherwise(F.col("o_orderkey")).cast("string")).alias("nk"),
        F.lit("stored").alias("note"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))


@reg.add("vrb6_create_or_reuse", f"""
WITH b AS (SELECT nk, min_by(note, event_id) AS note, min_by(total, event_id) AS total, -min(event_id) - 1 AS o_orderkey,
    max_by(set_status, event_id) FILTER (set_status IS NOT NULL) AS set_status FROM {_BATCH_SQL} GROUP BY nk),
s AS (SELECT *, count(*) OVER (PARTITION BY nk) AS copies FROM {_STORED_SQL})
SELECT s.o_orderkey, s.nk, s.note, s.total, CASE WHEN copies = 1 THEN coalesce(b.set_status, s.status) ELSE s.status END AS status,
  CASE WHEN copies = 1 AND b.set_status IS NOT NULL THEN 'updated' ELSE 'kept' END AS action FROM s LEFT JOIN b ON s.nk = b.nk
UNION ALL SELECT o_orderkey, nk, note, total, coalesce(set_status, 'N'), 'inserted' FROM b
WHERE nk NOT IN (SELECT nk FROM s WHERE copies = 1)""")
def _(t):
    return vb.create_or_reuse(_stored(t), _batch(t), "nk", ["event_id"], {"status": "set_status"})


@reg.add("vrb7_create_rows", """
SELECT s_suppkey, s_name, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN 'EUR' || s_nationkey::VARCHAR END, 'USD') AS currency,
  true AS active FROM supplier""")
def _(t):
    rows = t.supplier.select("s_suppkey", "s_name", F.when(
        F.col("s_suppkey") % 3 != 0, F.concat(F.lit("EUR"), F.col("s_nationkey").cast("string"))).alias("currency"))
    return vb.create_rows(rows, {"currency": "USD", "active": True})


@reg.add("vrb8_create_n", f"""
SELECT o_orderkey AS ordinal, {_STATUS_SQL} AS status, {_TOTAL_SQL} AS total, 'bulk' AS route FROM orders""")
def _(t):
    path = scratch_path(t.spark, "orders-bulk")
    rows = gen.generate(t.orders.select(F.col("o_orderkey").alias("ordinal")), order_plan()).withColumn("route", F.lit("bulk"))
    from ..sources.sinks import write_bulk
    write_bulk(rows, path, chunk=5000)
    return t.spark.read.schema(rows.schema).parquet(path).select(
        "ordinal", F.col("Status").alias("status"), F.col("Total").alias("total"), "route")


_CHANGES_SQL = """(SELECT c_name, max_by(seg, event_id) FILTER (seg IS NOT NULL) AS seg, max_by(value, event_id) AS value FROM (
  SELECT 'Customer#' || lpad((user_id * 3)::VARCHAR, 9, '0') AS c_name, event_id, value,
    CASE WHEN event_type = 'purchase' THEN 'BUYER' WHEN event_type = 'signup' THEN 'NEW' END AS seg FROM events) GROUP BY c_name)"""


def _changes(t):
    return t.events.select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 3).cast("string"), 9, "0")).alias("c_name"), "event_id",
        F.col("value").alias("c_acctbal"),
        F.when(F.col("event_type") == "purchase", "BUYER").when(F.col("event_type") == "signup", "NEW").alias("c_mktsegment"))


# Views move a customer to a nation by its name; every 31st name is unknown.
_MOVED_SQL = """(SELECT c_name, max_by(nation, event_id) FILTER (nation IS NOT NULL) AS nation FROM (
  SELECT 'Customer#' || lpad((user_id * 3)::VARCHAR, 9, '0') AS c_name, event_id,
    CASE WHEN event_type = 'view' THEN 'NATION_' || (event_id % 31)::VARCHAR END AS nation FROM events) GROUP BY c_name)"""


def _moves(t):
    nation = F.when(F.col("event_type") == "view", F.concat(F.lit("NATION_"), (F.col("event_id") % 31).cast("string")))
    changes = t.events.select("event_id", nation.alias("nation"))
    return _changes(t).join(changes, "event_id"), (Reference("c_nationkey", "Nation", "nation", table=t.nation, natural_key="n_name", row_id="n_nationkey"),)


@reg.add("vrb9_update_by_key", f"""
SELECT c_custkey, c.c_name, coalesce(value, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(n_nationkey, c_nationkey) AS c_nationkey
FROM customer c LEFT JOIN {_CHANGES_SQL} u ON c.c_name = u.c_name LEFT JOIN {_MOVED_SQL} m ON c.c_name = m.c_name LEFT JOIN nation ON nation = n_name""")
def _(t):
    customers = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    changes, references = _moves(t)
    return vb.update_by_key(customers, changes, "c_name", ["c_acctbal", "c_mktsegment"], order=["event_id"], references=references)


@reg.add("vrb9_update_findings", f"""
SELECT c_name AS "row", 'Nation' AS entity, nation AS key, 'not found' AS problem FROM {_MOVED_SQL}
WHERE c_name IN (SELECT c_name FROM customer) AND nation IS NOT NULL AND nation NOT IN (SELECT n_name FROM nation)""")
def _(t):
    changes, references = _moves(t)
    return vb.update_findings(t.customer, changes, "c_name", references, order=["event_id"])


@reg.add("vrb9_missing_keys", f"""
SELECT c_name FROM {_CHANGES_SQL} WHERE c_name NOT IN (SELECT c_name FROM customer) UNION ALL
SELECT c_name || '!' FROM customer WHERE c_custkey % 10 = 0""")
def _(t):
    wanted = _changes(t).select("c_name").unionByName(
        t.customer.filter(F.col("c_custkey") % 10 == 0).select(F.concat("c_name", F.lit("!")).alias("c_name")))
    return vb.missing_keys(t.customer, wanted, "c_name")


@reg.add("vrb10_delete_by_key", f"""
SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM {_CHANGES_SQL})""")
def _(t):
    return vb.delete_by_key(t.customer.select("c_custkey", "c_name"), _changes(t), "c_name")


@reg.add("vrb11_delete_where", """
SELECT l_orderkey, l_partkey, flag FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag
FROM lineitem) WHERE flag IS DISTINCT FROM 'R'""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.when(
        F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"))
    return vb.delete_where(rows, {"flag": "R"})


@reg.add("vrb11_deleted_count", "SELECT count(*) AS deleted FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return vb.deleted_count(t.lineitem, {"l_returnflag": "R"})


@reg.add("vrb12_delete_by_ids", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def _(t):
    ids = t.lineitem.filter(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("o_orderkey"))
    return vb.delete_by_ids(t.orders.select("o_orderkey", "o_orderstatus"), ids, "o_orderkey")


@reg.add("vrb13_exists_ids", """
SELECT DISTINCT l_orderkey * 2 AS o_orderkey, l_orderkey * 2 IN (SELECT o_orderkey FROM orders) AS existed FROM lineitem""")
def _(t):
    return vb.exists_ids(t.orders, t.lineitem.select((F.col("l_orderkey") * 2).alias("o_orderkey")), "o_orderkey")


_CONVERTED_SQL = """(SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount,
  CASE WHEN event_type = 'error' THEN 'Cannot convert "' || 'bad ' || event_id::VARCHAR || '" to double' END AS error FROM events)"""


def _converted(t):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), F.col("event_id").cast("string"))).otherwise(
        F.col("value").cast("string"))
    return vb.convert_columns(t.events.select("event_id", raw.alias("amount")), {"amount": "double"})


@reg.add("vrb14_best_effort", f"SELECT event_id, amount, coalesce(error, '') AS errors FROM {_CONVERTED_SQL}")
def _(t):
    rows, _ = vb.route_failures(_converted(t), "best_effort")
    return rows.withColumn("errors", F.array_join("errors", "; "))


@reg.add("vrb14_reject_rows", f"""
SELECT event_id, amount, error IS NOT NULL AS rejected FROM {_CONVERTED_SQL}""")
def _(t):
    rows, rejects = vb.route_failures(_converted(t), "fail_object")
    return (rows.withColumn("rejected", F.lit(False)).unionByName(rejects.withColumn("rejected", F.lit(True)))
            .drop("errors"))


_CLAIM_SQL = f"(SELECT event_id, user_id, 'K' || (value * 100)::BIGINT % 700 AS nk, {sql_uuid5(chr(39) + 'Ops|Event|' + chr(39) + ' || event_id::VARCHAR')} AS id FROM events)"


@reg.add("vrb15_concurrent_winner", f"""
SELECT event_id, user_id, nk, first_value(id) OVER w AS winner_id,
  CASE WHEN row_number() OVER w = 1 THEN 'created' ELSE 'already-existed' END AS outcome FROM {_CLAIM_SQL}
WINDOW w AS (PARTITION BY nk ORDER BY user_id, event_id)""")
def _(t):
    key = F.concat(F.lit("K"), (F.round(F.col("value") * 100).cast("bigint") % 700).cast("string"))
    rows = t.events.select("event_id", "user_id", key.alias("nk"),
                           uuid5_natural("Ops", "Event", F.col("event_id").cast("string")).alias("id"))
    return vb.concurrent_winner(rows, "nk", ["user_id", "event_id"], "id").drop("id")
