"""Queries of the rule, registry, layer, lineage and name check sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as ly, lineage as ln, namecheck as nc, registry as rg, rules as rl
from . import fixtures as fx
from .base import Registry

reg = Registry()

_ROWS = "coalesce(inline_rows, count)"


@reg.add("pol1_max_rows_per_step", f"""
SELECT 'MaxBulkRowsPerStep' AS rule, scenario || ': a step asks for ' || {_ROWS}::VARCHAR || ' rows of ' || entity || '; the limit is 15' AS message
FROM {fx.STEPS_SQL} WHERE verb = 'create' AND {_ROWS} > 15""")
def _(t):
    return rl.max_rows_per_step(fx.steps(t), 15)


@reg.add("pol2_max_rows_total", f"""
SELECT 'MaxCreatedRowsPerRun' AS rule, 'all steps ask for ' || sum({_ROWS})::VARCHAR || ' rows; the limit is 100' AS message
FROM {fx.STEPS_SQL} WHERE verb = 'create' HAVING sum({_ROWS}) > 100""")
def _(t):
    return rl.max_rows_total(fx.steps(t), 100)


@reg.add("pol3_banned_entities", f"""
SELECT 'BannedEntities' AS rule, scenario || ': ' || entity || ' is banned in prod' AS message
FROM {fx.STEPS_SQL} WHERE entity = 'F'""")
def _(t):
    return rl.banned_entities(fx.steps(t), ["f", "Z"], "prod")


_TAGGED_SQL = """(SELECT DISTINCT 'S' || user_id::VARCHAR AS scenario, user_id FROM events)"""


def _tagged(t):
    i = F.col("user_id")
    users = t.events.select("user_id").distinct()
    return users.select(
        F.concat(F.lit("S"), i.cast("string")).alias("scenario"),
        F.when(i % 3 == 0, F.array(F.lit("Owner:team-a"), F.lit("smoke"))).when(i % 3 == 1, F.array(F.lit("ownership")))
         .otherwise(F.array(F.lit("owner"))).alias("tags"),
        F.when(i % 4 == 0, "Transactional").when(i % 4 == 1, "Persistent").when(i % 4 == 2, "TrackedTeardown").alias("lifecycle"))


@reg.add("pol4_required_tags", f"""
SELECT 'RequiredTags' AS rule, scenario || ': no tag ' ||
  CASE WHEN user_id % 3 = 1 THEN 'owner, Smoke' ELSE 'Smoke' END AS message FROM {_TAGGED_SQL} WHERE user_id % 3 <> 0""")
def _(t):
    return rl.required_tags(_tagged(t), ["owner", "Smoke"])


_LIFE_SQL = f"""SELECT 'AllowedLifecycles' AS rule, scenario || ': lifecycle ' ||
  CASE user_id % 4 WHEN 0 THEN 'Transactional' ELSE 'TrackedTeardown' END || ' is not one of Persistent' AS message
FROM {_TAGGED_SQL} WHERE user_id % 4 IN (0, 2)"""


@reg.add("pol5_allowed_lifecycles", _LIFE_SQL)
def _(t):
    return rl.allowed_lifecycles(_tagged(t), ["Persistent"])


@reg.add("pol6_rule_report", f"""{_LIFE_SQL} UNION ALL
SELECT 'BannedEntities', scenario || ': ' || entity || ' is banned in Prod' FROM {fx.STEPS_SQL} WHERE entity = 'P' UNION ALL
SELECT 'MaxBulkRowsPerStep', scenario || ': a step asks for ' || {_ROWS}::VARCHAR || ' rows of ' || entity || '; the limit is 20'
FROM {fx.STEPS_SQL} WHERE verb = 'create' AND {_ROWS} > 20""")
def _(t):
    environments = {"PROD": {"allowed_lifecycles": ["Persistent"], "max_rows_per_step": 20, "banned_entities": ["p"]}}
    return rl.rule_report(t.spark, environments, "Prod", fx.steps(t), _tagged(t))


@reg.add("pol7_key_registry", """
SELECT 'KeyRegistry' AS rule, domain || ' has not published ' || e || ' ' || key AS message
FROM (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Size' ELSE 'Type' END AS e, CASE WHEN p_partkey % 5 = 0 THEN 'Stock' ELSE 'Catalog' END AS domain,
    CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'size-' || p_size::VARCHAR ELSE p_type END AS key FROM part)
WHERE domain = 'Catalog' AND (e = 'Brand' AND key NOT IN (SELECT p_brand FROM part WHERE p_size = 50) AND NOT regexp_matches(key, '^Brand#1[0-9]$')
  OR e = 'Size' AND NOT regexp_matches(key, '^size-[0-9]$'))""")
def _(t):
    i = F.col("p_partkey")
    refs = t.part.select(
        F.when(i % 5 == 0, "Stock").otherwise("CATALOG").alias("domain"),
        F.when(i % 3 == 0, "Brands").when(i % 3 == 1, "Sizes").otherwise("Types").alias("entity"),
        F.when(i % 3 == 0, F.col("p_brand")).when(i % 3 == 1, F.concat(F.lit("size-"), F.col("p_size").cast("string"))).otherwise(F.col("p_type")).alias("key"))
    refs = refs.withColumn("domain", F.initcap("domain"))
    keys = t.part.filter(F.col("p_size") == 50).select(F.lit("catalog").alias("domain"), F.lit("Brand").alias("entity"), F.col("p_brand").alias("key"))
    # governed entities with their patterns: derived from which of them have keys at all
    patterns = t.part.select(F.lit("Catalog").alias("domain"), F.explode(F.array(
        F.struct(F.lit("brand").alias("entity"), F.lit("^Brand#1[0-9]$").alias("pattern")),
        F.struct(F.lit("Size").alias("entity"), F.lit("^size-[0-9]$").alias("pattern")))).alias("g")).select("domain", "g.*").distinct()
    return rl.key_registry(refs, keys, patterns)


_RUNS_SQL = """(SELECT user_id * 1000 + day(ts) AS run_id, CASE WHEN user_id % 3 = 0 THEN 'prod' ELSE 'ci' END AS env, max(ts) AS started_utc, count(*) AS rows
  FROM events GROUP BY 1, 2)"""


@reg.add("reg1_latest_runs", f"""
SELECT run_id, env, strftime(started_utc, '%Y-%m-%d %H:%M:%S.%f') AS started_utc, rows FROM {_RUNS_SQL} WHERE env = 'prod'
ORDER BY started_utc DESC, run_id DESC LIMIT 100""")
def _(t):
    runs = t.events.groupBy((F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("run_id"),
                            F.when(F.col("user_id") % 3 == 0, "prod").otherwise("ci").alias("env")).agg(
        F.max("ts").alias("started_utc"), F.count(F.lit(1)).alias("rows"))
    return rg.latest_runs(runs, env="prod").withColumn("started_utc", F.date_format("started_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_LEASES_SQL = """(SELECT event_id AS lease_id, CASE WHEN user_id % 3 <> 0 THEN 'env' || (user_id % 3)::VARCHAR END AS environment, event_type AS domain,
  'db' || (user_id % 4)::VARCHAR AS database_id, ts AS acquired_utc, ts + to_seconds((value * 100)::BIGINT) AS expires_utc FROM events)"""


def _leases(t):
    u = F.col("user_id")
    seconds = F.rint(F.col("value") * 100).cast("bigint")  # halves to even, as the cast of the SQL
    return t.events.select(
        F.col("event_id").alias("lease_id"), F.when(u % 3 != 0, F.concat(F.lit("env"), (u % 3).cast("string"))).alias("environment"),
        F.col("event_type").alias("domain"), F.concat(F.lit("db"), (u % 4).cast("string")).alias("database_id"), F.col("ts").alias("acquired_utc"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("expires_utc"))


@reg.add("reg2_active_leases", f"SELECT lease_id, domain, database_id FROM {_LEASES_SQL} WHERE expires_utc > TIMESTAMP '2024-01-20 06:00:00'")
def _(t):
    return rg.active_leases(_leases(t), F.lit("2024-01-20 06:00:00").cast("timestamp")).select("lease_id", "domain", "database_id")


@reg.add("reg3_lease_conflicts", f"""
SELECT lease_id, strftime(held_until, '%Y-%m-%d %H:%M:%S.%f') AS held_until FROM (
  SELECT *, max(expires_utc) OVER (PARTITION BY coalesce(environment, ''), domain, database_id ORDER BY acquired_utc, lease_id, expires_utc
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_until FROM {_LEASES_SQL}) WHERE held_until > acquired_utc""")
def _(t):
    return rg.lease_conflicts(_leases(t)).withColumn("held_until", F.date_format("held_until", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# Settings per part name: local rows, and packs named after the brands.
_LAYERS_SQL = """(SELECT 'entity' AS kind, CASE WHEN p_size % 9 = 0 THEN 'local' ELSE p_brand END AS layer, p_name AS name,
  CASE WHEN p_size % 9 = 0 THEN -1 ELSE substr(p_brand, 7)::INT END AS position, min(p_partkey) AS value FROM part GROUP BY 1, 2, 3, 4)"""


def _layers(t):
    local = F.col("p_size") % 9 == 0
    return t.part.groupBy(
        F.lit("entity").alias("kind"), F.when(local, "local").otherwise(F.col("p_brand")).alias("layer"),
        F.col("p_name").alias("name"), F.when(local, -1).otherwise(F.expr("cast(substring(p_brand, 7) AS int)")).alias("position")
    ).agg(F.min("p_partkey").alias("value"))


@reg.add("cfg1_merge_layers", f"""
SELECT kind, layer, name, value FROM {_LAYERS_SQL} QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY position, layer) = 1""")
def _(t):
    return ly.merge_layers(_layers(t))


@reg.add("cfg1_layer_conflicts", f"""
SELECT kind, name, count(DISTINCT layer) AS packs, min(layer) AS first_pack, max(layer) AS last_pack FROM {_LAYERS_SQL}
WHERE layer <> 'local' GROUP BY kind, name HAVING count(DISTINCT layer) > 1""")
def _(t):
    return ly.layer_conflicts(_layers(t))


_PACKS_SQL = "(SELECT p_brand AS pack, CASE WHEN p_size > 30 THEN upper(p_type) ELSE p_type END || (p_size % 3)::VARCHAR AS domain, p_name AS key FROM part WHERE p_size % 7 = 3)"


def _packs(t):
    name = F.when(F.col("p_size") > 30, F.upper("p_type")).otherwise(F.col("p_type"))
    return t.part.filter(F.col("p_size") % 7 == 3).select(
        F.col("p_brand").alias("pack"), F.concat(name, (F.col("p_size") % 3).cast("string")).alias("domain"), F.col("p_name").alias("key"))


@reg.add("cfg2_merge_registries", f"""
SELECT domain, key, 'own' AS source FROM (SELECT lower(p_type) || '1' AS domain, p_brand AS key FROM part WHERE p_size = 1) UNION ALL
SELECT domain, key, pack FROM {_PACKS_SQL} WHERE lower(domain) NOT IN (SELECT lower(p_type) || '1' FROM part WHERE p_size = 1)
  AND lower(domain) IN (SELECT lower(domain) FROM {_PACKS_SQL} GROUP BY 1 HAVING count(DISTINCT pack) = 1)""")
def _(t):
    own = t.part.filter(F.col("p_size") == 1).select(F.concat(F.lower("p_type"), F.lit("1")).alias("domain"), F.col("p_brand").alias("key"))
    return ly.merge_registries(own, _packs(t))


@reg.add("cfg2_registry_conflicts", f"""
SELECT lower(domain) AS domain, count(DISTINCT pack) AS packs, min(pack) AS first_pack, max(pack) AS last_pack FROM {_PACKS_SQL}
GROUP BY 1 HAVING count(DISTINCT pack) > 1""")
def _(t):
    return ly.registry_conflicts(_packs(t))


@reg.add("cfg3_ordered_union", """
SELECT row_number() OVER (ORDER BY layer_rank, position, name) AS place, layer_rank, position, name FROM (
  SELECT 0 AS layer_rank, s_nationkey AS position, s_name AS name FROM supplier UNION ALL SELECT 1, 0, c_name FROM customer)""")
def _(t):
    from ..operators.sequence import dense_sequence
    packs = t.supplier.select(F.col("s_nationkey").alias("position"), F.col("s_name").alias("name"))
    union = ly.ordered_union(packs, t.customer.select(F.col("c_name").alias("name")))
    return dense_sequence(union, ["layer_rank", "position", "name"], "place").select("place", "layer_rank", "position", "name")


# Lineage: customers created a few per scenario, orders many per scenario; orders refer to customers.
_ROWS_SQL = """(SELECT (c_custkey % 400)::INT AS seq, c_custkey AS ordinal, 'Customer' AS entity, 'c' || c_custkey::VARCHAR AS id, c_name AS nk FROM customer WHERE c_custkey % 6 <> 0
  UNION ALL SELECT (1000 + o_orderkey % 300)::INT, o_orderkey, 'Order', 'o' || o_orderkey::VARCHAR, 'ORD-' || o_orderkey::VARCHAR FROM orders)"""
# Clicks stand for bulk operations on customers, spelled otherwise; their scenarios also made customers one by one.
_BULK_SQL = f"(SELECT scenario_seq AS seq, 'Customer' AS entity, max(count) AS bulk FROM {fx.BULK_SQL} WHERE entity = 'click' GROUP BY 1)"
_NODES_SQL = f"""(SELECT *, CASE WHEN many THEN 'agg:' || seq::VARCHAR || ':Orders:' || entity ELSE 'ent:Orders:' || entity || ':' || nk END AS node_id,
  CASE WHEN many THEN coalesce(bulk, n)::VARCHAR || ' × ' || entity ELSE entity END AS title, CASE WHEN many THEN 'Orders' ELSE nk || ' · Orders' END AS subtitle
  FROM (SELECT *, count(*) OVER (PARTITION BY seq, entity) AS n, count(*) OVER (PARTITION BY seq, entity) >= 10 OR bulk IS NOT NULL AS many
  FROM {_ROWS_SQL} LEFT JOIN {_BULK_SQL} USING (seq, entity)))"""
_REFS_SQL = """(SELECT (1000 + o_orderkey % 300)::INT AS seq, o_orderkey AS ordinal, 'Customer:' || c_name AS target,
  CASE WHEN o_orderkey % 2 = 0 THEN 'c' || c_custkey::VARCHAR END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'contextBag' ELSE 'database' END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_TARGETS_SQL = f"""(SELECT r.*, coalesce(a.node_id, b.node_id) AS known, coalesce(a.node_id, b.node_id, 'ext:Crm:' || target) AS target_id FROM {_REFS_SQL} r
  LEFT JOIN (SELECT id, min_by(node_id, seq::BIGINT * 1000000000 + ordinal) AS node_id FROM {_NODES_SQL} GROUP BY id) a ON r.id = a.id
  LEFT JOIN (SELECT entity || ':' || nk AS t, min_by(node_id, seq::BIGINT * 1000000000 + ordinal) AS node_id FROM {_NODES_SQL} WHERE NOT many GROUP BY 1) b ON target = b.t)"""


def _lineage_inputs(t):
    def rows(df, seq, ordinal, entity, row_id, key):
        return df.select(seq.cast("int").alias("scenario_seq"), ordinal.alias("ordinal"), F.lit("Orders").alias("domain"), F.lit(entity).alias("entity"),
                         F.lit("Create").alias("verb"), F.concat(F.lit(row_id), ordinal.cast("string")).alias("id"), key.alias("natural_key"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    entities = rows(t.customer.filter(c % 6 != 0), c % 400, c, "Customer", "c", F.col("c_name")).unionByName(
        rows(t.orders, o % 300 + 1000, o, "Order", "o", F.concat(F.lit("ORD-"), o.cast("string"))))
    refs = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == c).select(
        (o % 300 + 1000).cast("int").alias("scenario_seq"), o.alias("source_ordinal"), F.concat(F.lit("Customer:"), "c_name").alias("target"),
        F.when(o % 2 == 0, F.concat(F.lit("c"), c.cast("string"))).alias("id"), F.lit("Crm").alias("owning_domain"),
        F.when(o % 3 == 0, "contextBag").otherwise("database").alias("resolved_from"))
    bulk = fx.bulk(t).withColumn("entity", F.when(F.col("entity") == "click", "CUSTOMER").otherwise(F.col("entity")))
    return entities, bulk, refs


@reg.add("lin1_lineage_nodes", f"""
SELECT node_id, min(title) AS title, min(subtitle) AS subtitle, 'Orders' AS domain, false AS external FROM {_NODES_SQL} GROUP BY node_id UNION ALL
SELECT DISTINCT target_id, 'Customer', substr(target, 10) || ' · Crm', 'Crm', true FROM {_TARGETS_SQL} WHERE known IS NULL""")
def _(t):
    return ln.lineage_nodes(*_lineage_inputs(t))


@reg.add("lin2_lineage_edges", f"""
SELECT n.node_id AS source_id, target_id, label, count(*) AS count FROM {_TARGETS_SQL} r JOIN {_NODES_SQL} n ON r.seq = n.seq AND r.ordinal = n.ordinal AND n.entity = 'Order'
WHERE n.node_id <> target_id GROUP BY 1, 2, 3""")
def _(t):
    return ln.lineage_edges(*_lineage_inputs(t))


@reg.add("lin3_lineage_depth", """
SELECT 'o' || o_orderkey::VARCHAR AS node_id, 3 AS depth, false AS cyclic FROM orders UNION ALL
SELECT 'c' || c_custkey::VARCHAR, 2, false FROM customer UNION ALL
SELECT 'n' || n_nationkey::VARCHAR, 1, false FROM nation UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 0, false FROM region
  WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL
SELECT 's' || s_suppkey::VARCHAR, NULL, true FROM supplier""")
def _(t):
    def edge(df, a, pa, b, pb):
        return df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("source_id"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("target_id"))
    # orders also point straight at a nation: the longest path counts
    shortcut = t.orders.filter(F.col("o_orderkey") % 10 == 0).select("o_orderkey", (F.col("o_orderkey") % 25).alias("n"))
    edges = (edge(t.orders, "o_orderkey", "o", "o_custkey", "c").unionByName(edge(t.customer, "c_custkey", "c", "c_nationkey", "n"))
             .unionByName(edge(t.nation, "n_nationkey", "n", "n_regionkey", "r")).unionByName(edge(shortcut, "o_orderkey", "o", "n", "n")))
    # suppliers depend on each other in a ring, and one of them on a nation: they never come to an end
    ring = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_suppkey").alias("_k"))
    after = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target_id"), F.col("s_suppkey").alias("_t"))
    count = t.supplier.agg(F.max("s_suppkey").alias("_n"))
    ring = ring.withColumn("_t", F.col("_k") % count.scalar() + 1).join(after, "_t").select("source_id", "target_id")
    way_out = edge(t.supplier, "s_suppkey", "s", "s_nationkey", "n")
    return ln.lineage_depth(edges.unionByName(ring).unionByName(way_out))


@reg.add("cat1_unknown_names", """
WITH c AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'Orders' ELSE 'Stock' END AS domain, p_name AS entity, p_brand AS property FROM part WHERE p_size <= 40),
s AS (SELECT CASE p_partkey % 11 WHEN 0 THEN 'Nowhere' WHEN 1 THEN 'orders' END AS pin, p_name AS base,
  CASE WHEN p_partkey % 13 = 0 THEN p_name || '?' ELSE upper(p_name) || 'S' END AS entity, p_brand AS property,
  CASE WHEN p_partkey % 17 = 0 THEN p_name || '!' ELSE p_name END AS target FROM part),
k AS (SELECT entity, pin, base, (SELECT count(DISTINCT domain) FROM c WHERE c.entity = base AND s.entity NOT LIKE '%?' AND (pin IS NULL OR lower(domain) = pin)) AS n
  FROM (SELECT DISTINCT entity, pin, base FROM s WHERE pin IS DISTINCT FROM 'Nowhere') s)
SELECT DISTINCT 'domain' AS kind, pin AS name, NULL AS within, 'error' AS level FROM s WHERE pin = 'Nowhere' UNION ALL
SELECT 'entity', entity, pin, 'error' FROM k WHERE n = 0 UNION ALL
SELECT 'ambiguous entity', entity, pin, 'warning' FROM k WHERE n > 1 UNION ALL
SELECT DISTINCT 'property', s.property, s.base, 'warning' FROM s JOIN k ON s.entity = k.entity AND s.pin IS NOT DISTINCT FROM k.pin
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.entity = s.base AND c.property = s.property AND (s.pin IS NULL OR lower(c.domain) = s.pin)) UNION ALL
SELECT DISTINCT 'reference target', target, NULL, 'error' FROM s WHERE target LIKE '%!' OR target NOT IN (SELECT entity FROM c)""")
def _(t):
    i = F.col("p_partkey")
    catalog = t.part.filter(F.col("p_size") <= 40).select(F.when(i % 2 == 0, "Orders").otherwise("Stock").alias("domain"),
                                                          F.col("p_name").alias("entity"), F.col("p_brand").alias("property")).distinct()
    steps = t.part.select(
        F.when(i % 11 == 0, "Nowhere").when(i % 11 == 1, "orders").alias("domain_pin"),
        F.when(i % 13 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.concat(F.upper("p_name"), F.lit("S"))).alias("entity"),
        F.col("p_brand").alias("property"),
        F.when(i % 17 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("ref_target"))
    return nc.unknown_names(steps, catalog)
