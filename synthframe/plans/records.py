"""Queries of the run record section."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleanup, generate as gen, records as rc
from ..spec import EntitySpec, ForeignKey
from . import fixtures as fx
from .base import Registry, sql_uuid5
from .generation import _KEY_SQL, _STATUS_SQL, _TOTAL_SQL, order_plan

reg = Registry()

RULE = "RUN"


@reg.add("man1_record_entities", f"""
SELECT o_orderkey AS ordinal, 'Orders' AS domain, 'Order' AS entity, 'Create' AS verb, 'bulk' AS persisted_via, id,
  'Deterministic' AS id_strategy, nk AS natural_key, 'OrderFaker+distributions' AS source, 'Id=' || id || ';OrderNumber=' || nk ||
  ';Status=' || status || ';Total=' || CAST(total AS VARCHAR) AS values, '' AS overrides FROM (
  SELECT o_orderkey, {_KEY_SQL} AS nk, {_STATUS_SQL} AS status, {_TOTAL_SQL} AS total, {sql_uuid5("'Orders|Order|' || " + _KEY_SQL)} AS id FROM orders)""")
def _(t):
    plan = order_plan()
    spec = EntitySpec("Orders", "Order", T.StructType([plan.spec.schema[c] for c in ("Id", "OrderNumber", "Status", "Total")]),
                      key="Id", natural_key="OrderNumber")
    rows = gen.generate(t.orders.select(F.col("o_orderkey").alias("ordinal")), plan)
    out = rc.record_entities(rows, spec, verb="Create", ordinal="ordinal", source=gen.source_marker("OrderFaker", distributions=True), route="bulk")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("values", text).withColumn("overrides", F.array_join("overrides", ","))


@reg.add("man2_id_strategy_label", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'DbGenerated' WHEN event_id % 2 = 0 THEN 'Deterministic' ELSE 'ClientSet' END AS id_strategy FROM events""")
def _(t):
    return t.events.select("event_id", rc.id_strategy_column(
        F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0, F.col("event_type").isNotNull()).alias("id_strategy"))


_FAILED = "(event_type = 'error' AND event_id % 4 = 0)"
_SAMPLE_SQL = f"""(SELECT *, NOT failed AND (up <= 5 OR down <= 5) OR failed AS kept FROM (SELECT event_type AS entity, event_id, ts, value, failed,
  row_number() OVER (PARTITION BY event_type, failed ORDER BY event_id) AS up,
  row_number() OVER (PARTITION BY event_type, failed ORDER BY event_id DESC) AS down
  FROM (SELECT *, {_FAILED} AS failed FROM events)))"""


def _sampled(t):
    rows = t.events.withColumn("failed", (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).withColumnRenamed("event_type", "entity")
    return rc.head_tail_sample(rows.select("entity", "event_id", "ts", "value", "failed"), ["entity"], "event_id", "failed")


@reg.add("man3_head_tail_sample", f"SELECT entity, event_id, failed, kept FROM {_SAMPLE_SQL}")
def _(t):
    return _sampled(t).select("entity", "event_id", "failed", "kept")


_ROW_SQL = """event_id::VARCHAR || '|' || 'e' || event_id::VARCHAR || '|' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'k' || event_id::VARCHAR END
  || chr(31) || 'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || chr(31) || 'value=' || CAST(value AS VARCHAR)"""


def _texts(df):
    i = F.col("event_id").cast("string")
    named = df.withColumn("id", F.concat(F.lit("e"), i)).withColumn("nk", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("k"), i)))
    return named.withColumn("text", rc.row_text(named, "event_id", "id", "nk", ["value", "ts"]))


@reg.add("man4_canonical_row", f"SELECT event_id, {_ROW_SQL} AS text FROM events")
def _(t):
    return _texts(t.events).select("event_id", "text")


def _hash_sql(source, block=4096):
    """Row hashes, five levels of blocks, and one hash per entity: six levels take any 64-bit ordinal."""
    level = f"SELECT entity, event_id AS b, sha256(text) AS h FROM ({source})"
    for _ in range(5):
        level = f"SELECT entity, b // {block} AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM ({level}) GROUP BY entity, b // {block}"
    return f"(SELECT entity, sha256(string_agg(h, chr(10) ORDER BY b)) AS values_sha256 FROM ({level}) GROUP BY entity)"


@reg.add("man5_values_hash", f"SELECT * FROM {_hash_sql(f'SELECT event_type AS entity, event_id, {_ROW_SQL} AS text FROM events')}")
def _(t):
    return rc.values_hash(_texts(t.events).withColumnRenamed("event_type", "entity"), ["entity"], "event_id", "text")


@reg.add("man6_bulk_summary", f"""
SELECT s.*, h.values_sha256 FROM (SELECT entity, count(*) AS requested, count(*) FILTER (NOT failed) AS count, count(*) FILTER (failed) AS failed,
    count(*) FILTER (kept AND NOT failed) AS sampled_rows, count(*) FILTER (NOT kept) AS hashed_rows, min(event_id) AS first_ordinal,
    max(event_id) AS last_ordinal FROM {_SAMPLE_SQL} GROUP BY entity) s
LEFT JOIN {_hash_sql(f'SELECT entity, event_id, {_ROW_SQL} AS text FROM {_SAMPLE_SQL} WHERE NOT kept')} h ON s.entity = h.entity""")
def _(t):
    return rc.bulk_summary(_texts(_sampled(t)), ["entity"], "event_id", "failed", "text")


@reg.add("man7_attestation", f"""
SELECT true AS synthetic_only, string_agg(DISTINCT label, ',' ORDER BY label) AS sources FROM (
  SELECT CASE WHEN source LIKE 'auto%' THEN 'AutoFaker' ELSE 'ConventionFaker' END AS label FROM {fx.ENTITIES_SQL} WHERE source IS NOT NULL UNION ALL
  SELECT 'GeneratorPlugin' FROM {fx.ENTITIES_SQL} WHERE source LIKE '%+plugin:%' UNION ALL
  SELECT 'Distribution' FROM {fx.ENTITIES_SQL} WHERE source LIKE '%+distributions%' UNION ALL
  SELECT 'DatasetPack' FROM {fx.ENTITIES_SQL} WHERE source LIKE '%+datasets%' UNION ALL
  SELECT 'Override' FROM {fx.ENTITIES_SQL} WHERE has_override UNION ALL
  SELECT 'IdentityContract' FROM {fx.ENTITIES_SQL} WHERE id_strategy = 'Deterministic')""")
def _(t):
    return rc.attestation(fx.entities(t))


_OUTCOME_SQL = f"""(SELECT scenario_seq, CASE WHEN skipped THEN 'Skipped' WHEN failed THEN 'Failed' WHEN warning IS NOT NULL
  OR scenario_seq IN (SELECT scenario_seq FROM {fx.ENTITIES_SQL} WHERE warning IS NOT NULL)
  OR scenario_seq IN (SELECT scenario_seq FROM {fx.UNMATCHED_SQL}) THEN 'CompletedWithWarnings' ELSE 'Succeeded' END AS outcome
FROM {fx.SCENARIOS_SQL})"""


@reg.add("man8_scenario_outcome", f"SELECT * FROM {_OUTCOME_SQL}")
def _(t):
    return rc.scenario_outcome(fx.scenarios(t), fx.entities(t), fx.unmatched(t))


@reg.add("man9_run_outcome", f"""
SELECT CASE WHEN f > 0 THEN 'Failed' WHEN w > 0 THEN 'CompletedWithWarnings' ELSE 'Succeeded' END AS outcome,
  CASE WHEN f > 0 THEN 2 WHEN w > 0 THEN 1 ELSE 0 END::INT AS exit_code
FROM (SELECT count(*) FILTER (outcome = 'Failed') AS f, count(*) FILTER (outcome = 'CompletedWithWarnings') AS w FROM {_OUTCOME_SQL})""")
def _(t):
    return rc.run_outcome(rc.scenario_outcome(fx.scenarios(t), fx.entities(t), fx.unmatched(t)))


_IDS_SQL = f"(SELECT DISTINCT id FROM {fx.ENTITIES_SQL} WHERE verb IN ('Create', 'Projection') AND id IS NOT NULL AND entity = 'Customer')"


def _target(t):
    return t.customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_name")


def _ids(t):
    return rc.teardown_ids(fx.entities(t)).filter(F.col("entity") == "Customer").select("id")


@reg.add("man10_teardown_rows", f"SELECT c_custkey, c_name FROM customer WHERE 'r' || c_custkey::VARCHAR NOT IN (SELECT id FROM {_IDS_SQL})")
def _(t):
    return rc.teardown(_target(t), "id", _ids(t))[0].select("c_custkey", "c_name")


@reg.add("man10_teardown_counts", f"""
SELECT count(*) AS wanted, count(c_custkey) AS deleted, count(*) - count(c_custkey) AS gone
FROM {_IDS_SQL} LEFT JOIN customer ON id = 'r' || c_custkey::VARCHAR""")
def _(t):
    return rc.teardown(_target(t), "id", _ids(t))[1]


# The whole run: orders before the customers that they refer to. Recorded ids are r0 to r996.
_CUSTOMER = EntitySpec("Orders", "Customer", T.StructType([T.StructField("id", T.StringType()), T.StructField("c_name", T.StringType())]), key="id")
_ORDER = EntitySpec("Orders", "Order", T.StructType([T.StructField("id", T.StringType()), T.StructField("customer_id", T.StringType())]),
                    key="id", foreign_keys=(ForeignKey("customer_id", "Customer"),))
_TEARDOWN_SQL = f"""wanted AS (SELECT DISTINCT entity, id FROM {fx.ENTITIES_SQL} WHERE verb IN ('Create', 'Projection') AND id IS NOT NULL),
c AS (SELECT 'r' || c_custkey::VARCHAR AS id FROM customer), o AS (SELECT 'r' || o_orderkey::VARCHAR AS id, 'r' || o_custkey::VARCHAR AS customer_id FROM orders),
rest_o AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM wanted WHERE entity = 'Order')),
used AS (SELECT customer_id AS id, count(*) AS children FROM rest_o GROUP BY 1),
kept_c AS (SELECT c.id, children FROM c JOIN wanted w ON w.entity = 'Customer' AND w.id = c.id JOIN used ON used.id = c.id),
rest_c AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM wanted WHERE entity = 'Customer') OR id IN (SELECT id FROM kept_c))"""


def _run_teardown(t):
    tables = {"Orders.Customer": t.customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), "c_name"),
              "Orders.Order": t.orders.select(*(F.concat(F.lit("r"), F.col(c).cast("string")).alias(n) for c, n in (("o_orderkey", "id"), ("o_custkey", "customer_id"))))}
    return cleanup.teardown_run(fx.entities(t), fx.bulk(t), [_CUSTOMER, _ORDER], tables)


@reg.add("man10_teardown_run_counts", f"""
WITH {_TEARDOWN_SQL} SELECT 'Orders' AS domain, 'Order' AS entity, count(*) AS wanted, count(o.id) AS deleted, count(*) - count(o.id) AS gone, 0::BIGINT AS orphaned
FROM wanted w LEFT JOIN o ON o.id = w.id WHERE w.entity = 'Order' UNION ALL
SELECT 'Orders', 'Customer', count(*), count(c.id) - count(k.id), count(*) - count(c.id), count(k.id)
FROM wanted w LEFT JOIN c ON c.id = w.id LEFT JOIN kept_c k ON k.id = w.id WHERE w.entity = 'Customer'""")
def _(t):
    return _run_teardown(t).counts


@reg.add("man10_teardown_run_rest", f"""
WITH {_TEARDOWN_SQL} SELECT 'Order' AS entity, id FROM rest_o UNION ALL SELECT 'Customer', id FROM rest_c""")
def _(t):
    rest = _run_teardown(t).rest
    return rest["Orders.Order"].select(F.lit("Order").alias("entity"), "id").unionByName(rest["Orders.Customer"].select(F.lit("Customer").alias("entity"), "id"))


@reg.add("man10_teardown_run_orphans", f"""
WITH {_TEARDOWN_SQL} SELECT 'Customer' AS entity, id, children, children::VARCHAR || ' row(s) of Order refer to it' AS reason FROM kept_c""")
def _(t):
    return _run_teardown(t).orphans.select("entity", "id", "children", "reason")


@reg.add("man10_teardown_run_warnings", f"""
SELECT scenario_seq, entity, hashed_rows, 'only ' || sampled_rows::VARCHAR || ' of ' || count::VARCHAR || ' ' || entity ||
  ' rows were recorded one by one and can be removed' AS warning FROM {fx.BULK_SQL} WHERE hashed_rows > 0""")
def _(t):
    return _run_teardown(t).warnings.select("scenario_seq", "entity", "hashed_rows", "warning")


@reg.add("man11_orphans", """
SELECT c_custkey AS id, count(*) AS children FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus <> 'F' GROUP BY c_custkey""")
def _(t):
    doomed = t.customer.filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("id"))
    return rc.orphans(doomed, t.orders.filter(F.col("o_orderstatus") != "F"), "o_custkey")


@reg.add("man12_run_summary", f"""
SELECT s.scenario_seq, scenario, outcome, seed, count(*) FILTER (verb IN ('Create', 'Projection')) AS created,
  count(e.warning) + max(CASE WHEN s.warning IS NOT NULL THEN 1 ELSE 0 END) AS warnings
FROM {fx.SCENARIOS_SQL} s JOIN {fx.ENTITIES_SQL} e ON s.scenario_seq = e.scenario_seq GROUP BY s.scenario_seq, scenario, outcome, seed""")
def _(t):
    return rc.run_summary(fx.scenarios(t), fx.entities(t))


@reg.add("man13_suite_rollup", f"""
WITH s AS (SELECT s.scenario_seq, feature, outcome, d FROM {fx.SCENARIOS_SQL} s
  JOIN (SELECT scenario_seq, sum(CAST(duration_ms AS DECIMAL(28,6))) AS d FROM {fx.ENTITIES_SQL} GROUP BY 1) e ON s.scenario_seq = e.scenario_seq)
SELECT feature, count(*) AS tests, count(*) FILTER (outcome = 'Failed') AS failures, count(*) FILTER (outcome = 'Skipped') AS skipped,
  round_even(CAST(sum(d) AS DOUBLE) / 1000, 3) AS seconds FROM s GROUP BY feature UNION ALL
SELECT NULL, count(*), count(*) FILTER (outcome = 'Failed'), count(*) FILTER (outcome = 'Skipped'), 12.5 FROM s""")
def _(t):
    return rc.suite_rollup(fx.scenarios(t), fx.entities(t), run_duration_ms=12500.0)


_VIOLATIONS_SQL = """(SELECT 'maxRows' AS rule, 'step ' || o_orderpriority || ' asks for ' || count(*)::VARCHAR AS message FROM orders GROUP BY o_orderpriority)"""


@reg.add("man14_findings", f"""
SELECT '{RULE}0004' AS rule_id, 'error' AS level, rule || ': ' || message AS message, NULL::BIGINT AS scenario_seq, 0::BIGINT AS line
FROM {_VIOLATIONS_SQL} UNION ALL
SELECT '{RULE}0001', 'warning', 'no rule for a step of ' || scenario || ': ' || text, u.scenario_seq, u.line
FROM {fx.UNMATCHED_SQL} u JOIN {fx.SCENARIOS_SQL} s ON u.scenario_seq = s.scenario_seq UNION ALL
SELECT '{RULE}0002', 'warning', scenario || ': ' || w, s.scenario_seq, s.line FROM {fx.SCENARIOS_SQL} s JOIN (
  SELECT scenario_seq, warning AS w FROM {fx.ENTITIES_SQL} UNION ALL SELECT scenario_seq, warning FROM {fx.SCENARIOS_SQL}) x
  ON s.scenario_seq = x.scenario_seq AND w IS NOT NULL UNION ALL
SELECT '{RULE}0003', 'error', scenario || ' ended as failed', scenario_seq, line FROM {fx.SCENARIOS_SQL} WHERE outcome = 'Failed'""")
def _(t):
    violations = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("maxRows").alias("rule"), F.concat(F.lit("step "), "o_orderpriority", F.lit(" asks for "), F.col("n").cast("string")).alias("message"))
    return rc.findings(violations, fx.unmatched(t), fx.scenarios(t), fx.entities(t), rule_prefix=RULE)


@reg.add("man15_scenario_duration", f"""
SELECT scenario_seq, round_even(CAST(sum(CAST(duration_ms AS DECIMAL(28,6))) AS DOUBLE), 3) AS duration_ms FROM (
  SELECT scenario_seq, duration_ms FROM {fx.ENTITIES_SQL} UNION ALL SELECT scenario_seq, duration_ms FROM {fx.BULK_SQL}) GROUP BY 1""")
def _(t):
    return rc.scenario_duration(fx.entities(t), fx.bulk(t))
