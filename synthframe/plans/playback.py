"""Queries of the playback and journal sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as jr, playback as pb
from . import fixtures as fx
from .base import Registry

reg = Registry()

_PLAYED_SQL = f"""(SELECT e.*, scenario_seq * 1000000000000 + ordinal AS pos, lower(domain || '|' || entity || '|' || coalesce(id, 'nk:' || natural_key)) AS row_key
  FROM {fx.ENTITIES_SQL} e WHERE persisted_via <> 'dry-run' AND scenario_seq IN (
    SELECT scenario_seq FROM {fx.SCENARIOS_SQL} WHERE lifecycle = 'Persistent' AND outcome <> 'Skipped'))"""


@reg.add("drf1_fold_expected", f"""
WITH p AS (SELECT * FROM {_PLAYED_SQL}),
v AS (SELECT entity, max(pos) AS void FROM p WHERE verb = 'Delete' AND id IS NULL GROUP BY entity),
l AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY pos DESC) AS rn FROM p WHERE verb <> 'Delete' OR id IS NOT NULL)
SELECT row_key, scenario_seq, ordinal, amount, verb = 'Delete' AS deleted FROM l LEFT JOIN v ON l.entity = v.entity
WHERE rn = 1 AND (void IS NULL OR pos > void)""")
def _(t):
    return pb.fold_expected(fx.entities(t), fx.scenarios(t)).select(
        "row_key", "scenario_seq", "ordinal", F.col("values")["amount"].alias("amount"), "deleted")


# Recorded orders against a perturbed copy of the table: lost rows, changed prices, deleted rows that are back.
_EXPECTED_SQL = """(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::VARCHAR END AS id, 'ORD-' || o_orderkey::VARCHAR AS nk,
  'orders|order|' || CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::VARCHAR ELSE 'nk:ord-' || o_orderkey::VARCHAR END AS row_key,
  o_orderkey % 101 = 0 AS deleted, o_orderkey % 97 <> 0 AS found, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
  CAST(o_totalprice + CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS price_now FROM orders)"""


def _found(t):
    i = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    values = F.create_map(F.lit("o_totalprice"), price, F.lit("o_orderstatus"), F.col("o_orderstatus"))
    values = F.when(i % 83 == 0, F.map_concat(values, F.create_map(F.lit("colour"), F.lit("red")))).otherwise(values)
    made = t.orders.select(
        F.lit(1).alias("scenario_seq"), i.alias("ordinal"), F.lit("Orders").alias("domain"), F.lit("Order").alias("entity"),
        F.lit("Create").alias("verb"), F.lit("DbContext").alias("persisted_via"), F.when(i % 7 != 0, i.cast("string")).alias("id"),
        F.concat(F.lit("ORD-"), i.cast("string")).alias("natural_key"), values.alias("values"))
    # a tombstone needs an id, so rows known by natural key only are tombstoned by their fold below
    expected = pb._last_writes(made).drop("_gone", "_made").withColumn("deleted", F.col("ordinal") % 101 == 0)
    actual = t.orders.filter(i % 97 != 0).select(
        i.cast("string").alias("row_id"), F.concat(F.lit("ORD-"), i.cast("string")).alias("nk"),
        (F.col("o_totalprice") + F.when(i % 89 == 0, 1.0).otherwise(0.0)).alias("o_totalprice"), "o_orderstatus")
    return pb.find_recorded(expected, actual, "row_id", "nk", ["o_totalprice", "o_orderstatus"])


@reg.add("drf2_drift_rows", f"""
SELECT row_key, CASE WHEN deleted THEN 'exists again' ELSE 'missing' END AS drift FROM {_EXPECTED_SQL} WHERE deleted = found""")
def _(t):
    return pb.drift_rows(_found(t))


_CELLS_SQL = f"""(SELECT row_key, 'o_totalprice' AS property, price_text AS recorded, price_now AS current, 'changed' AS finding
  FROM {_EXPECTED_SQL} WHERE found AND NOT deleted AND o_orderkey % 89 = 0 UNION ALL
  SELECT row_key, 'colour', 'red', NULL, 'vanished' FROM {_EXPECTED_SQL} WHERE found AND NOT deleted AND o_orderkey % 83 = 0)"""


@reg.add("drf3_drift_values", f"SELECT * FROM {_CELLS_SQL}")
def _(t):
    return pb.drift_values(_found(t))


@reg.add("drf4_drift_report", f"""
SELECT rows_checked, skipped_scenarios, drift, warnings, CASE WHEN drift > 0 THEN 1 ELSE 0 END::INT AS exit_code FROM (
  SELECT (SELECT count(*) FROM orders) AS rows_checked,
    (SELECT count(*) FROM {fx.SCENARIOS_SQL} WHERE lifecycle <> 'Persistent' OR outcome = 'Skipped') AS skipped_scenarios,
    (SELECT count(*) FROM {_EXPECTED_SQL} WHERE deleted = found) + (SELECT count(*) FROM {_CELLS_SQL} WHERE finding = 'changed') AS drift,
    (SELECT count(*) FROM {_CELLS_SQL} WHERE finding = 'vanished') + 2 AS warnings)""")
def _(t):
    return pb.drift_report(_found(t), fx.scenarios(t), warnings=2)


# Every fifth customer has the natural key of the one before it: such keys name no row.
def _target(t):
    key = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") - 2).otherwise(F.col("c_custkey"))
    return t.customer.filter(F.col("c_custkey") % 2 == 0).select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("K"), key.cast("string")).alias("nk"),
        F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("kind"))


_TARGET_SQL = """(SELECT 'r' || c_custkey::VARCHAR AS id, 'K' || (CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 2 ELSE c_custkey END)::VARCHAR AS nk,
  c_acctbal AS amount, c_mktsegment AS kind FROM customer WHERE c_custkey % 2 = 0)"""
_SHARED_SQL = f"(SELECT nk FROM {_TARGET_SQL} GROUP BY nk HAVING count(*) > 1)"


@reg.add("drf5_replay", f"""
WITH q AS (SELECT * FROM {_PLAYED_SQL} WHERE entity = 'Customer'), p AS (SELECT * FROM q WHERE id IS NOT NULL),
k AS (SELECT natural_key AS nk, arg_max(amount, pos) AS amount, arg_max(kind, pos) AS kind, max(pos) AS pos,
  max(pos) FILTER (verb IN ('Create', 'Projection')) AS made FROM q WHERE id IS NULL AND verb <> 'Delete'
  AND natural_key NOT IN {_SHARED_SQL} GROUP BY natural_key),
l AS (SELECT id, max(pos) AS pos, arg_max(natural_key, pos) AS nk, arg_max(verb, pos) AS verb, arg_max(amount, pos) AS amount, arg_max(kind, pos) AS kind,
  max(pos) FILTER (verb = 'Delete') AS gone, max(pos) FILTER (verb IN ('Create', 'Projection')) AS made FROM p GROUP BY id),
s AS (SELECT t.id, t.nk, coalesce(CAST(CASE WHEN k.pos > coalesce(l.pos, 0) THEN k.amount ELSE l.amount END AS DOUBLE), t.amount) AS amount,
  coalesce(CASE WHEN k.pos > coalesce(l.pos, 0) THEN k.kind ELSE l.kind END, t.kind) AS kind,
  CASE WHEN l.id IS NULL AND k.nk IS NULL THEN 'kept' ELSE 'updated' END AS action FROM {_TARGET_SQL} t LEFT JOIN l ON t.id = l.id LEFT JOIN k ON t.nk = k.nk
  WHERE l.id IS NULL OR (verb <> 'Delete' AND (gone IS NULL OR coalesce(l.made > gone, false)))),
f AS (SELECT l.id, l.nk, CAST(l.amount AS DOUBLE) AS amount, l.kind, 'created' AS action FROM l WHERE verb <> 'Delete' AND made IS NOT NULL
  AND (gone IS NULL OR made > gone) AND id NOT IN (SELECT id FROM {_TARGET_SQL}))
SELECT * FROM s UNION ALL SELECT * FROM f UNION ALL
SELECT NULL, nk, CAST(amount AS DOUBLE), kind, 'created' FROM k WHERE made IS NOT NULL AND nk NOT IN (SELECT nk FROM s) AND nk NOT IN (SELECT nk FROM f)""")
def _(t):
    return pb.replay(fx.entities(t), fx.scenarios(t), _target(t), "orders", "customer", "id", "nk", ["amount", "kind"])


@reg.add("drf5_ambiguous_records", f"""
SELECT natural_key, count(*) AS records, any_value(rows) AS rows, any_value(first_id) AS first_id, any_value(last_id) AS last_id FROM {_PLAYED_SQL}
JOIN (SELECT nk, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM {_TARGET_SQL} GROUP BY nk HAVING count(*) > 1) ON nk = natural_key
WHERE entity = 'Customer' AND id IS NULL AND verb <> 'Delete' GROUP BY natural_key""")
def _(t):
    return pb.ambiguous_records(fx.entities(t), fx.scenarios(t), _target(t), "orders", "customer", "id", "nk")


_STEPS_SQL = f"""(SELECT scenario_seq, ordinal, CASE WHEN id IS NULL AND natural_key IN {_SHARED_SQL} THEN 'failed' WHEN verb IN ('Create', 'Projection') THEN CASE WHEN there THEN 'updated' ELSE 'created' END
    WHEN verb = 'Update' THEN CASE WHEN there THEN 'updated' ELSE 'failed' END ELSE CASE WHEN there THEN 'deleted' ELSE 'absent' END END AS step FROM (
  SELECT p.*, coalesce(last_value(CASE WHEN verb IN ('Create', 'Projection') THEN true WHEN verb = 'Delete' THEN false END IGNORE NULLS) OVER (
      PARTITION BY row_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN p.id IS NULL THEN p.natural_key IN (SELECT nk FROM {_TARGET_SQL}) ELSE p.id IN (SELECT id FROM {_TARGET_SQL}) END, false) AS there
  FROM {_PLAYED_SQL} p WHERE verb <> 'Delete' OR id IS NOT NULL)
UNION ALL SELECT scenario_seq, ordinal, 'warning' FROM {_PLAYED_SQL} WHERE verb = 'Delete' AND id IS NULL
UNION ALL SELECT scenario_seq, ordinal, 'skipped' FROM {fx.ENTITIES_SQL} WHERE persisted_via = 'dry-run' OR scenario_seq NOT IN (
  SELECT scenario_seq FROM {fx.SCENARIOS_SQL} WHERE lifecycle = 'Persistent' AND outcome <> 'Skipped'))"""


@reg.add("drf5_replay_steps", f"SELECT * FROM {_STEPS_SQL}")
def _(t):
    return pb.replay_steps(fx.entities(t), fx.scenarios(t), _target(t), "id", "nk", [("orders", "customer"), ("Orders", "ORDER")])


@reg.add("drf6_replay_report", f"""
SELECT *, CASE WHEN failures > 0 THEN 2 WHEN warnings > 0 THEN 1 ELSE 0 END::INT AS exit_code FROM (
  SELECT count(*) FILTER (step = 'created') AS created, count(*) FILTER (step = 'updated') AS updated, count(*) FILTER (step = 'deleted') AS deleted,
    count(*) FILTER (step = 'skipped') AS skipped, count(*) FILTER (step = 'warning') + 3 AS warnings, count(*) FILTER (step = 'failed') AS failures
  FROM {_STEPS_SQL})""")
def _(t):
    return pb.replay_report(pb.replay_steps(fx.entities(t), fx.scenarios(t), _target(t), "id", "nk"), bulk_warnings=3)


@reg.add("drf7_apply_recorded_values", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 12.5 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 4 = 2 THEN 'o_totalprice: Cannot convert "much" to double' WHEN o_orderkey % 4 = 3 THEN 'unknown property colour' WHEN o_orderkey % 4 = 0 THEN 'unknown property ORDERSTATUS' ELSE '' END AS warnings
FROM orders""")
def _(t):
    case = F.col("o_orderkey") % 4
    recorded = (F.when(case == 0, F.create_map(F.lit("O TotalPrice"), F.lit("12.50"), F.lit("ORDERSTATUS"), F.lit("?"), F.lit("o-OrderStatus"), F.lit("X")))
                 .when(case == 1, F.create_map(F.lit("o_orderstatus"), F.lit(None).cast("string"), F.lit("o_totalprice"), F.lit(None).cast("string")))
                 .when(case == 2, F.create_map(F.lit("o_totalprice"), F.lit("much"))).otherwise(F.create_map(F.lit("colour"), F.lit("red"))))
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", recorded.alias("recorded"))
    out = pb.apply_recorded_values(rows, "recorded", ["o_totalprice", "o_orderstatus"], nullable=["o_orderstatus"])
    return out.drop("recorded").withColumn("warnings", F.array_join("warnings", "; "))


@reg.add("drf8_find_recorded", f"""
SELECT row_key, found, CASE WHEN found THEN price_now END AS price FROM {_EXPECTED_SQL}""")
def _(t):
    return _found(t).select("row_key", "found", F.col("actual_values")["o_totalprice"].alias("price"))


@reg.add("drf9_unverifiable_bulk", f"""
SELECT b.scenario_seq, domain, entity, scenario || ': ' || sampled_rows::VARCHAR || ' of ' || count::VARCHAR || ' bulk rows of ' || entity
  || ' were recorded one by one; the rest cannot be checked' AS warning
FROM {fx.BULK_SQL} b JOIN {fx.SCENARIOS_SQL} s ON b.scenario_seq = s.scenario_seq
WHERE hashed_rows > 0 AND lifecycle = 'Persistent' AND outcome <> 'Skipped'""")
def _(t):
    return pb.unverifiable_bulk(fx.bulk(t), fx.scenarios(t))


@reg.add("jrn1_completed_scenarios", f"""
SELECT DISTINCT scenario FROM {fx.JOURNAL_SQL} WHERE kind = 'scenario-complete' AND value IN ('Succeeded', 'CompletedWithWarnings', 'Skipped')""")
def _(t):
    return jr.completed_scenarios(fx.journal(t))


@reg.add("jrn2_persisted_ordinals", f"SELECT DISTINCT scenario, ordinal FROM {fx.JOURNAL_SQL} WHERE kind = 'entity' AND persisted")
def _(t):
    return jr.persisted_ordinals(fx.journal(t))


@reg.add("jrn3_recorded_seeds", f"""
SELECT scenario, arg_max(seed, at_utc) AS recorded_seed FROM {fx.JOURNAL_SQL} WHERE kind = 'scenario-start' GROUP BY scenario""")
def _(t):
    return jr.recorded_seeds(fx.journal(t))


_PLAN_SQL = "(SELECT 'S' || (o_custkey % 200)::VARCHAR AS scenario, o_custkey % 2 AS seed, o_orderkey % 200 AS ordinal, o_orderkey FROM orders)"


@reg.add("jrn4_resume_plan", f"""
SELECT p.* FROM {_PLAN_SQL} p LEFT JOIN (SELECT scenario, arg_max(seed, at_utc) AS was FROM {fx.JOURNAL_SQL} WHERE kind = 'scenario-start' GROUP BY 1) s
  ON p.scenario = s.scenario LEFT JOIN (SELECT DISTINCT scenario, ordinal FROM {fx.JOURNAL_SQL} WHERE kind = 'entity' AND persisted) d
  ON p.scenario = d.scenario AND p.ordinal = d.ordinal
WHERE p.scenario NOT IN (SELECT scenario FROM {fx.JOURNAL_SQL} WHERE kind = 'scenario-complete' AND value <> 'Failed')
  AND (was <> seed OR d.ordinal IS NULL)""")
def _(t):
    plan = t.orders.select(F.concat(F.lit("S"), (F.col("o_custkey") % 200).cast("string")).alias("scenario"),
                           (F.col("o_custkey") % 2).alias("seed"), (F.col("o_orderkey") % 200).alias("ordinal"), "o_orderkey")
    return jr.resume_plan(plan, fx.journal(t))


@reg.add("jrn5_persisted_flag", f"""
SELECT ordinal, persisted_via <> 'dry-run' AND warning IS NULL AS persisted FROM {fx.ENTITIES_SQL}""")
def _(t):
    return fx.entities(t).select("ordinal", jr.persisted_flag(F.col("persisted_via"), F.col("warnings")).alias("persisted"))
