"""Run records derived from the driver tables, in Spark and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

# One scenario per user, one record per event; rows are 997 keys written again and again.
ENTITIES_SQL = """(SELECT user_id::INT AS scenario_seq, event_id AS ordinal, 'Orders' AS domain,
  CASE WHEN event_id % 2 = 0 THEN 'Customer' ELSE 'Order' END AS entity,
  CASE event_type WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'Update' WHEN 'signup' THEN 'Projection' ELSE 'Create' END AS verb,
  CASE WHEN event_id % 50 = 0 THEN 'dry-run' ELSE 'DbContext' END AS persisted_via,
  CASE WHEN event_type = 'error' AND event_id % 40 = 1 THEN NULL WHEN event_type <> 'error' AND event_id % 11 = 0 THEN NULL
    ELSE 'r' || (event_id * 7 % 997)::VARCHAR END AS id,
  CASE WHEN event_id % 3 = 0 THEN 'Deterministic' WHEN event_id % 3 = 1 THEN 'ClientSet' ELSE 'DbGenerated' END AS id_strategy,
  'K' || (event_id * 7 % 997)::VARCHAR AS natural_key,
  CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto+plugin:sku+distributions' WHEN 2 THEN 'CustomerFaker+datasets' END AS source,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount, event_type AS kind, event_id % 4 = 0 AS has_override,
  CASE WHEN event_id % 97 = 0 THEN 'late write ' || event_id::VARCHAR END AS warning, value AS duration_ms FROM events)"""

SCENARIOS_SQL = """(SELECT scenario_seq, 'F' || (scenario_seq % 7)::VARCHAR AS feature, 'S' || scenario_seq::VARCHAR AS scenario,
  10 + scenario_seq AS line, seed,
  CASE scenario_seq % 10 WHEN 0 THEN 'Transactional' WHEN 1 THEN 'TrackedTeardown' ELSE 'Persistent' END AS lifecycle,
  scenario_seq % 13 = 0 AS skipped, scenario_seq % 17 = 0 AS failed,
  CASE WHEN scenario_seq % 13 = 0 THEN 'Skipped' WHEN scenario_seq % 17 = 0 THEN 'Failed' WHEN scenario_seq % 5 = 0
    THEN 'CompletedWithWarnings' ELSE 'Succeeded' END AS outcome,
  CASE WHEN scenario_seq % 5 = 0 THEN 'slow step' END AS warning
  FROM (SELECT user_id::INT AS scenario_seq, min(event_id) AS seed FROM events GROUP BY user_id))"""

UNMATCHED_SQL = """(SELECT user_id::INT AS scenario_seq, 'wait ' || event_id::VARCHAR AS text, (event_id % 90)::INT AS line
  FROM events WHERE event_id % 501 = 0)"""

BULK_SQL = """(SELECT user_id::INT AS scenario_seq, 'Orders' AS domain, event_type AS entity, count(*) AS count,
  least(count(*), 4) AS sampled_rows, count(*) - least(count(*), 4) AS hashed_rows,
  CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS duration_ms FROM events GROUP BY 1, 3)"""


def entities(t):
    i, kind = F.col("event_id"), F.col("event_type")
    key = (i * 7 % 997).cast("string")
    warning = F.when(i % 97 == 0, F.concat(F.lit("late write "), i.cast("string")))
    return t.events.select(
        F.col("user_id").cast("int").alias("scenario_seq"), i.alias("ordinal"), F.lit("Orders").alias("domain"),
        F.when(i % 2 == 0, "Customer").otherwise("Order").alias("entity"),
        F.when(kind == "error", "Delete").when(kind == "view", "Update").when(kind == "signup", "Projection").otherwise("Create").alias("verb"),
        F.when(i % 50 == 0, "dry-run").otherwise("DbContext").alias("persisted_via"),
        F.when((kind == "error") & (i % 40 == 1), F.lit(None)).when((kind != "error") & (i % 11 == 0), F.lit(None))
         .otherwise(F.concat(F.lit("r"), key)).alias("id"),
        F.when(i % 3 == 0, "Deterministic").when(i % 3 == 1, "ClientSet").otherwise("DbGenerated").alias("id_strategy"),
        F.concat(F.lit("K"), key).alias("natural_key"),
        F.when(i % 4 == 0, "auto").when(i % 4 == 1, "auto+plugin:sku+distributions").when(i % 4 == 2, "CustomerFaker+datasets").alias("source"),
        F.create_map(F.lit("amount"), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("kind"), kind).alias("values"),
        F.when(i % 4 == 0, F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>")).alias("overrides"),
        F.when(warning.isNotNull(), F.array(warning)).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.col("value").alias("duration_ms"))


def scenarios(t):
    seq = F.col("scenario_seq")
    base = t.events.groupBy(F.col("user_id").cast("int").alias("scenario_seq")).agg(F.min("event_id").alias("seed"))
    return base.select(
        seq, F.concat(F.lit("F"), (seq % 7).cast("string")).alias("feature"), F.concat(F.lit("S"), seq.cast("string")).alias("scenario"),
        (seq + 10).alias("line"), "seed",
        F.when(seq % 10 == 0, "Transactional").when(seq % 10 == 1, "TrackedTeardown").otherwise("Persistent").alias("lifecycle"),
        (seq % 13 == 0).alias("skipped"), (seq % 17 == 0).alias("failed"),
        F.when(seq % 13 == 0, "Skipped").when(seq % 17 == 0, "Failed").when(seq % 5 == 0, "CompletedWithWarnings")
         .otherwise("Succeeded").alias("outcome"),
        F.when(seq % 5 == 0, F.array(F.lit("slow step"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def unmatched(t):
    return t.events.filter(F.col("event_id") % 501 == 0).select(
        F.col("user_id").cast("int").alias("scenario_seq"), F.concat(F.lit("wait "), F.col("event_id").cast("string")).alias("text"),
        (F.col("event_id") % 90).cast("int").alias("line"))


def bulk(t):
    grouped = t.events.groupBy(F.col("user_id").cast("int").alias("scenario_seq"), F.col("event_type").alias("entity")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("duration_ms"))
    kept = F.least(F.col("count"), F.lit(4).cast("bigint"))
    return grouped.select("scenario_seq", F.lit("Orders").alias("domain"), "entity", "count", F.lit("Sample").alias("mode"),
                          kept.alias("sampled_rows"), (F.col("count") - kept).alias("hashed_rows"), "duration_ms")


# One journal line per event.
JOURNAL_SQL = """(SELECT CASE event_type WHEN 'signup' THEN 'scenario-start' WHEN 'purchase' THEN 'scenario-complete' ELSE 'entity' END AS kind,
  'S' || user_id::VARCHAR AS scenario,
  CASE WHEN event_type = 'purchase' THEN ['Succeeded', 'Failed', 'Failed', 'Failed', 'Failed', 'Failed', 'Failed',
    'CompletedWithWarnings', 'Failed', 'Failed', 'Failed'][(event_id % 11 + 1)::INT] END AS value,
  CASE WHEN event_type = 'signup' THEN event_id % 3 END AS seed,
  CASE WHEN event_type NOT IN ('signup', 'purchase') THEN event_id % 200 END AS ordinal,
  event_type <> 'error' AS persisted, ts AS at_utc FROM events)"""


def journal(t):
    kind, i = F.col("event_type"), F.col("event_id")
    verdict = F.when(i % 11 == 0, "Succeeded").when(i % 11 == 7, "CompletedWithWarnings").otherwise("Failed")
    return t.events.select(
        F.when(kind == "signup", "scenario-start").when(kind == "purchase", "scenario-complete").otherwise("entity").alias("kind"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("scenario"),
        F.when(kind == "purchase", verdict).alias("value"), F.when(kind == "signup", i % 3).alias("seed"),
        F.when(~kind.isin("signup", "purchase"), i % 200).alias("ordinal"),
        (kind != "error").alias("persisted"), F.col("ts").alias("at_utc"))


# Steps of scenarios: one per (day, priority) of the orders, with how many rows they ask for.
STEPS_SQL = """(SELECT 'S' || (year(o_orderdate) * 12 + month(o_orderdate))::VARCHAR AS scenario, o_orderstatus AS entity,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'delete' ELSE 'create' END AS verb, o_orderpriority AS step, count(*) AS count,
  CASE WHEN count(*) % 2 = 0 THEN count(*) + 3 END AS inline_rows FROM orders GROUP BY 1, 2, 3, 4)"""


def steps(t):
    grouped = t.orders.groupBy(
        F.concat(F.lit("S"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("string")).alias("scenario"),
        F.col("o_orderstatus").alias("entity"), F.when(F.col("o_orderpriority") == "5-LOW", "delete").otherwise("create").alias("verb"),
        F.col("o_orderpriority").alias("step")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.withColumn("inline_rows", F.when(F.col("count") % 2 == 0, F.col("count") + 3))
