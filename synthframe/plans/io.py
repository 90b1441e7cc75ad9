"""Queries of the source and sink section. What they read back was written from the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import readers as rd, sinks as sk
from ..spec import EntitySpec
from . import fixtures as fx
from .base import Registry

reg = Registry()

CUSTOMER = EntitySpec("Orders", "Customer", T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())]),
    key="c_custkey", natural_key="c_name", id_strategy="db_generated")


@reg.add("src1_read_entity", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return rd.read_entity(t.spark, CUSTOMER, path=f"{t.folder}/customer.parquet")


@reg.add("src2_read_entity_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return rd.read_entity_sample(t.orders.select("o_orderkey", "o_totalprice"), 50, [F.desc("o_totalprice"), "o_orderkey"])


@reg.add("src3_read_dataset", """
SELECT row_number() OVER (ORDER BY p_brand, p_type) - 1 AS row_id, p_brand || ', "' || p_type || '"' AS label, p_type || chr(10) || 'line' AS note, parts
FROM (SELECT p_brand, p_type, count(*)::VARCHAR AS parts FROM part GROUP BY 1, 2)""")
def _(t):
    folder = scratch_path(t.spark, "dataset")
    table = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).cast("string").alias("parts")).repartitionByRange(3, "p_brand", "p_type").sortWithinPartitions("p_brand", "p_type")
    (table.select(F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("Label"), F.concat("p_type", F.lit("\nline")).alias("note"), "parts")
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder))
    out = rd.read_dataset(t.spark, folder)
    return out.select("row_id", F.col(rd.dataset_column(out, "LABEL")).alias("label"), "note", "parts")


# One run document per fifty events, one scenario in it; every part of the document is filled.
def _documents(t):
    e = fx.entities(t)
    entity = F.struct("ordinal", "domain", "entity", "verb", F.col("persisted_via").alias("persistedVia"), "id", F.col("natural_key").alias("naturalKey"),
                      F.col("source").alias("fakerSource"), "values", F.col("overrides").alias("overridesApplied"), "warnings",
                      F.col("duration_ms").alias("durationMs"))
    grouped = e.groupBy(F.floor(F.col("ordinal") / 50).alias("run")).agg(
        F.array_sort(F.collect_list(entity), lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).otherwise(1)).alias("entities"),
        F.sum(F.size("warnings")).alias("w"))  # fifty rows per document at most
    outcome = F.when(F.col("w") > 0, "CompletedWithWarnings").otherwise("Succeeded")
    number, rows = F.col("run").cast("string"), F.size("entities").cast("bigint")
    made = F.filter("entities", lambda x: x["verb"] == "Create")
    references = F.transform(made, lambda x: F.struct(
        F.lit(3).alias("step"), x["ordinal"].alias("sourceOrdinal"), F.concat(F.lit("Customer:"), x["naturalKey"]).alias("target"), F.lit("database").alias("resolvedFrom"), x["id"].alias("id")))
    bulk = F.array(F.struct(F.lit("Orders").alias("domain"), F.lit("Order").alias("entity"), rows.alias("requested"), (rows - 4).alias("hashedRows")))
    unmatched = F.when(F.col("run") % 4 == 0, F.array(F.struct(F.concat(F.lit("wait "), number).alias("text"), F.lit(9).alias("line")))).otherwise(F.array())
    broken = F.when(F.col("run") % 3 == 0, F.array(F.struct(F.lit("maxRows").alias("rule"), F.concat(F.lit("step "), number).alias("message")))).otherwise(F.array())
    slow = F.create_map(F.lit("persist"), F.struct(rows.alias("count"), F.lit(12.5).alias("p95Ms")))
    return grouped.select(
        F.struct(F.concat(F.lit("run-"), number).alias("runId"), F.lit("load").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("startedUtc"), outcome.alias("outcome"),
                 slow.alias("benchmark"), broken.alias("policyViolations")).alias("run"),
        F.array(F.struct(F.lit("F").alias("feature"), F.concat(F.lit("S"), number).alias("scenario"), F.lit(3).alias("line"), outcome.alias("outcome"), "entities",
                         bulk.alias("bulkOperations"), references.alias("references"), unmatched.alias("unmatchedSteps"))).alias("scenarios"))


def _read_back(t):
    folder = scratch_path(t.spark, "runs")
    _documents(t).write.json(folder)
    return rd.read_runs(t.spark, folder, pretty=False)


@reg.add("src4_read_runs", f"""
SELECT 'run-' || (ordinal // 50)::VARCHAR AS run_id, 'S' || (ordinal // 50)::VARCHAR AS scenario, ordinal, verb, id, natural_key, amount, source,
  CASE WHEN warning IS NULL THEN 0 ELSE 1 END::INT AS warnings FROM {fx.ENTITIES_SQL}""")
def _(t):
    tables = _read_back(t)
    scenarios = tables["scenarios"].select("run_id", "scenario_seq", "scenario")
    return tables["entities"].join(scenarios, ["run_id", "scenario_seq"]).select(
        "run_id", "scenario", "ordinal", "verb", "id", "natural_key", F.col("values")["amount"].alias("amount"), "source",
        F.size("warnings").alias("warnings"))


@reg.add("src4_read_runs_tables", f"""
WITH e AS (SELECT *, ordinal // 50 AS run FROM {fx.ENTITIES_SQL}),
r AS (SELECT run, count(*) AS n, CASE WHEN count(warning) > 0 THEN 'CompletedWithWarnings' ELSE 'Succeeded' END AS outcome FROM e GROUP BY run)
SELECT part, 'run-' || run::VARCHAR AS run_id, line FROM (
  SELECT 'runs' AS part, run, 'load 2024-01-01 ' || outcome AS line FROM r UNION ALL
  SELECT 'scenarios', run, 'F S' || run::VARCHAR || ' 3 ' || outcome FROM r UNION ALL
  SELECT 'entities', run, ordinal::VARCHAR || ' ' || verb || ' ' || persisted_via || ' ' || coalesce(id, '-') FROM e UNION ALL
  SELECT 'bulk_operations', run, 'Order ' || n::VARCHAR || ' ' || (n - 4)::VARCHAR FROM r UNION ALL
  SELECT 'references', run, ordinal::VARCHAR || ' Customer:' || natural_key || ' database ' || coalesce(id, '-') FROM e WHERE verb = 'Create' UNION ALL
  SELECT 'unmatched_steps', run, 'wait ' || run::VARCHAR || ' 9' FROM r WHERE run % 4 = 0 UNION ALL
  SELECT 'benchmark', run, 'persist ' || n::VARCHAR || ' 12.5' FROM r UNION ALL
  SELECT 'policy_violations', run, 'maxRows step ' || run::VARCHAR FROM r WHERE run % 3 = 0)""")
def _(t):
    """Every table of the documents, a line of text per row."""
    tables = _read_back(t)
    shown = {"runs": ("name", F.date_format("started_utc", "yyyy-MM-dd"), "outcome"), "scenarios": ("feature", "scenario", "line", "outcome"),
             "entities": ("ordinal", "verb", "persisted_via", "id"), "bulk_operations": ("entity", "requested", "hashed_rows"),
             "references": ("source_ordinal", "target", "resolved_from", "id"), "unmatched_steps": ("text", "line"),
             "benchmark": ("operation", "count", "p95Ms"), "policy_violations": ("rule", "message")}
    texts = {part: [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns] for part, columns in shown.items()}
    return reduce(DataFrame.unionByName, [tables[p].select(F.lit(p).alias("part"), "run_id", F.concat_ws(" ", *cells).alias("line")) for p, cells in texts.items()])


@reg.add("src5_read_journal", f"""
SELECT kind, scenario, value, seed, ordinal, persisted FROM {fx.JOURNAL_SQL.replace('FROM events', 'FROM events WHERE event_id % 100 NOT IN (17, 18, 19)')}""")
def _(t):
    folder = scratch_path(t.spark, "journal")
    i = F.col("_i")
    lines = _numbered_journal(t)
    text = F.to_json(F.struct(*[c for c in lines.columns if c != "_i"]))
    broken = F.when(i % 100 == 17, F.expr("substring(text, 1, length(text) - 9)")).when(i % 100 == 18, F.lit("")).otherwise(F.col("text"))
    lines.withColumn("text", text).select(broken.alias("value")).write.text(folder)
    return rd.read_journal(t.spark, folder).select("kind", "scenario", "value", "seed", "ordinal", "persisted")


def _numbered_journal(t):
    """Journal lines with the event number; every hundredth has no scenario."""
    kind, i = F.col("event_type"), F.col("event_id")
    verdict = F.when(i % 11 == 0, "Succeeded").when(i % 11 == 7, "CompletedWithWarnings").otherwise("Failed")
    return t.events.select(
        i.alias("_i"), F.when(kind == "signup", "scenario-start").when(kind == "purchase", "scenario-complete").otherwise("entity").alias("kind"),
        F.when(i % 100 != 19, F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("scenario"),
        F.when(kind == "purchase", verdict).alias("value"), F.when(kind == "signup", i % 3).alias("seed"),
        F.when(~kind.isin("signup", "purchase"), i % 200).alias("ordinal"), (kind != "error").alias("persisted"), F.col("ts").alias("at_utc"))


@reg.add("snk1_write_bulk", """
SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, true AS chunks_bounded FROM orders""")
def _(t):
    path = scratch_path(t.spark, "bulk")
    sk.write_bulk(t.orders.select("o_orderkey", "o_totalprice"), path, chunk=1000)
    files = t.spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("k"))
    return files.agg(F.sum("n").alias("rows"), F.sum("k").alias("keys"), (F.max("n") <= 1000).alias("chunks_bounded"))


def _published(t):
    """Runs per day, published twice: the second time with their final outcome."""
    store = scratch_path(t.spark, "store")
    runs = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("started_utc")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("duration_ms"))
    named = runs.select(F.when(F.dayofmonth("started_utc") % 2 == 0, "ci").otherwise("prod").alias("env"), F.lit("nightly").alias("run_name"),
                        "started_utc", F.lit("Running").alias("outcome"), "duration_ms", "rows")
    sk.publish_run(named, store)
    sk.publish_run(named.filter(F.dayofmonth("started_utc") % 3 == 0).withColumn("outcome", F.lit("Succeeded")), store)
    return store


_STORE_SQL = """SELECT CASE WHEN day(d) % 2 = 0 THEN 'ci' ELSE 'prod' END AS env, 'nightly' AS run_name, strftime(d, '%Y-%m-%d') AS started,
  CASE WHEN day(d) % 3 = 0 THEN 'Succeeded' ELSE 'Running' END AS outcome, duration_ms FROM (
  SELECT date_trunc('day', ts) AS d, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS duration_ms FROM events GROUP BY 1)"""


@reg.add("snk2_publish_run", _STORE_SQL)
def _(t):
    return t.spark.read.parquet(_published(t)).select(
        "env", "run_name", F.date_format("started_utc", "yyyy-MM-dd").alias("started"), "outcome", "duration_ms")


@reg.add("snk3_trend_index", _STORE_SQL)
def _(t):
    return rd.trend_index(t.spark, _published(t)).select(
        "env", "run_name", F.date_format("started_utc", "yyyy-MM-dd").alias("started"), "outcome", "duration_ms")


@reg.add("snk4_write_journal", f"""
SELECT kind, scenario, ordinal, persisted, count(*) AS lines FROM {fx.JOURNAL_SQL} GROUP BY 1, 2, 3, 4""")
def _(t):
    folder = scratch_path(t.spark, "journal")
    lines = fx.journal(t)
    for flag in (True, False):  # two finished write batches, each appended
        sk.write_journal(lines.filter(F.col("persisted") == flag), folder)
    return rd.read_journal(t.spark, folder).groupBy("kind", "scenario", "ordinal", "persisted").agg(F.count(F.lit(1)).alias("lines"))
