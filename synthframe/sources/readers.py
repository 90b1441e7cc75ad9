"""Readers: entity tables, datasets, run documents, journals, the store of published runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import Dataset
from ..operators.sequence import dense_sequence
from ..spec import EntitySpec

# Shape of a run document.
_ENTITY = ("ordinal long, domain string, entity string, verb string, persistedVia string, id string, idStrategy string, "
           "naturalKey string, fakerSource string, values map<string,string>, overridesApplied array<string>, "
           "warnings array<string>, durationMs double")
_BULK = ("domain string, entity string, requested long, count long, failed long, mode string, sampledRows long, hashedRows long, "
         "valuesSha256 string, firstOrdinal long, lastOrdinal long, durationMs double")
_REFERENCE = ("step int, sourceOrdinal long, target string, resolvedFrom string, id string, owningDomain string, mode string, verifyOutcome string")
_STATS = "count long, totalMs double, meanMs double, p50Ms double, p95Ms double, maxMs double"
RUN_SCHEMA = (
    "run struct<runId: string, name: string, startedUtc: string, durationMs: double, failurePolicy: string, lifecycle: string, "
    f"dryRun: boolean, outcome: string, environment: string, benchmark: map<string, struct<{_STATS}>>, "
    "policyViolations: array<struct<rule: string, message: string>>>, "
    "scenarios array<struct<feature: string, scenario: string, line: int, seed: long, tags: array<string>, lifecycle: string, "
    f"outcome: string, warnings: array<string>, entities: array<struct<{_ENTITY}>>, bulkOperations: array<struct<{_BULK}>>, "
    f"references: array<struct<{_REFERENCE}>>, unmatchedSteps: array<struct<text: string, line: int>>>>")

JOURNAL_SCHEMA = ("kind string, scenario string, value string, seed long, ordinal long, entity string, verb string, id string, "
                  "persisted boolean, atUtc timestamp")


def read_entity(spark: SparkSession, spec: EntitySpec, path: str | None = None, table: str | None = None,
                jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Full scan of one entity table, from Parquet, the catalog or JDBC; the schema comes from the spec."""
    if path is not None:
        return spark.read.schema(spec.schema).parquet(path)
    source = spark.table(table) if table is not None else spark.read.format("jdbc").options(**jdbc).load()
    return source.select(*[F.col(f.name).cast(f.dataType) for f in spec.schema.fields])


def read_entity_sample(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; with ``order`` always the same ones (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def _dataset_rows(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Text cells of the files with ``_file`` and ``_line``, which order the rows of a file."""
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("inferSchema", False)
          .csv(paths))
    if not df.columns:
        raise ValueError(f"{paths}: a dataset needs a header")
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\r$", "").alias(c.strip()) for c in df.columns]
    # a file with quoted line breaks is never split, so the numbers of one task grow along it
    return df.select(*cells, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))


def read_dataset(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Correlated tuples from CSV files: header, quoted line breaks, doubled quotes, text columns.

    Blank lines are skipped. All files have the same header; another one stops the job. ``row_id`` is dense from 0, by
    the files' paths and the rows' order inside each: every file is read by one task and numbered behind those before it.
    """
    rows = _dataset_rows(spark, paths)
    if rows.isEmpty():
        raise ValueError(f"{paths}: a dataset needs at least one row")
    return dense_sequence(rows, ["_file", "_line"], "row_id", start=0).drop("_file", "_line")


def load_dataset(spark: SparkSession, name: str, paths: Sequence[str] | str) -> Dataset:
    """Files to a dataset for correlated draws. Its row count is that of the numbered table, not the caller's."""
    table = read_dataset(spark, paths)
    return Dataset(name, table, table.count())


def dataset_column(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"unknown dataset column '{name}': {', '.join(df.columns)}")


def read_runs(spark: SparkSession, paths: Sequence[str] | str, pretty: bool = True) -> dict[str, DataFrame]:
    """Run documents as flat tables: runs, scenarios, entities, bulk_operations, references,
    unmatched_steps, benchmark, policy_violations.

    ``pretty`` reads one document per file; otherwise a file has one document per line.
    """
    docs = spark.read.schema(RUN_SCHEMA).option("multiLine", pretty).json(paths)
    run_id = F.coalesce("run.runId", "run.startedUtc").alias("run_id")
    scenario = docs.select(run_id, F.posexplode("scenarios").alias("scenario_seq", "s"))

    def inner(field: str) -> DataFrame:
        return scenario.select("run_id", "scenario_seq", F.explode(f"s.{field}").alias("x")).select("run_id", "scenario_seq", "x.*")

    def snake(df: DataFrame) -> DataFrame:
        return df.toDF(*["".join("_" + ch.lower() if ch.isupper() else ch for ch in c) for c in df.columns])

    runs = docs.select(run_id, "run.*").drop("runId", "benchmark", "policyViolations")
    stats = docs.select(run_id, F.explode("run.benchmark").alias("operation", "b")).select("run_id", "operation", "b.*")
    return {
        "runs": snake(runs).withColumn("started_utc", F.col("started_utc").try_cast("timestamp")),
        "scenarios": snake(scenario.select("run_id", "scenario_seq", "s.*").drop("entities", "bulkOperations", "references", "unmatchedSteps")),
        "entities": snake(inner("entities")).withColumnsRenamed({"faker_source": "source", "overrides_applied": "overrides"}),
        "bulk_operations": snake(inner("bulkOperations")),
        "references": snake(inner("references")),
        "unmatched_steps": snake(inner("unmatchedSteps")),
        "benchmark": stats,
        "policy_violations": docs.select(run_id, F.explode("run.policyViolations").alias("v")).select("run_id", "v.*"),
    }


def read_journal(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Journal lines, times as ``at_utc``, and ``position``, which orders the lines of a file.

    A line cut off by a crash, a blank line, or one without a scenario is ignored.
    """
    lines = spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(paths)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.withColumn("position", place).withColumnRenamed("atUtc", "at_utc").filter(F.col("scenario").isNotNull())


def trend_index(spark: SparkSession, store: str) -> DataFrame:
    """One row per stored run, by start, the newest last. Only the run rows' columns are read."""
    runs = spark.read.parquet(store)
    return runs.select("env", "run_name", "started_key", "started_utc", "outcome", "duration_ms").orderBy("started_utc")
