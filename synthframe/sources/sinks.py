"""Writers: bulk rows, run documents, journal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK = 500        # rows per statement against a database
FILE_CHUNK = 1_000_000     # rows per file; small files would cost more than they protect


def write_bulk(df: DataFrame, path: str, chunk: int = FILE_CHUNK) -> None:
    """Append in bounded chunks: no file holds more than ``chunk`` rows, each file commits whole."""
    df.write.mode("append").option("maxRecordsPerFile", chunk).parquet(path)


def write_bulk_jdbc(df: DataFrame, url: str, table: str, chunk: int = DEFAULT_CHUNK, partitions: int | None = None,
                    properties: dict[str, str] | None = None) -> None:
    """Append over JDBC with ``chunk`` rows per statement and at most ``partitions`` connections."""
    options = {"url": url, "dbtable": table, "batchsize": str(chunk), **(properties or {})}
    if partitions:
        options["numPartitions"] = str(partitions)
    df.write.mode("append").format("jdbc").options(**options).save()


def publish_run(runs: DataFrame, store: str) -> None:
    """Store runs under ``env / run_name / started_key``; publishing a run again overwrites that run only."""
    placed = runs.withColumn("started_key", F.date_format("started_utc", "yyyyMMdd'T'HHmmssSSSSSS"))
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("env", "run_name", "started_key").parquet(store))


def write_journal(lines: DataFrame, path: str) -> None:
    """Append journal lines as JSON, with ``at_utc`` as ``atUtc``; every write adds files, none is rewritten."""
    lines.withColumnRenamed("at_utc", "atUtc").write.mode("append").json(path)
