"""Compare registered queries with their SQL in DuckDB: ``check_oracle.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from synthframe.plans.catalogue import all_oracles, all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("synthframe-check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    return repr(value) if not isinstance(value, str) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r)))
    return [columns[i] for i in order], body


def compare(spark, con, folder, name, inspect=None):
    """None when equal, else a short description of the first difference. ``inspect`` sees the query's DataFrame first."""
    df = all_queries()[name](spark, folder)
    if inspect is not None:
        inspect(df)
    got_columns, got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = all_oracles().get(name)
    if sql is None:
        return None, len(got), "rows only"
    cursor = con.execute(sql)
    want_columns, want = table([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got), "sql"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} duck {want[:2]}", len(got), "sql"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} rows differ; spark {bad[0][0]} duck {bad[0][1]}" if bad else None), len(got), "sql"


def main(arguments):
    sf = arguments[0] if arguments else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = [n for n in all_queries() if not arguments[1:] or any(n.startswith(p) for p in arguments[1:])]
    spark, con = session(), duck(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem, rows, kind = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem, rows, kind = f"{type(error).__name__}: {str(error)[:600]}", -1, "error"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:34s} rows={rows:<7d} {kind:9s} "
              f"{time.time() - started:5.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
