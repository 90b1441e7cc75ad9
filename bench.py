"""Timing of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

import pyspark.sql.functions as F
from pyspark.sql import SparkSession

from synthframe.operators.generate import generate, ordinals
from synthframe.plans.catalogue import all_queries
from synthframe.plans.generation import order_plan

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 2
GENERATED_ROWS = 2_000_000

HEADLINES = (
    "flagship_orders_by_status", "gen11_apply_statistics", "gen22_generate_scenarios", "id5_assign_sequence_key",
    "vrb6_create_or_reuse", "vrb9_update_by_key", "vrb15_concurrent_winner", "jn1_resolve_fk", "jn2_resolve_precedence",
    "man5_values_hash", "man6_bulk_summary", "drf1_fold_expected", "drf3_drift_values", "drf5_replay", "jrn4_resume_plan",
    "prf1_profile_counts", "prf2_profile_moments", "prf5_category_weights", "ben2_bench_two_grains", "ben4_median_baseline",
    "lin2_lineage_edges", "reg3_lease_conflicts", "str2_throughput", "str5_latency_alerts",
)


def _session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("synthframe-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    spark = _session()
    catalogue = all_queries()
    runs = {name: (lambda q=catalogue[name]: q(spark, FOLDER).write.format("noop").mode("overwrite").save()) for name in HEADLINES}
    # rows per second of seeded generation, the one rate that can be set against a published figure
    runs["generate_2m_orders"] = lambda: generate(ordinals(spark, GENERATED_ROWS), order_plan()).agg(
        F.count("Status"), F.sum("Total"), F.max("Id")).collect()
    seconds: dict[str, float] = {}
    for name, run in runs.items():
        run()  # warm-up: class loading and code generation are not what is measured
        seconds[name] = round(min(_timed(run) for _ in range(ROUNDS)), 4)
    print(json.dumps({
        "metric": "headline_queries_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": int(CPUS),
        "generated_rows_per_second": round(GENERATED_ROWS / seconds["generate_2m_orders"]),
    }))


if __name__ == "__main__":
    main()
