"""Verbs, records, playback, profiling and timing on small golden inputs."""

import pytest
from pyspark.sql import functions as F

from synthframe.operators import benchmarks as bn, journal as jr, lineage as ln, playback as pb, profiling as pr, records as rc, references as rf, rules as rl, verbs as vb
from synthframe.session import scratch_path
from synthframe.sources import readers as rd
from synthframe.streaming import streams as st
from synthframe.plans import fixtures as fx
from synthframe.plans.streams import _p95, _stream


def test_upsert_twice_is_upsert_once(spark, rows):
    target = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "z", 3)], "nk string, status string, id int")
    batch = spark.createDataFrame([("a", "N", 10, 1, "S1"), ("a", "N", 11, 2, None), ("a", "N", 12, 3, "S3"), ("c", "N", 13, 4, "S4")],
                                  "nk string, status string, id int, n int, set_status string")
    once = vb.create_or_reuse(target, batch, "nk", ["n"], {"status": "set_status"})
    assert rows(once) == sorted([("a", "S3", 1, "updated"), ("b", "y", 2, "kept"), ("b", "z", 3, "kept"), ("c", "S4", 13, "inserted")], key=str)
    twice = vb.create_or_reuse(once.drop("action"), batch, "nk", ["n"], {"status": "set_status"})
    assert rows(twice.drop("action")) == rows(once.drop("action"))


def test_delete_where_is_null_safe(spark):
    df = spark.createDataFrame([(1, "R"), (2, None), (3, "A")], "id int, flag string")
    assert [r["id"] for r in vb.delete_where(df, {"flag": "R"}).orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in vb.delete_where(df, {"flag": "null"}).orderBy("id").collect()] == [1, 3]
    assert vb.delete_where(df, {}).count() == 0


def test_bad_filters_are_plan_errors(spark):
    df = spark.createDataFrame([(1, "R")], "id int, flag string")
    with pytest.raises(ValueError, match="not found"):
        vb.filter_eq(df, {"colour": "red"})
    with pytest.raises(ValueError, match="Cannot convert"):
        vb.filter_eq(df, {"id": "one"})


def test_failure_policies(spark):
    df = vb.convert_columns(spark.createDataFrame([(1, "5"), (2, "five")], "id int, n string"), {"n": "int"})
    kept, rejects = vb.route_failures(df, "best_effort")
    assert kept.count() == 2 and rejects.count() == 0
    kept, rejects = vb.route_failures(df, "fail_object")
    assert [r["id"] for r in kept.collect()] == [1] and [r["id"] for r in rejects.collect()] == [2]
    with pytest.raises(vb.StepFailed, match="five"):
        vb.route_failures(df, "fail_run")


def test_ambiguous_parent_is_not_linked(spark):
    parent = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "nk string, id int")
    child = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r"), ("d", None)], "c string, ref string")
    got = {r["c"]: r["fk"] for r in rf.resolve_fk(child, parent, "ref", "nk", "id", "fk").collect()}
    assert got == {"a": None, "b": 3, "c": None, "d": None}


def test_bulk_sample_keeps_head_and_tail(spark):
    df = spark.range(1, 13).select(F.lit("op").alias("op"), F.col("id").alias("n"), F.lit(False).alias("failed"), F.col("id").cast("string").alias("t"))
    sampled = rc.head_tail_sample(df, ["op"], "n", "failed", k=2)
    assert sorted(r["n"] for r in sampled.filter("kept").collect()) == [1, 2, 11, 12]
    summary = rc.bulk_summary(sampled, ["op"], "n", "failed", "t").first()
    assert (summary["sampled_rows"], summary["hashed_rows"], summary["first_ordinal"], summary["last_ordinal"]) == (4, 8, 1, 12)


def test_nothing_hashed_means_no_hash(spark):
    df = spark.range(1, 4).select(F.lit("op").alias("op"), F.col("id").alias("n"), F.lit(False).alias("failed"), F.lit("x").alias("t"))
    row = rc.bulk_summary(rc.head_tail_sample(df, ["op"], "n", "failed", k=2), ["op"], "n", "failed", "t").first()
    assert row["hashed_rows"] == 0 and row["values_sha256"] is None


def test_replay_then_verify_is_clean(tables):
    entities, scenarios = fx.entities(tables), fx.scenarios(tables)
    # created rows keep their id, so verification finds them; delete-alls are left out: they cannot be replayed
    entities = entities.filter(~((F.col("verb") == "Delete") & F.col("id").isNull()) & (F.col("entity") == "Customer") & F.col("id").isNotNull())
    target = tables.customer.limit(0).select(F.col("c_name").alias("id"), F.col("c_name").alias("nk"), F.col("c_acctbal").alias("amount"),
                                             F.col("c_mktsegment").alias("kind"))
    after = pb.replay(entities, scenarios, target, "Orders", "Customer", "id", "nk", ["amount", "kind"]).drop("action")
    expected = pb.fold_expected(entities, scenarios)
    # updates of rows that never existed fail on replay and stay missing
    found = pb.find_recorded(expected, after, "id", "nk", ["amount", "kind"])
    assert pb.drift_values(found).count() == 0
    assert {r["drift"] for r in pb.drift_rows(found).collect()} <= {"missing"}
    again = pb.replay(entities, scenarios, after, "Orders", "Customer", "id", "nk", ["amount", "kind"]).drop("action")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)


def test_resume_after_everything_is_empty(spark):
    plan = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("t", 1, 1)], "scenario string, seed long, ordinal long")
    lines = [("entity", "s", None, None, 1, True), ("entity", "s", None, None, 2, True), ("scenario-complete", "t", "Succeeded", None, None, None),
             ("scenario-start", "s", None, 1, None, None)]
    journal = spark.createDataFrame(lines, "kind string, scenario string, value string, seed long, ordinal long, persisted boolean").withColumn("at_utc", F.lit(0))
    assert jr.resume_plan(plan, journal).count() == 0
    other_seed = plan.withColumn("seed", F.lit(2).cast("long"))
    assert jr.resume_plan(other_seed, journal).count() == 2


def test_profile_golden(spark):
    data = [(i, f"c{i}", "Gold" if i < 60 else "Silver" if i < 90 else "Bronze", 10.0 if i < 90 else 1000.0) for i in range(100)]
    df = spark.createDataFrame(data, "id int, name string, tier string, limit double")
    profiled = {r["property"]: r for r in pr.profile(df, skip=["id"]).collect()}
    limit = profiled["limit"]
    assert (limit["min"], limit["max"], limit["mean"], limit["median"]) == (10.0, 1000.0, 109.0, 10.0)
    assert (limit["distribution"], limit["fit_mean"], limit["fit_min"]) == ("lognormal", 10.0, 0.0)
    assert profiled["tier"]["weights"] == {"Gold": 0.6, "Silver": 0.3, "Bronze": 0.1}
    assert profiled["name"]["weights"] is None and profiled["name"]["distinct"] == 100
    assert set(pr.to_config(pr.profile(df, skip=["id"]), "Customer")["Customer"]) == {"limit", "tier"}
    hidden = pr.profile(df, skip=["id"], include_values=False)
    assert "weights" not in hidden.columns


def test_correlation_hint(spark):
    data = [(i, ("EUR", "USD", "NOK")[i % 3], i % 3 == 0, ("a", "b")[i // 3 % 2]) for i in range(100)]
    df = spark.createDataFrame(data, "id int, currency string, active boolean, other string")
    got = [(r["left"], r["right"]) for r in pr.correlation_hints(df, ["currency", "active", "other"]).collect()]
    assert got == [("currency", "active")]


def test_few_rows_get_no_distribution(spark):
    assert pr.fit_distribution(spark.range(19), ["id"]).count() == 0
    assert pr.fit_distribution(spark.range(30).select(F.lit(1.0).alias("x")), ["x"]).count() == 0


def test_nearest_rank_percentiles(spark):
    df = spark.range(1, 101).select(F.lit("persist").alias("operation"), F.col("id").cast("double").alias("ms"))
    row = bn.bench_stats(df, ["operation"]).first()
    assert (row["count"], row["p50Ms"], row["p95Ms"], row["maxMs"], row["meanMs"], row["totalMs"]) == (100, 50.0, 95.0, 100.0, 50.5, 5050.0)


STATS = "key string, count long, totalMs double, meanMs double, p50Ms double, p95Ms double, maxMs double"


def stats(spark, *pairs):
    return spark.createDataFrame([(k, 1, v, v, v, v, v) for k, v in pairs], STATS)


def test_gates(spark):
    rules = spark.createDataFrame([("persist", "p95Ms", 20.0), ("gone", "p95Ms", 20.0), ("persist", "wrong", 1.0), ("zero", "p95Ms", 1.0)],
                                  "operation string, stat string, max_regression_pct double")

    def passed(value):
        out = bn.gates(stats(spark, ("PERSIST", value), ("zero", 5.0)), stats(spark, ("persist", 100.0), ("zero", 0.0)), rules).collect()
        return {(r["operation"], r["stat"]): (r["passed"], r["regression_pct"]) for r in out}

    assert passed(125.0)[("persist", "p95Ms")] == (False, 25.0)
    assert passed(115.0)[("persist", "p95Ms")] == (True, 15.0)
    assert passed(115.0)[("gone", "p95Ms")] == (True, None)
    assert passed(115.0)[("persist", "wrong")] == (True, None)
    assert passed(115.0)[("zero", "p95Ms")] == (True, None)


def test_median_baseline(spark):
    history = stats(spark, ("persist", 100.0), ("PERSIST", 500.0), ("persist", 110.0), ("other", 1.0), ("other", 2.0))
    got = {r["key"].lower(): r["p95Ms"] for r in bn.median_baseline(history).collect()}
    assert got == {"persist": 110.0, "other": 1.5}


def test_unknown_environment_is_one_finding(spark):
    out = rl.rule_report(spark, {"prod": {}}, "moon", None, None).collect()
    assert len(out) == 1 and out[0]["rule"] == "UnknownEnvironment"


def test_dataset_file(spark, tmp_path):
    path = tmp_path / "carriers.csv"
    path.write_bytes(b'Carrier,Level\r\n"North, ""fast""",Next day\r\n\r\n"South\nline",2\r\n')
    out = rd.read_dataset(spark, str(path)).orderBy("row_id").collect()
    assert [tuple(r) for r in out] == [('North, "fast"', "Next day", 0), ("South\nline", "2", 1)]
    with pytest.raises(ValueError, match="unknown dataset column"):
        rd.dataset_column(rd.read_dataset(spark, str(path)), "colour")
    empty = tmp_path / "empty.csv"
    empty.write_text("Carrier,Level\n")
    with pytest.raises(ValueError, match="at least one row"):
        rd.read_dataset(spark, str(empty))


def test_pretty_run_document(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text("""{
  "run": {"runId": "r1", "name": "nightly", "startedUtc": "2024-01-02T03:04:05Z", "outcome": "Succeeded",
    "benchmark": {"persist": {"count": 2, "totalMs": 3.0, "meanMs": 1.5, "p50Ms": 1.0, "p95Ms": 2.0, "maxMs": 2.0}}},
  "scenarios": [{"feature": "f", "scenario": "s", "line": 1, "entities": [{"ordinal": 1, "verb": "Create", "entity": "Order", "values": {"Total": "5"}}],
    "unmatchedSteps": [{"text": "hm", "line": 9}]}]
}""")
    tables = rd.read_runs(spark, str(path))
    assert tables["benchmark"].select("operation", "p95Ms").collect()[0].asDict() == {"operation": "persist", "p95Ms": 2.0}
    assert tables["entities"].first()["values"] == {"Total": "5"}
    assert tables["unmatched_steps"].first()["text"] == "hm"
    assert tables["runs"].first()["outcome"] == "Succeeded"


def test_truncated_journal_line_is_ignored(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text('{"kind":"entity","scenario":"s","ordinal":1,"persisted":true}\n\n{"kind":"entity"}\n{"kind":"entity","scena')
    assert rd.read_journal(spark, str(path)).select("scenario", "ordinal").collect() == [("s", 1)]


def test_journals_as_written_keep_times_and_find_another_seed(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text("\n".join([
        '{"kind":"scenario-start","scenario":"a","seed":1,"atUtc":"2024-01-01T00:00:00Z"}', '{"kind":"scenario-start","scenario":"a","seed":2,"atUtc":"2024-01-01T00:00:00Z"}',
        '{"kind":"entity","scenario":"a","ordinal":1,"persisted":true,"atUtc":"2024-01-01T00:00:01Z"}', '{"kind":"scenario-start","scenario":"b","seed":5}',
        '{"kind":"entity","scenario":"b","ordinal":1,"persisted":true}', '{"kind":"scenario-start","scenario":"c"}', '{"kind":"entity","scenario":"c","ordinal":1,"persisted":true}']))
    journal = rd.read_journal(spark, str(path))
    assert journal.filter("at_utc IS NOT NULL").count() == 3
    assert {r.scenario: r.recorded_seed for r in jr.recorded_seeds(journal).collect()} == {"a": 2, "b": 5, "c": None}
    plan = spark.createDataFrame([("a", 2, 1), ("a", 2, 2), ("b", 6, 1), ("c", 1, 1), ("d", 1, 1)], "scenario string, seed long, ordinal long")
    assert sorted((r.scenario, r.ordinal) for r in jr.resume_plan(plan, journal).collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_streamed_sketch_is_close_to_the_exact_value(spark, tables):
    keys = ["window_start", "window_end", "event_type"]
    exact = {tuple(r)[:3]: r["p95"] for r in _p95(tables.events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    streamed = {tuple(r)[:3]: r["p95"] for r in st.stream_metric(_stream(tables), "ts", "2 days", _p95, keys).collect()}
    assert streamed == exact  # below the sketch's accuracy every row is kept


def test_streamed_p95_is_exact_in_large_groups(spark, tmp_path):
    """Groups of 60,000 rows, far beyond any sketch, over several micro-batches; alerts over the stream follow."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 500)
    made = spark.range(0, 120_000, 1, 4).select(at.alias("ts"), (F.col("id") % 2).cast("string").alias("kind"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("value"))
    made.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/rows")
    keys = ["window_start", "window_end"]
    for metric, by in ((lambda e: st.p95_by(e, "ts", "value", "1 day", ["kind"]), [*keys, "kind"]), (lambda e: st.latency_alerts(e, "ts", "value", 1.35e8), keys)):
        want = sorted(map(tuple, metric(rows).collect()))
        assert want and sorted(map(tuple, st.stream_metric(stream, "ts", "2 days", metric, by).collect())) == want


def test_stream_restarts_from_its_checkpoint(spark):
    folder, out, state = (scratch_path(spark, x) for x in ("lines", "out", "state"))
    line = "kind string, scenario string, ordinal long, persisted boolean, at_utc string"
    spark.createDataFrame([("entity", "s", 1, True, "2024-01-01T00:00:00"), ("entity", "s", 1, True, "2024-01-01T00:00:01")], line).write.json(folder)
    st.append_to_table(st.persisted_stream(st.journal_stream(spark, folder)), out, state)
    spark.createDataFrame([("entity", "s", 2, True, "2024-01-01T00:00:02"), ("entity", "s", 1, True, "2024-01-01T00:00:03")], line).write.mode("append").json(folder)
    done = st.append_to_table(st.persisted_stream(st.journal_stream(spark, folder)), out, state)
    # a line that comes days late still counts
    spark.createDataFrame([("entity", "s", 3, True, "2023-06-01T00:00:00")], line).write.mode("append").json(folder)
    done = st.append_to_table(st.persisted_stream(st.journal_stream(spark, folder)), out, state)
    assert sorted(tuple(r) for r in done.distinct().collect()) == [("s", 1), ("s", 2), ("s", 3)]
    assert st.scenario_progress(done).first()["persisted"] == 3


RECORD = ("scenario_seq int, ordinal long, domain string, entity string, verb string, persisted_via string, id string, natural_key string, "
          "values map<string,string>")


def test_records_without_an_id_are_replayed_by_natural_key(spark):
    def record(n, verb, key, id_=None, entity="Customer", **values):
        return (1, n, "Shop", entity, verb, "DbContext", id_, key, values)

    records = spark.createDataFrame([
        record(1, "Create", "new", Amount="5"), record(2, "Create", "known", amount="1.5"), record(3, "Update", "known", amount="2.5"),
        record(4, "Update", "nobody", amount="9"), record(5, "Create", "k3", "3", amount="3"), record(6, "Update", "k3", amount="4"),
        record(7, "Delete", None), record(8, "Create", "x", entity="Ghost")], RECORD)
    runs = spark.createDataFrame([(1, "Persistent", "Succeeded")], "scenario_seq int, lifecycle string, outcome string")
    target = spark.createDataFrame([("7", "known", 0.0), ("3", "k3", 0.0), ("8", "other", 8.0)], "id string, nk string, amount double")
    got = {(r.nk, r.id): (r.amount, r.action) for r in pb.replay(records, runs, target, "shop", "customer", "id", "nk", ["amount"]).collect()}
    assert got == {("known", "7"): (2.5, "updated"), ("k3", "3"): (4.0, "updated"), ("other", "8"): (8.0, "kept"), ("new", None): (5.0, "created")}
    steps = {r.ordinal: r.step for r in pb.replay_steps(records, runs, target, "id", "nk", [("shop", "customer")]).collect()}
    assert steps == {1: "created", 2: "updated", 3: "updated", 4: "failed", 5: "updated", 6: "updated", 7: "warning", 8: "failed"}


def test_lineage_has_no_depth_limit_and_marks_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(70)]
    edges = spark.createDataFrame([*chain, ("n0", "n70"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "n70"), ("d", "a")], "source_id string, target_id string")
    got = {r.node_id: (r.depth, r.cyclic) for r in ln.lineage_depth(edges.coalesce(1)).collect()}
    assert got == {**{f"n{i}": (70 - i, False) for i in range(71)}, **{n: (None, True) for n in "abcd"}}


def test_a_key_that_two_rows_share_is_not_replayed(spark):
    records = spark.createDataFrame([
        (1, 1, "shop", "customer", "Update", "api", None, "k", {"amount": "5"}), (1, 2, "shop", "customer", "Create", "api", None, "k", {"amount": "6"}),
        (1, 3, "shop", "customer", "Update", "api", None, "one", {"amount": "7"}), (1, 4, "shop", "customer", "Update", "api", "i2", "k", {"amount": "8"})],
        "scenario_seq int, ordinal int, domain string, entity string, verb string, persisted_via string, id string, natural_key string, values map<string,string>")
    runs = spark.createDataFrame([(1, "Persistent", "Succeeded")], "scenario_seq int, lifecycle string, outcome string")
    target = spark.createDataFrame([("i1", "k", 1.0), ("i2", "k", 2.0), ("i3", "one", 3.0)], "id string, nk string, amount double")
    args = (records, runs, target)
    assert sorted(map(tuple, pb.replay(*args, "shop", "customer", "id", "nk", ["amount"]).collect())) == [
        ("i1", "k", 1.0, "kept"), ("i2", "k", 8.0, "updated"), ("i3", "one", 7.0, "updated")]
    steps = pb.replay_steps(*args, "id", "nk", [("shop", "customer")])
    assert {r.ordinal: r.step for r in steps.collect()} == {1: "failed", 2: "failed", 3: "updated", 4: "updated"}
    assert tuple(pb.replay_report(steps).first())[5:] == (2, 2)
    assert [tuple(r) for r in pb.ambiguous_records(*args, "shop", "customer", "id", "nk").collect()] == [("k", 2, 2, "i1", "i2")]
    found = pb.find_recorded(pb.fold_expected(records, runs), target, "id", "nk", ["amount"]).filter("natural_key = 'k' AND id IS NULL").first()
    assert found["found"] is False
