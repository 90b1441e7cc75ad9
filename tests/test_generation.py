import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions import autofake, draws as dr
from synthframe.operators import generate as gen, profiling as pr
from synthframe.plans.generation import order_plan
from synthframe.spec import EntitySpec

N = 10_000


@pytest.fixture(scope="module")
def source(spark):
    return gen.ordinals(spark, N), dr.Draws(99, "D", "E", F.col("ordinal"))


def values(df, column):
    return [r[0] for r in df.select(column.alias("v")).collect()]


def test_weights_within_two_points(source):
    df, d = source
    got = values(df, dr.weighted(d.u("p"), {"a": 0.6, "b": 0.3, "c": 0.1}))
    for label, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert abs(got.count(label) / N - share) < 0.02


def test_normal_mean_and_deviation(source):
    df, d = source
    got = values(df, dr.normal(d.u("p"), d.u("p", 1), 100, 10))
    assert abs(statistics.mean(got) - 100) < 1 and abs(statistics.pstdev(got) - 10) < 1


def test_lognormal_scale_is_the_median(source):
    df, d = source
    got = values(df, dr.lognormal(d.u("p"), d.u("p", 1), 120, 1.2))
    assert abs(statistics.median(got) - 120) < 12


def test_exponential_mean_and_clamp(source):
    df, d = source
    assert abs(statistics.mean(values(df, dr.exponential(d.u("p"), 40))) - 40) < 4
    got = values(df, dr.distribution(d, "p", {"distribution": "normal", "mean": 0, "sigma": 5, "min": -1, "max": 2}))
    assert min(got) == -1 and max(got) == 2


def test_many_labels_take_the_tree_and_give_the_same_labels(source, monkeypatch):
    df, d = source
    weights = {f"L{i:03d}": 1.0 + i % 5 for i in range(100)}
    linear = values(df, dr.weighted(d.u("p"), weights))
    monkeypatch.setattr(dr, "LINEAR_LABELS", 1)
    assert values(df, dr.weighted(d.u("p"), weights)) == linear


def test_order_of_weights_does_not_matter(source):
    df, d = source
    a = values(df, dr.weighted(d.u("p"), {"x": 1.0, "y": 2.0, "z": 3.0}))
    assert a == values(df, dr.weighted(d.u("p"), {"z": 3.0, "y": 2.0, "x": 1.0}))


@pytest.mark.parametrize("config", [
    {"distribution": "normal", "mean": 1}, {"distribution": "lognormal", "mean": 0, "sigma": 1},
    {"distribution": "uniform", "min": 1}, {"distribution": "exponential", "mean": -1}, {"distribution": "zipf"}])
def test_bad_distributions_are_refused(source, config):
    with pytest.raises(ValueError):
        dr.distribution(source[1], "p", config)


@pytest.mark.parametrize("weights", [{}, {"a": 0.0}])
def test_bad_weights_are_refused(source, weights):
    with pytest.raises(ValueError):
        dr.weighted(source[1].u("p"), weights)


def test_text_needs_weights_not_a_distribution(spark):
    plan = order_plan(statistics={"Status": {"distribution": "normal", "mean": 1, "sigma": 1}})
    with pytest.raises(ValueError, match="numeric"):
        gen.generate(gen.ordinals(spark, 1), plan)


def test_unknown_property_and_double_setting_are_refused(spark):
    for statistics_ in ({"Colour": {"weights": {"a": 1.0}}}, {"Status": {"weights": {"a": 1.0}, "dataset": "d"}}):
        with pytest.raises(ValueError):
            gen.generate(gen.ordinals(spark, 1), order_plan(statistics=statistics_))


def test_same_rows_whatever_the_partitioning(spark, rows):
    base = gen.ordinals(spark, 2000)
    results = [rows(gen.generate(base.repartition(n), order_plan())) for n in (1, 4, 37)]
    assert results[0] == results[1] == results[2]


def test_scenarios_do_not_depend_on_order(spark, rows):
    listed = [("a", 1, 12), ("b", 2, 30_500), ("c", 3, 1)]
    forward = gen.generate_scenarios(spark.createDataFrame(listed, "scenario string, seed long, count long"), order_plan())
    backward = gen.generate_scenarios(spark.createDataFrame(listed[::-1], "scenario string, seed long, count long"), order_plan())
    assert forward.count() == 30_513
    assert rows(forward.filter("scenario <> 'b'")) == rows(backward.filter("scenario <> 'b'"))
    top = forward.filter("scenario = 'b'").agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("Id")).first()
    assert tuple(top) == (1, 30_500, 30_500)


def test_name_rules():
    expected = {"ContactEmail": "email", "Name": "company", "FirstName": "first_name", "LastNameText": "last_name",
                "NickName": "full_name", "Zip": "postcode", "OrderNumber": "code", "Colour": "word", "CompanyCity": "company"}
    assert {n: autofake.name_rule(n) for n in expected} == expected


def test_unknown_locale_is_refused():
    with pytest.raises(ValueError, match="unknown locale"):
        autofake.vocabulary("xx", "city")


def test_plugin_null_falls_through(spark):
    spec = EntitySpec("D", "E", T.StructType([T.StructField("Id", T.StringType()), T.StructField("Sku", T.StringType())]), key="Id")
    plugin = gen.ValuePlugin("p", lambda s, f: f.name == "Sku", lambda d, f: F.when(d.ordinal == 1, "special"))
    out = {r["ordinal"]: r["Sku"] for r in gen.generate(gen.ordinals(spark, 2), gen.GenerationPlan(spec=spec, seed=1, plugins=(plugin,))).collect()}
    assert out[1] == "special" and out[2].startswith("SKU-")


def test_profile_generate_profile(spark):
    rows_ = [(i, "Gold" if i % 10 < 6 else "Silver" if i % 10 < 9 else "Bronze", float(90 if i % 7 else 400)) for i in range(2000)]
    df = spark.createDataFrame(rows_, "id long, tier string, amount double")
    compared = pr.generate_like(df, "id", ["tier", "amount"], seed=3).collect()
    assert {r["label"] for r in compared} == {"Gold", "Silver", "Bronze"}
    assert all(abs(r["source_share"] - r["generated_share"]) < 0.03 for r in compared)


def test_large_dataset_is_joined_not_broadcast(spark, monkeypatch, rows):
    table = spark.range(500).select(F.format_string("v%03d", "id").alias("v"))
    small = gen.make_dataset("d", table, ["v"])
    monkeypatch.setattr(gen, "DATASET_BROADCAST_ROWS", 100)
    large = gen.make_dataset("d", table, ["v"])
    spec = EntitySpec("D", "E", T.StructType([T.StructField("Id", T.StringType()), T.StructField("V", T.StringType())]), key="Id")
    base, draws = gen.ordinals(spark, 300), dr.Draws(1, "D", "E", F.col("ordinal"))
    out = [rows(gen.correlated(base, d, draws, {spec.schema["V"]: "v"}, spec)) for d in (small, large)]
    assert out[0] == out[1]


def test_kinds_and_typed_overrides(spark):
    spec = EntitySpec("D", "Slot", T.StructType([
        T.StructField("Id", T.StringType()), T.StructField("Start", T.StringType()), T.StructField("Token", T.StringType()),
        T.StructField("Level", T.ShortType()), T.StructField("Note", T.StringType()), T.StructField("Length", T.DayTimeIntervalType())]),
        key="Id", kinds={"Start": "time", "Token": "guid", "Level": "byte"})
    row = gen.generate(gen.ordinals(spark, 1), gen.GenerationPlan(spec=spec, seed=1, overrides={"note": "null", "length": "01:30"})).first()
    assert len(row["Token"]) == 36 and len(row["Start"]) == 8 and 0 <= row["Level"] <= 255
    assert row["Note"] is None and row["Length"].total_seconds() == 5400
    with pytest.raises(Exception, match="Cannot convert"):
        gen.generate(gen.ordinals(spark, 1), gen.GenerationPlan(spec=spec, seed=1, overrides={"start": "25:00"})).collect()
