"""Column profiling: counts, moments, distribution fit, category weights, correlation hints."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws as dr
from ..session import scratch_path
from ..spec import EntitySpec
from . import generate as gen
from .quantiles import order_statistics, upper_median

# What decides whether and how a distribution is suggested.
CATEGORICAL_MAX = 10
MIN_ROWS_TO_FIT = 20
SKEW_OF_LOGNORMAL = 1.0
PAIR_SLACK = 1.2
DIGITS = 4

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def profiled_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Keys and foreign keys are identity, not shape: the caller names them in ``skip``."""
    return [f.name for f in df.schema.fields if f.name not in skip]


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, _NUMERIC)]


def label_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name not in skip and isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _long(one_row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``<column>__<field>`` cells of a single aggregate row, as one row per column."""
    items = [F.struct(F.lit(c).alias("property"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns]
    return one_row.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def _sketch(column: Column, cap: int) -> Column:
    """Distinct values by a sketch with eight registers or more for each of ``cap`` values."""
    return F.approx_count_distinct(column, min(0.05, 1.1 / math.sqrt(8.0 * max(cap, 1))))


def _sketch_bound(cap: int) -> float:
    """What the sketch of at most ``cap`` values can't exceed.

    With so few values most registers stay empty, and the estimate is m * ln(m / empty), where each value fills one
    register at most: with m >= 8 * cap that is under 1.08 * cap. A larger estimate proves that there are more values.
    """
    return 1.1 * cap + 1


def _counted(df: DataFrame, columns: Sequence[str], numbers: Sequence[str] = (), cap: int = CATEGORICAL_MAX) -> list[Column]:
    cells: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        cells += [F.count(c).alias(f"{c}__filled"), _sketch(F.col(c), cap).alias(f"{c}__about")]
    return cells + [x for c in numbers for x in _moment_cells(c)]


def few_valued(df: DataFrame, columns: Sequence[str], cap: int = CATEGORICAL_MAX) -> list[str]:
    """Columns that the sketch does not prove to have more than ``cap`` values: one pass, one number per column to the driver."""
    if not columns:
        return []
    about = df.agg(*[_sketch(F.col(c), cap).alias(c) for c in columns]).first()
    return [c for c in columns if about[c] <= _sketch_bound(cap)]


def profile_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``property, type, count, null_count, distinct``: one aggregate over all columns."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    cells: list[Column] = []
    for c in columns:
        cells += [F.count(F.lit(1)).alias(f"{c}__count"),
                  (F.count(F.lit(1)) - F.count(c)).alias(f"{c}__null_count"), distinct(F.col(c)).alias(f"{c}__distinct")]
    long = _long(df.agg(*cells), columns, ("count", "null_count", "distinct"))
    names = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return long.withColumn("type", names[F.col("property")])


def _moment_cells(c: str) -> list[Column]:
    v = F.col(c).cast("double")
    return [F.count(v).alias(f"{c}__n"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), F.avg(v).alias(f"{c}__mean"), F.stddev_pop(v).alias(f"{c}__std_dev"),
            F.skewness(v).alias(f"{c}__skewness"), F.stddev_pop(F.when(v > 0, F.log(v))).alias(f"{c}__log_sigma")]


_MOMENTS = ("n", "min", "max", "mean", "std_dev", "skewness", "log_sigma")


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unrounded moments of all columns from one scan."""
    return _long(df.agg(*[x for c in columns for x in _moment_cells(c)]), columns, _MOMENTS)


def _medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "property", "value")
    return order_statistics(long, ["property"], "value", [upper_median("median")])


def _with_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # one row per column on either side
    return _moments(df, columns).join(F.broadcast(_medians(df, columns)), "property", "left")


def _shown_moments(wide: DataFrame) -> DataFrame:
    return wide.filter(F.col("n") > 0).select("property", *[F.bround(c, DIGITS).alias(c) for c in ("min", "max", "mean", "median", "std_dev")])


def profile_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``property, min, max, mean, median, std_dev``: upper median, population deviation, 4 digits."""
    return _shown_moments(_with_medians(df, columns))


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _moments(df, columns).select("property", F.bround("skewness", DIGITS).alias("skewness"))


def _fit(wide: DataFrame) -> DataFrame:
    wide = wide.filter((F.col("n") >= MIN_ROWS_TO_FIT) & (F.col("std_dev") != 0))
    heavy = (F.col("min") >= 0) & (F.col("skewness") > SKEW_OF_LOGNORMAL)
    return wide.select(
        "property", F.when(heavy, "lognormal").otherwise("normal").alias("distribution"),
        F.bround(F.when(heavy, F.col("median")).otherwise(F.col("mean")), DIGITS).alias("mean"),
        F.bround(F.when(heavy, F.col("log_sigma")).otherwise(F.col("std_dev")), DIGITS).alias("sigma"),
        F.when(heavy, F.lit(0.0)).alias("min"))


def fit_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Suggested distribution per column: right-skewed and never negative reads as lognormal.

    Moments are one scan; the median, which only a lognormal fit shows, is ranked for the columns that read so, or that
    have too few rows to tell apart, alone.
    """
    moments = _long(_written(df.agg(*[x for c in columns for x in _moment_cells(c)]), "moments"), columns, _MOMENTS)
    skewed = [r["property"] for r in moments.filter((F.col("min") >= 0) & (F.col("skewness") > SKEW_OF_LOGNORMAL)).select("property").collect()]
    if not skewed:
        return _fit(moments.withColumn("median", F.lit(None).cast("double")))
    return _fit(moments.join(F.broadcast(_medians(df, skewed)), "property", "left"))  # one row per column


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``property, value, rows`` of text-like columns, null included."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (texts.unpivot([], list(columns), "property", "value")
                 .groupBy("property", "value").agg(F.count(F.lit(1)).alias("rows")))


def _weights(counts: DataFrame, categorical_max: int) -> DataFrame:
    counts = counts.filter(F.col("value").isNotNull())
    totals = counts.groupBy("property").agg(F.count(F.lit(1)).alias("_d"), F.sum("rows").alias("_n"))
    # one row per column
    kept = F.broadcast(totals.filter(F.col("_d") <= categorical_max))
    return counts.join(kept, "property").select(
        "property", F.col("value").alias("label"), F.bround(F.col("rows") / F.col("_n"), DIGITS).alias("weight"))


_NO_WEIGHTS = "property string, label string, weight double"


def category_weights(df: DataFrame, columns: Sequence[str], categorical_max: int = CATEGORICAL_MAX) -> DataFrame:
    """``property, label, weight`` for columns with few distinct values; shares of the non-null rows.

    A first pass drops the columns whose sketch proves that they have more; values are only grouped for the others, so a
    task sends little more than ``categorical_max`` values of a column.
    """
    few = few_valued(df, columns, categorical_max)
    return _weights(value_counts(df, few), categorical_max) if few else df.sparkSession.createDataFrame([], _NO_WEIGHTS)


def correlation_hints(df: DataFrame, columns: Sequence[str], categorical_max: int = CATEGORICAL_MAX, few: Sequence[str] | None = None) -> DataFrame:
    """``left, right, pairs``: column pairs where one side nearly determines the other; null counts as a value.

    ``few`` names the columns that may have so few values, if the caller knows them (see ``few_valued``). Each row
    yields its value pair of each pair of those columns into one aggregate that is combined on the map side: a pair of
    columns has ``(categorical_max + 1) ** 2`` entries at most, whatever the table's size. One scan.
    """
    candidates = [c for c in columns if c in few] if few is not None else few_valued(df, columns, categorical_max)
    schema = "left string, right string, pairs long"
    if len(candidates) < 2:
        return df.sparkSession.createDataFrame([], schema)
    pairs = list(combinations(candidates, 2))
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for i, (a, b) in enumerate(pairs)])
    combos = df.select(F.explode(cells).alias("_c")).select("_c.*").distinct()
    sides = [combos.groupBy("pair", s).agg(F.count(F.lit(1)).alias("_n")).groupBy("pair").agg(
        F.count(F.lit(1)).alias(f"n_{s}"), F.count(s).alias(f"given_{s}"), F.sum("_n").alias("pairs")) for s in "ab"]
    found = sides[0].join(sides[1].drop("pairs"), "pair")
    near = F.col("pairs").cast("double") <= F.greatest("n_a", "n_b") * F.lit(PAIR_SLACK)
    capped = (F.col("given_a") <= categorical_max) & (F.col("given_b") <= categorical_max)
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)
    return found.filter((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & near & capped).select(name(0).alias("left"), name(1).alias("right"), "pairs")


def profile(df: DataFrame, skip: Sequence[str] = (), categorical_max: int = CATEGORICAL_MAX,
            include_values: bool = True, approximate: bool = False) -> DataFrame:
    """Everything about every column, long form; ``include_values=False`` leaves out labels.

    ``property, type, count, null_count, distinct, min, max, mean, median, std_dev, weights,
    distribution, fit_mean, fit_sigma, fit_min``.

    Three scans: counts, moments and distinct sketches of all columns in one aggregate; the values of the columns that
    the sketch leaves with few, which gives exact distincts and weights; and the values of the others, written once, for
    exact distincts and medians. ``approximate`` takes the distincts of the last from the sketch, so that only numbers
    are shuffled there.
    """
    columns, numbers, labels = profiled_columns(df, skip), numeric_columns(df, skip), label_columns(df, skip)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    first = _written(df.agg(*_counted(df, columns, numbers, categorical_max)), "profile")
    seen = first.first()
    few = [c for c in labels if seen[f"{c}__about"] <= _sketch_bound(categorical_max)]
    rest = [c for c in columns if c not in few and c not in numbers and not approximate]
    out = first.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("property"), F.lit(types[c]).alias("type"), F.col("_rows").alias("count"), (F.col("_rows") - F.col(f"{c}__filled")).alias("null_count"),
        F.col(f"{c}__about").alias("_about")) for c in columns])).alias("p")).select("p.*") if columns else None
    if out is None:
        raise ValueError("no column to profile")
    counted = []
    if few:
        values = _written(value_counts(df, few), "profile-values")
        counted.append(values.groupBy("property").agg(F.count("value").alias("distinct")))
    if numbers or rest:
        items = [F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("number"), (F.lit(None) if c in numbers and approximate else F.col(c)).cast("string").alias("text")) for c in numbers]
        items += [F.struct(F.lit(c).alias("property"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("text")) for c in rest]
        held = (df.select(F.explode(F.array(*items)).alias("_c")).select("_c.*").filter("number IS NOT NULL OR text IS NOT NULL")
                .groupBy("property", "number", "text").agg(F.count(F.lit(1)).alias("rows")))
        held = _written(held, "profile-values")
        if not approximate:
            counted.append(held.groupBy("property").agg(F.count(F.lit(1)).alias("distinct")))
    distinct = reduce(DataFrame.unionByName, counted) if counted else df.sparkSession.createDataFrame([], "property string, distinct long")
    # everything joined here has one row per column
    out = out.join(F.broadcast(distinct), "property", "left")
    out = out.withColumn("distinct", F.coalesce("distinct", F.when(F.lit(approximate), F.col("_about")).otherwise(F.lit(0)))).drop("_about")
    if numbers:
        medians = order_statistics(held.filter(F.col("number").isNotNull()), ["property"], "number", [upper_median("median")], count="rows")
        wide = _written(_long(first, numbers, _MOMENTS).join(F.broadcast(medians), "property", "left"), "profile-moments")
        out = out.join(F.broadcast(_shown_moments(wide)), "property", "left")
        out = out.join(F.broadcast(_fit(wide).withColumnsRenamed({"mean": "fit_mean", "sigma": "fit_sigma", "min": "fit_min"})), "property", "left")
    if labels and include_values:
        shares = _weights(values, categorical_max) if few else df.sparkSession.createDataFrame([], _NO_WEIGHTS)
        weights = shares.groupBy("property").agg(
            # at most categorical_max entries per property
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "weight")))).alias("weights"))
        out = out.join(F.broadcast(weights), "property", "left")
    return suppress_values(out) if not include_values else out


def suppress_values(profiled: DataFrame) -> DataFrame:
    """No labels, no weights, no suggestion of labels; the counts stay."""
    return profiled.drop("weights", "label", "weight")


def to_config(profiled: DataFrame, entity: str) -> dict[str, dict[str, dict]]:
    """Entity -> property -> suggested settings, by name. The profile has one row per column."""
    wanted = [c for c in ("property", "weights", "distribution", "fit_mean", "fit_sigma", "fit_min") if c in profiled.columns]
    config: dict[str, dict] = {}
    for row in sorted(profiled.select(*wanted).collect(), key=lambda r: r["property"]):
        entry = row.asDict(recursive=True)
        if entry.get("weights"):
            config[row["property"]] = {"weights": entry["weights"]}
        elif entry.get("distribution"):
            fitted = {"distribution": entry["distribution"], "mean": entry["fit_mean"],
                      "sigma": entry["fit_sigma"], "min": entry.get("fit_min")}
            config[row["property"]] = {k: v for k, v in fitted.items() if v is not None}
    return {entity: config}


def config_rows(profiled: DataFrame, entity: str) -> DataFrame:
    """The same settings as a table ``entity, property, setting`` (readable text)."""
    weights = F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(10,4)").cast("string"))), ",")
    number = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    fitted = F.concat(F.col("distribution"), F.lit(" mean="), number("fit_mean"), F.lit(" sigma="), number("fit_sigma"),
                      F.when(F.col("fit_min").isNotNull(), F.concat(F.lit(" min="), number("fit_min"))).otherwise(""))
    return (profiled.select(F.lit(entity).alias("entity"), "property", F.coalesce(
        F.concat(F.lit("weights "), weights), fitted).alias("setting")).filter(F.col("setting").isNotNull()))


def merge_profiles(profiles: DataFrame, domain_order: Sequence[str]) -> DataFrame:
    """Profiles of several domains (``domain, entity, ...``): the first domain of an entity wins.

    Adds ``warning`` to the winning rows of an entity that another domain has as well.
    """
    rank = F.array_position(F.array(*[F.lit(d) for d in domain_order]), F.col("domain"))
    owners = profiles.groupBy("entity").agg(F.min(rank).alias("_first"), F.count_distinct("domain").alias("_domains"))
    kept = profiles.withColumn("_rank", rank).join(owners, "entity").filter(F.col("_rank") == F.col("_first"))
    text = F.concat(F.lit("entity "), F.col("entity"), F.lit(" is profiled in several domains; kept "), F.col("domain"))
    return kept.withColumn("warning", F.when(F.col("_domains") > 1, text)).drop("_rank", "_first", "_domains")


def generate_like(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Profile ``columns``, generate as many rows from the profile, and compare label shares.

    ``property, label, source_share, generated_share``.
    """
    source = df.select(key, *columns)
    config = to_config(profile(source, skip=[key]), "Entity")["Entity"]
    spec = EntitySpec("Profiled", "Entity", source.schema, key=key, id_strategy="db_generated")
    plan = gen.GenerationPlan(spec=spec, seed=seed, statistics=config)
    made = gen.apply_statistics(source.select(F.col(key).alias("ordinal")), plan,
                                dr.Draws(seed, spec.domain, spec.entity, F.col("ordinal")))
    labels = [c for c in label_columns(source, [key]) if c in config]
    left = category_weights(source, labels).withColumnRenamed("weight", "source_share")
    right = category_weights(made, labels).withColumnRenamed("weight", "generated_share")
    return left.join(right, ["property", "label"], "full")
