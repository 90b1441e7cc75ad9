"""Seeded row generation: auto-fake -> rules -> statistics -> overrides -> references -> identity.

Every stage but the references is a projection over the ordinal column; a reference is one join with one partner
per row, so rows without references are generated without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import autofake, draws as dr
from ..functions.convert import typed_convert
from ..functions.identity import natural_name, ordinal_name, uuid5_name
from ..spec import EntitySpec
from .linking import Reference, link

# A dataset is a small reference table; above this row count it is joined, not broadcast.
DATASET_BROADCAST_ROWS = 100_000

Rule = Callable[[dr.Draws], Column]


@dataclass(frozen=True)
class ValuePlugin:
    """Custom value source. ``generate`` may yield NULL rows: the next plugin then decides."""

    name: str
    matches: Callable[[EntitySpec, T.StructField], bool]
    generate: Callable[[dr.Draws, T.StructField], Column]


@dataclass(frozen=True)
class Dataset:
    """Correlated tuples. ``table`` has a dense ``row_id`` 0..rows-1 and text columns."""

    name: str
    table: DataFrame
    rows: int

    def column(self, wanted: str) -> str:
        for c in self.table.columns:
            if c.lower() == wanted.lower():
                return c
        raise ValueError(f"dataset '{self.name}' has no column '{wanted}': {', '.join(self.table.columns)}")


@dataclass(frozen=True)
class GenerationPlan:
    """What to generate for one entity."""

    spec: EntitySpec
    seed: int
    scenario: str = ""
    locale: str = "en"
    anchor: Column | None = None
    plugins: Sequence[ValuePlugin] = ()
    rules: Sequence[tuple[str, Callable[[dr.Draws], Column]]] = ()
    statistics: Mapping[str, Mapping] = field(default_factory=dict)
    datasets: Mapping[str, Dataset] = field(default_factory=dict)
    overrides: Mapping[str, str] = field(default_factory=dict)
    references: Sequence[Reference] = ()


def _draws(plan: GenerationPlan, ordinal: str, seed: Column | None = None) -> dr.Draws:
    return dr.Draws(plan.seed if seed is None else seed, plan.spec.domain, plan.spec.entity, F.col(ordinal))


def ordinals(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    """``ordinal`` first..first+n-1, split over the default parallelism."""
    return spark.range(first, first + n).withColumnRenamed("id", "ordinal")


def generate(df: DataFrame, plan: GenerationPlan, ordinal: str = "ordinal",
             seed: Column | None = None, scenario: Column | None = None, context: DataFrame | None = None) -> DataFrame:
    """One generated row per ordinal row; input columns are kept in front.

    ``seed`` and ``scenario`` may be columns, so that many scenarios are one DataFrame. References of the plan take their
    keys from columns of ``df`` and look in ``context`` (``entity, key, id, seq``) first, see ``linking.link``.
    """
    source = _draws(plan, ordinal, seed)
    out = rule_set(df, plan.rules, source) if plan.rules else autofake_columns(df, plan, source)
    out = apply_statistics(out, plan, source, ordinal)
    out = apply_overrides(out, plan.spec, plan.overrides)
    out = link(out, plan.references, context)
    return assign_identity(
        out, plan.spec, scenario=F.lit(plan.scenario) if scenario is None else scenario,
        seed=F.lit(plan.seed) if seed is None else seed, ordinal=F.col(ordinal))


def autofake_columns(df: DataFrame, plan: GenerationPlan, source: dr.Draws) -> DataFrame:
    """Plugins first, then name rules, then type rules; keys and foreign keys are skipped."""
    spec = plan.spec
    anchor = F.current_timestamp() if plan.anchor is None else plan.anchor
    columns: dict[str, Column] = {}
    for f in spec.generated_fields:
        choices = [p.generate(source, f) for p in sorted(plan.plugins, key=lambda p: p.name) if p.matches(spec, f)]
        enum_values = spec.enums.get(f.name)
        if f.name in spec.kinds:
            fallback = autofake.BY_KIND[spec.kinds[f.name]](source, f.name)
        elif isinstance(f.dataType, T.StringType) and not enum_values:
            fallback = autofake.fake_text(source, f.name, plan.locale)
        else:
            fallback = autofake.fake_typed(source, f.name, f.dataType, anchor, enum_values)
        if fallback is not None:
            choices.append(fallback)
        if choices:
            columns[f.name] = F.coalesce(*choices).cast(f.dataType)
    return df.withColumns(columns) if columns else df


def rule_set(df: DataFrame, rules: Sequence[tuple[str, Rule]], source: dr.Draws) -> DataFrame:
    """Entity rules in order; a later rule may read the columns of earlier ones."""
    for name, rule in rules:
        df = df.withColumn(name, rule(source))
    return df


def _target(spec: EntitySpec, configured: str) -> T.StructField:
    name = spec.find_property(configured)
    if name is None:
        known = ", ".join(f.name for f in spec.schema.fields)
        raise ValueError(f"{spec.entity}: '{configured}' matches no property of {known}")
    return spec.schema[name]


def check_statistics(spec: EntitySpec, config: Mapping[str, Mapping]) -> None:
    for name, entry in config.items():
        _target(spec, name)
        kinds = [k for k in ("dataset", "weights", "distribution") if entry.get(k) is not None]
        if len(kinds) != 1:
            raise ValueError(f"{spec.entity}.{name}: exactly one of dataset, weights, distribution")


def _text_to(column: Column, f: T.StructField, spec: EntitySpec) -> Column:
    """Text to the property type; text that does not fit stops the job."""
    target = spec.conversion_target(f.name)
    if target == "string":
        return column
    result = typed_convert(column, target, enum_values=spec.enums.get(f.name))
    return F.when(result["error"].isNotNull(), F.raise_error(result["error"])).otherwise(result["value"])


def apply_statistics(df: DataFrame, plan: GenerationPlan, source: dr.Draws, ordinal: str = "ordinal") -> DataFrame:
    """Declared statistics: datasets by name first, then weights and distributions by property."""
    spec, config = plan.spec, plan.statistics
    check_statistics(spec, config)
    by_dataset: dict[str, list[str]] = {}
    for name in sorted(config):
        if config[name].get("dataset") is not None:
            by_dataset.setdefault(config[name]["dataset"].lower(), []).append(name)
    known = {name.lower(): d for name, d in plan.datasets.items()}
    for dataset_name in sorted(by_dataset):
        if dataset_name not in known:
            raise ValueError(f"dataset '{dataset_name}' is not configured")
        picked = {_target(spec, n): config[n].get("column") or _target(spec, n).name for n in by_dataset[dataset_name]}
        df = correlated(df, known[dataset_name], source, picked, spec)
    columns: dict[str, Column] = {}
    for name in sorted(config):
        entry, f = config[name], _target(spec, name)
        if entry.get("weights") is not None:
            columns[f.name] = _text_to(dr.weighted(source.u(f.name), entry["weights"]), f, spec)
        elif entry.get("distribution") is not None:
            value = dr.distribution(source, f.name, entry)
            columns[f.name] = dr.round_to_type(value, f.dataType.simpleString(), entry.get("decimals"))
    return df.withColumns(columns) if columns else df


def correlated(df: DataFrame, dataset: Dataset, source: dr.Draws, picked: Mapping[T.StructField, str],
               spec: EntitySpec) -> DataFrame:
    """One row of the dataset per entity row; all its columns come from that row."""
    row = "_dataset_row"
    cells = [F.col("row_id").alias(row)]
    for f, column in picked.items():
        cells.append(_text_to(F.col(dataset.column(column)).cast("string"), f, spec).alias(f.name))
    lookup = dataset.table.select(*cells)
    if dataset.rows <= DATASET_BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    replaced = [f.name for f in picked if f.name in df.columns]
    index = F.floor(source.u(f"dataset:{dataset.name}") * F.lit(float(dataset.rows))).cast("bigint")
    return df.drop(*replaced).withColumn(row, index).join(lookup, row, "left").drop(row)


def make_dataset(name: str, table: DataFrame, order: Sequence[str]) -> Dataset:
    """Number a small reference table by ``order``. The row count is checked before it is used."""
    rows = table.limit(DATASET_BROADCAST_ROWS + 1).count()
    if rows == 0:
        raise ValueError(f"dataset '{name}' needs at least one row")
    from .sequence import dense_sequence
    if rows > DATASET_BROADCAST_ROWS:
        numbered = dense_sequence(table, order, "row_id", start=0)
        return Dataset(name, numbered, numbered.count())
    from pyspark.sql import Window
    numbered = table.withColumn("row_id", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    return Dataset(name, numbered, rows)


def apply_overrides(df: DataFrame, spec: EntitySpec, overrides: Mapping[str, str]) -> DataFrame:
    """Constants applied last, in order. A constant that does not fit is a plan error."""
    columns: dict[str, Column] = {}
    for name, raw in overrides.items():
        f = _target(spec, name)
        value = F.lit(None) if raw.lower() == "null" else _text_to(F.lit(raw), f, spec)
        columns[f.name] = value.cast(f.dataType)
    return df.withColumns(columns) if columns else df


def assign_identity(df: DataFrame, spec: EntitySpec, *, scenario: Column | None = None,
                    seed: Column | None = None, ordinal: Column | None = None,
                    override: str | None = None) -> DataFrame:
    """Explicit key first, else the natural key if there is one, else the ordinal.

    Keys assigned by the store are left alone.
    """
    if not spec.deterministic:
        return df
    nothing = F.lit(None).cast("string")
    name = nothing if ordinal is None else ordinal_name(spec.domain, spec.entity, scenario, seed, ordinal)
    if spec.natural_key:
        nk = F.col(spec.natural_key).cast("string")
        name = F.when(nk.isNotNull() & (nk != ""), natural_name(spec.domain, spec.entity, nk)).otherwise(name)
    derived = uuid5_name(name)
    return df.withColumn(spec.key, F.coalesce(F.col(override).cast("string"), derived) if override else derived)


def source_marker(base: str, plugins: Sequence[str] = (), *, distributions: Column | bool = False,
                  datasets: Column | bool = False) -> Column:
    """Where a row's values came from: ``base+plugin:a,b+distributions+datasets``."""
    def flag(value: Column | bool, text: str) -> Column:
        condition = value if isinstance(value, Column) else F.lit(value)
        return F.when(condition, F.lit(text)).otherwise(F.lit(""))

    used = f"+plugin:{','.join(plugins)}" if plugins else ""
    return F.concat(F.lit(base + used), flag(distributions, "+distributions"), flag(datasets, "+datasets"))


def generate_scenarios(scenarios: DataFrame, plan: GenerationPlan) -> DataFrame:
    """Many scenarios (``scenario, seed, count``) as one DataFrame; order of execution is irrelevant.

    A large scenario is exploded in blocks and the blocks are spread first, so one scenario that
    asks for most of the rows does not fill one task.
    """
    block = 10_000
    blocks = (scenarios.filter(F.col("count") > 0)
              .withColumn("_block", F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / F.lit(block)).cast("bigint"))))
              .repartition(F.col("scenario"), F.col("_block")))
    rows = blocks.withColumn("ordinal", F.explode(F.sequence(
        F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col("count").cast("bigint"))))).drop("_block")
    return generate(rows, plan, seed=F.col("seed"), scenario=F.col("scenario"))
