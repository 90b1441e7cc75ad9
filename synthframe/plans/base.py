"""Registration of queries and the SQL building blocks of their oracles."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.identity import NAMESPACE
from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of one scale-factor folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    """Queries of one section of the operator inventory."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle if SQL can say it."""
        def register(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return register


# --- DuckDB text -----------------------------------------------------------------------------

def dbl(value: float) -> str:
    """A literal that is read as a double, never as a decimal."""
    return f"CAST('{value!r}' AS DOUBLE)"


def sql_draw(seed, scope: str, prop: str, ordinal: str, k: int = 0) -> str:
    head = f"'{seed}" if isinstance(seed, int) else f"({seed})::VARCHAR || '"
    name = f"{head}|{scope}|{prop}|' || ({ordinal})::VARCHAR || '|{k}'"
    return f"((('0x' || substr(md5({name}), 1, 13))::BIGINT)::DOUBLE / {dbl(float(2**52))})"


def sql_uuid5(name: str) -> str:
    """Expression for the version 5 UUID of a text expression."""
    ns = NAMESPACE.replace("-", "")
    digest = f"sha1(unhex('{ns}') || encode({name}))"
    return (f"(substr({digest},1,8) || '-' || substr({digest},9,4) || '-5' || substr({digest},14,3) || '-' || "
            f"translate(substr({digest},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest},18,3) "
            f"|| '-' || substr({digest},21,12))")


def sql_normal(seed, scope, prop, ordinal, mean: float, sigma: float) -> str:
    u0, u1 = sql_draw(seed, scope, prop, ordinal, 0), sql_draw(seed, scope, prop, ordinal, 1)
    return (f"({dbl(mean)} + {dbl(sigma)} * sqrt({dbl(-2.0)} * ln({dbl(1.0)} - {u0})) * "
            f"cos({dbl(6.283185307179586)} * {u1}))")


def sql_weighted(u: str, weights: Mapping[str, float]) -> str:
    labels = sorted(weights)
    total, steps = 0.0, []
    for label in labels:
        total += weights[label]
        steps.append(total)
    arms = " ".join(f"WHEN {u} * {dbl(total)} < {dbl(step)} THEN '{label}'" for label, step in zip(labels, steps))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


def sql_pick(u: str, values) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[1 + floor({u} * {len(values)})::INT]"
