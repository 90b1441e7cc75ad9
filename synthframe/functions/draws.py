"""Counter-based seeded draws and the distributions on top of them.

A draw is a pure function of (seed, scope, property, ordinal, k): the first 13 hex digits of
``md5('seed|domain|entity|property|ordinal|k')`` over 2^52. The same row gets the same value
whatever the partitioning, the retry or the execution order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


class Draws:
    """Draw factory of one entity: binds seed, domain, entity and the ordinal column."""

    def __init__(self, seed: Column | int, domain: str, entity: str, ordinal: Column):
        self.seed, self.domain, self.entity, self.ordinal = seed, domain, entity, ordinal

    def u(self, prop: str, k: int = 0) -> Column:
        return draw(self.seed, f"{self.domain}|{self.entity}", prop, self.ordinal, k)

    def index(self, prop: str, n: int, k: int = 0) -> Column:
        """Uniform integer in [0, n)."""
        return F.floor(self.u(prop, k) * F.lit(float(n))).cast("int")


def draw(seed: Column | int, scope: str, prop: str, ordinal: Column, k: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    name = F.concat(head, F.lit(f"|{scope}|{prop}|"), ordinal.cast("string"), F.lit(f"|{k}"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def normal(u0: Column, u1: Column, mean: float, sigma: float) -> Column:
    """Box-Muller over exactly two draws; ``1 - u0`` keeps the logarithm finite."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u0))
    return F.lit(float(mean)) + F.lit(float(sigma)) * radius * F.cos(F.lit(2 * math.pi) * u1)


def lognormal(u0: Column, u1: Column, median: float, sigma: float) -> Column:
    """The scale parameter is the median: half of all values lie below it."""
    return F.exp(normal(u0, u1, math.log(_positive(median, "lognormal")), sigma))


def uniform(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def exponential(u: Column, mean: float) -> Column:
    return -F.log(F.lit(1.0) - u) * F.lit(float(_positive(mean, "exponential")))


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


# Target types a distribution can feed.
_INTEGRAL = ("smallint", "int", "bigint")
_FRACTIONAL = ("double", "float")


def round_to_type(value: Column, target: str, decimals: int | None = None) -> Column:
    """Half-even rounding; integers round the raw value, fractions to ``decimals`` (2)."""
    if target in _INTEGRAL:
        return F.bround(value, 0).cast(target)
    if target in _FRACTIONAL or target.startswith("decimal"):
        return F.bround(value, 2 if decimals is None else decimals).cast(target)
    raise ValueError(f"a distribution needs a numeric property, not {target}; use weights")


def distribution(draws: Draws, prop: str, config: Mapping) -> Column:
    """Sample one declared distribution and clamp it to the declared bounds."""
    kind = str(config["distribution"]).lower()
    mean, sigma = config.get("mean"), config.get("sigma")
    low, high = config.get("min"), config.get("max")
    if kind == "normal":
        value = normal(draws.u(prop, 0), draws.u(prop, 1),
                       _given(mean, kind, "mean"), _given(sigma, kind, "sigma"))
    elif kind == "lognormal":
        value = lognormal(draws.u(prop, 0), draws.u(prop, 1),
                          _given(mean, kind, "mean"), _given(sigma, kind, "sigma"))
    elif kind == "uniform":
        value = uniform(draws.u(prop), _given(low, kind, "min"), _given(high, kind, "max"))
    elif kind == "exponential":
        value = exponential(draws.u(prop), _given(mean, kind, "mean"))
    else:
        raise ValueError(f"unknown distribution '{kind}': normal, lognormal, uniform, exponential")
    return clamp(value, low, high)


def _given(value, kind: str, name: str) -> float:
    if value is None:
        raise ValueError(f"distribution '{kind}' requires '{name}'")
    return float(value)


def _positive(value: float, kind: str) -> float:
    if value <= 0:
        raise ValueError(f"distribution '{kind}' requires a positive mean")
    return value


# Up to this many labels a draw compares with every step; beyond it the steps form a search tree.
LINEAR_LABELS = 128


def weighted(u: Column, weights: Mapping[str, float]) -> Column:
    """Weighted label: the first label, in code point order, whose running weight exceeds the roll."""
    if not weights:
        raise ValueError("weights must contain at least one value")
    labels = sorted(weights)
    steps, running = [], 0.0
    for label in labels:
        running += float(weights[label])
        steps.append(running)
    if running <= 0:
        raise ValueError("weights must sum to a positive number")
    roll = u * F.lit(running)
    if len(labels) <= LINEAR_LABELS:
        # unconditional comparisons share one evaluation of the draw
        passed = F.lit(1)
        for step in steps[:-1]:
            passed = passed + (roll >= F.lit(step)).cast("int")
        return F.element_at(F.array(*[F.lit(label) for label in labels]), passed)

    def pick(first: int, last: int) -> Column:
        if first == last:
            return F.lit(labels[first])
        middle = (first + last) // 2
        return F.when(roll < F.lit(steps[middle]), pick(first, middle)).otherwise(pick(middle + 1, last))

    return pick(0, len(labels) - 1)


def pick_random(u: Column, values: Sequence) -> Column:
    """Uniform pick from a short list."""
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


def chance(u: Column, probability: float = 0.5) -> Column:
    return u < F.lit(float(probability))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHANUMERIC = "0123456789" + _LETTERS


def _char(u: Column, alphabet: str) -> Column:
    position = (F.floor(u * F.lit(float(len(alphabet)))) + 1).cast("int")
    return F.substr(F.lit(alphabet), position, F.lit(1))


def pattern_fill(draws: Draws, prop: str, pattern: str) -> Column:
    """``#`` becomes a digit and ``?`` a letter, one draw each; the result is upper-case."""
    parts: list[Column] = []
    literal, k = "", 0
    for ch in pattern:
        if ch in "#?":
            if literal:
                parts.append(F.lit(literal.upper()))
                literal = ""
            parts.append(_char(draws.u(prop, k), "0123456789" if ch == "#" else _LETTERS))
            k += 1
        else:
            literal += ch
    if literal:
        parts.append(F.lit(literal.upper()))
    return F.concat(*parts)


def alphanumeric(draws: Draws, prop: str, length: int) -> Column:
    return F.concat(*[_char(draws.u(prop, k), _ALPHANUMERIC) for k in range(length)])


def index_key(prefix: str, ordinal: Column, width: int) -> Column:
    """Collision-free natural key: the ordinal, zero-padded but never cut."""
    text = ordinal.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
