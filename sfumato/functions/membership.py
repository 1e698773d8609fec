"""Membership functions as column expressions, by name; users may register their own."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[[Column, Sequence[Column]], Column]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def trimf(x: Column, p) -> Column:
    """Ramp up from a to b, down to c; no rounding of x."""
    a, b, c = map(_c, p)
    return (
        F.when((x < a) | (x > c), 0.0).when(x < b, F.try_divide(x - a, b - a)).when(x == b, 1.0).otherwise(F.try_divide(c - x, c - b))
    )


def trapmf(x: Column, p) -> Column:
    a, b, c, d = map(_c, p)
    return (
        F.when((x < a) | (x > d), 0.0).when(x < b, F.try_divide(x - a, b - a)).when(x <= c, 1.0).otherwise(F.try_divide(d - x, d - c))
    )


def gaussmf(x: Column, p) -> Column:
    mu, s = map(_c, p)
    return F.exp(-((x - mu) * (x - mu)) / (2.0 * s * s))


def bellmf(x: Column, p) -> Column:
    a, b, c = map(_c, p)
    return 1.0 / (1.0 + F.pow(F.abs((x - c) / a), 2.0 * b))


def sigmf(x: Column, p) -> Column:
    a, c = map(_c, p)
    return 1.0 / (1.0 + F.exp(-a * (x - c)))


def singleton(x: Column, p) -> Column:
    return F.when(x == _c(p[0]), 1.0).otherwise(0.0)


REGISTRY: dict[str, Builder] = {
    "trimf": trimf, "trapmf": trapmf, "gaussmf": gaussmf, "bellmf": bellmf, "sigmf": sigmf, "singleton": singleton,
}


def register(name: str, builder: Builder) -> None:
    """Add a membership function under a name; it may wrap a pandas UDF where columns can't express it."""
    REGISTRY[name] = builder


def membership(mf: str, x: Column, p, alpha: float = 1.0) -> Column:
    """Degree of x in a set, times the set's alpha; NULL x has degree NULL."""
    mu = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(REGISTRY[mf](x, p))
    return mu if alpha == 1.0 else mu * F.lit(alpha)


def bounds(mf: str, p: Sequence[float]) -> tuple[float, float]:
    """(lower, upper) of a set."""
    if mf == "gaussmf":
        return p[0] - 3 * p[1], p[0] + 3 * p[1]
    if mf == "sigmf":
        k = p[1] / (2 * p[0])
        return p[1] - k, p[1] + k
    return min(p), max(p)


def centroid(mf: str, p: Sequence[float]) -> float:
    """Centre of a set given by its parameters."""
    if mf in ("trimf",):
        return p[1]
    if mf == "trapmf":
        return (p[1] + p[2]) / 2
    if mf == "sigmf":
        return p[1] + p[1] / (2 * p[0])
    return p[2] if mf == "bellmf" else p[0]


def degree(mf: str, x: float, p: Sequence[float]) -> float:
    """The same degrees on the driver, for sets and other metadata."""
    if mf == "trimf":
        a, b, c = p
        return 0.0 if x < a or x > c else 1.0 if x == b else (x - a) / (b - a) if x < b else (c - x) / (c - b)
    if mf == "trapmf":
        a, b, c, d = p
        return 0.0 if x < a or x > d else (x - a) / (b - a) if x < b else 1.0 if x <= c else (d - x) / (d - c)
    if mf == "gaussmf":
        return math.exp(-((x - p[0]) ** 2) / (2 * p[1] ** 2))
    if mf == "bellmf":
        return 1 / (1 + abs((x - p[2]) / p[0]) ** (2 * p[1]))
    if mf == "sigmf":
        return 1 / (1 + math.exp(-p[0] * (x - p[1])))
    if mf == "singleton":
        return float(x == p[0])
    raise KeyError(mf)
