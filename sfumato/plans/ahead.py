"""Recursive multi-step forecasts: a model's own results are its next inputs.

A series needs only its last values and the rule table, whose size is at most (sets) ** order; so each series is one row,
series are parallel, and the recursion runs beside the broadcast rules.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sfumato.operators.partition import Partition
from sfumato.operators.rules import SMALL
from sfumato.session import cut


@dataclass
class Rules:
    """Rules of a high-order model as a dictionary: path -> (mid, lower, upper, p)."""

    part: Partition
    lags: tuple[int, ...]
    table: dict[tuple[int, ...], tuple[float, float, float, float]]
    mode: str = "mean"

    def fired(self, x: float) -> list[tuple[int, float]]:
        got = [(i, m) for i, s in enumerate(self.part.sets) if (m := s.degree(x)) > 0]
        return got or [(min(range(len(self.part)), key=lambda i: abs(self.part.sets[i].centroid - x)), 1.0)]

    def paths(self, values: Sequence[float]):
        """(path, least degree, product of degrees) for the value after `values`."""
        for combo in itertools.product(*(self.fired(values[-o]) for o in sorted(self.lags, reverse=True))):
            mus = [m for _, m in combo]
            yield tuple(i for i, _ in combo), min(mus), float(np.prod(mus))

    def point(self, values: Sequence[float]) -> float:
        s = self.part.sets
        if self.mode == "probabilistic":
            num = den = 0.0
            for path, _, mu in self.paths(values):
                mid, _, _, p = self.table.get(path, (float(np.mean([s[i].centroid for i in path])), 0, 0, 1.0))
                w = mu * p if mu * p > 0 else p
                num, den = num + w * mid, den + w
            return num / den
        mids = [self.table[path][0] if path in self.table else s[path[-1]].centroid for path, _, _ in self.paths(values)]
        return float(np.mean(mids))

    def interval(self, values: Sequence[float]) -> tuple[float, float]:
        s, lo, up, den = self.part.sets, 0.0, 0.0, 0.0
        for path, mn, prod in self.paths(values):
            _, a, b, p = self.table.get(path, (0.0, s[path[-1]].lower, s[path[-1]].upper, 1.0))
            w = prod * p if self.mode == "probabilistic" else mn
            lo, up, den = lo + w * a, up + w * b, den + w
        return lo / den, up / den


def collect_rules(rules: DataFrame, part: Partition, lags: Sequence[int], mode: str = "mean") -> Rules:
    """Brings a rule table to the driver after a check of its proven bound."""
    if len(part) ** len(lags) > SMALL:
        raise ValueError("the rule table may exceed what is broadcast")
    p = F.col("p") if "p" in rules.columns else F.lit(1.0)
    rows = rules.select("path", "mid", "lower", "upper", p.alias("p")).collect()
    return Rules(part, tuple(lags), {tuple(r["path"]): (r["mid"], r["lower"], r["upper"], r["p"]) for r in rows}, mode)


def last_values(df: DataFrame, n: int, key: str) -> DataFrame:
    """key, t, values: the last n values of each series, oldest first; partial aggregates keep n values a task."""
    top = df.where(F.col("x").isNotNull()).groupBy(key).agg(F.max("t").alias("t"))
    near = df.join(top.withColumnRenamed("t", "_end"), key).where((F.col("t") > F.col("_end") - n) & F.col("x").isNotNull())
    g = near.groupBy(key).agg(F.max("t").alias("t"), F.sort_array(F.collect_list(F.struct("t", "x"))).alias("v"))
    return g.select(key, "t", F.transform("v", lambda s: s["x"]).alias("values")).where(F.size("values") >= n)


def _each(df: DataFrame, key: str, n: int, schema: str, f: Callable) -> DataFrame:
    src = last_values(df, n, key)

    def run(batches):
        for pdf in batches:
            rows = [(k, *r) for k, t, v in zip(pdf[key], pdf["t"], pdf["values"], strict=True) for r in f(int(t), [float(x) for x in v])]
            if rows:
                yield pd.DataFrame(rows)

    return src.mapInPandas(run, f"{key} {src.schema[key].dataType.simpleString()}, {schema}")


def point_ahead(df: DataFrame, rules: Rules, steps: int, key: str = "series_id") -> DataFrame:
    """key, target_t, horizon, yhat."""
    n = max(rules.lags)

    def f(t, values):
        for h in range(1, steps + 1):
            y = rules.point(values)
            values = [*values[-n:], y]
            yield t + h, h, y

    return _each(df, key, n, "target_t bigint, horizon int, yhat double", f)


def interval_ahead(df: DataFrame, rules: Rules, steps: int, key: str = "series_id") -> DataFrame:
    """key, target_t, horizon, lower, upper: the lower path feeds lower bounds, the upper path upper bounds, within the
    sets' reach; a bound that has reached the edge of the sets stays there."""
    n = max(rules.lags)
    first, last = rules.part.sets[0].lower, rules.part.sets[-1].upper
    clip = lambda x: min(max(x, first), last)

    def f(t, values):
        low, high = list(values), list(values)
        for h in range(1, steps + 1):
            a, b = rules.interval([clip(x) for x in low]), rules.interval([clip(x) for x in high])
            lo = first if low[-1] <= first else min(a[0], b[0])
            up = last if high[-1] >= last else max(a[1], b[1])
            low, high = [*low[-n:], lo], [*high[-n:], up]
            yield t + h, h, lo, up

    return _each(df, key, n, "target_t bigint, horizon int, lower double, upper double", f)


def distribution_ahead(df: DataFrame, part: Partition, mass: DataFrame, lags: Sequence[int], steps: int, bins: int = 30, key: str = "series_id") -> DataFrame:
    """key, target_t, horizon, bin_ix, bin, density: mixtures over the products of the lagged distributions.

    A forecast given exact inputs is a mixture of the fired left sides' densities; an uncertain input is replaced by its
    distribution over the bins, so a step costs bins ** (uncertain lags).
    """
    if len(part) ** len(lags) > SMALL or bins ** len(lags) > SMALL:
        raise ValueError("too many bins for this order")
    at = np.linspace(part.lo, part.hi, bins)
    degree = np.array([[s.degree(x) for x in at] for s in part.sets])
    z = degree.sum(axis=1)
    table: dict[tuple[int, ...], np.ndarray] = {}
    total = 0.0
    for r in mass.collect():
        table.setdefault(tuple(r["path"]), np.zeros(len(part)))[r["rhs_ix"]] += r["mass"]
        total += r["mass"]
    density = {k: (m / m.sum()) @ (degree / np.where(z > 0, z, 1)[:, None]) for k, m in table.items()}
    share = {k: m.sum() / total / max(1e-300, z[list(k)].sum()) for k, m in table.items()}
    model = Rules(part, tuple(lags), {})
    n = max(lags)

    def exact(values):
        num, den = np.zeros(bins), 0.0
        for path, _, mu in model.paths(values):
            if path in density:
                num, den = num + mu * share[path] * density[path], den + mu * share[path]
        if den == 0:
            num[int(np.abs(at - values[-1]).argmin())] = den = 1.0
        return num / den

    memo: dict[tuple[float, ...], np.ndarray] = {}

    def f(t, values):
        past: list[np.ndarray | float] = list(values)
        for h in range(1, steps + 1):
            need = sorted(lags, reverse=True)
            options = [[(float(past[-o]), 1.0)] if isinstance(past[-o], float) else [(float(at[b]), float(w)) for b, w in enumerate(past[-o]) if w > 1e-6] for o in need]
            mix = np.zeros(bins)
            for combo in itertools.product(*options):
                inputs = [0.0] * n
                for o, (x, _) in zip(need, combo, strict=True):
                    inputs[-o] = x
                k = tuple(inputs)
                if k not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[k] = exact(inputs)
                mix += float(np.prod([w for _, w in combo])) * memo[k]
            mix /= mix.sum()
            past = [*past[-n:], mix]
            yield from ((t + h, h, b, float(at[b]), float(d)) for b, d in enumerate(mix) if d > 0)

    return _each(df, key, n, "target_t bigint, horizon int, bin_ix int, bin double, density double", f)


def multivariate_ahead(last: DataFrame, future: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, steps: int) -> DataFrame:
    """horizon, t, yhat: the target of each step comes from `step` (a plan: frame with t and all variables -> target_t, yhat),
    the other variables from `future` (t and their columns).

    One row a series enters each step; a step's rows are written before the next reads them, so plans don't grow with the steps.
    """
    now, out = last, None
    for h in range(1, steps + 1):
        y = cut(step(now).select(F.col("target_t").alias("t"), F.col("yhat").alias(target)))
        part = y.select(F.lit(h).alias("horizon"), "t", F.col(target).alias("yhat"))
        out = part if out is None else out.unionByName(part)
        now = future.drop(target).join(y, "t")
    return out
