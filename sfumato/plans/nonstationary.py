"""Non-stationary models: sets that move and widen with time.

Unconditional displacement is a polynomial of the window's time, so degrees are projections and rules stay a plain group-by;
rule midpoints keep the mean coefficients of their sets, which gives the midpoint at any time.  The conditional model
feeds its own errors back and is sequential within a series: rows stream through one task a series with a state of fixed size.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sfumato.functions.membership import membership
from sfumato.functions.scalars import PERTURBATIONS
from sfumato.operators.partition import Partition
from sfumato.operators.rules import paths, small
from sfumato.plans import in_row


@dataclass(frozen=True)
class Moving:
    """A partition with polynomial location and width coefficients (highest power first) by set."""

    part: Partition
    location: tuple[tuple[float, ...], ...]
    width: tuple[tuple[float, ...], ...]
    window: int = 1

    def time(self, t: Column) -> Column:
        """The time that displaces a row: the start of its window."""
        return t - F.pmod(t, F.lit(self.window))

    @property
    def uniform(self) -> bool:
        """Whether all sets move alike and keep their width: then the sets of x at t are the grid's of x less the displacement."""
        return self.part.grid is not None and len(set(self.location)) == 1 and not any(v for w in self.width for v in w)

    def still(self, x: Column, t: Column) -> Column:
        """x less the displacement at t (of uniform sets)."""
        return x - PERTURBATIONS["polynomial"](self.time(t), self.location[0])

    def degrees(self, x: Column, t: Column) -> Column:
        w = self.time(t)
        out = []
        for i, s in enumerate(self.part.sets):
            loc, wid = PERTURBATIONS["polynomial"](w, self.location[i]), PERTURBATIONS["polynomial"](w, self.width[i])
            out.append(F.struct(F.lit(i).alias("set_ix"), membership(s.mf, x, move(s.mf, s.p, loc, wid)).alias("mu")))
        return F.array(*out)

    def fired(self, x: Column, t: Column) -> Column:
        """Sets with a degree; none: the set at the nearer edge, with 1."""
        d = F.filter(self.degrees(x, t), lambda s: s["mu"] > 0)
        first = F.lit(self.part.sets[0].centroid) + PERTURBATIONS["polynomial"](self.time(t), self.location[0])
        edge = F.when(x < first, 0).otherwise(len(self.part) - 1)
        return F.when(x.isNotNull(), F.when(F.size(d) > 0, d).otherwise(F.array(F.struct(edge.alias("set_ix"), F.lit(1.0).alias("mu")))))


def move(mf: str, p: Sequence[float], loc: Column, wid: Column) -> list[Column]:
    """Parameters of a set after a shift and a widening."""
    c = [F.lit(float(v)) for v in p]
    if mf == "trimf":
        return [c[0] + loc - wid / 2, c[1] + loc, c[2] + loc + wid / 2]
    if mf == "trapmf":
        a, b, d, e = p
        inner = (b - a) / (e - a)
        return [c[0] + loc - wid, c[1] + loc - wid * inner, c[2] + loc + wid * ((e - d) / (e - a)), c[3] + loc + wid]
    if mf == "gaussmf":
        return [c[0] + loc, c[1] + wid]
    if mf == "sigmf":
        return [c[0], c[1] + loc]
    if mf == "bellmf":
        return [c[0] + wid, c[1], c[2] + loc]
    raise KeyError(mf)


def polynomial(df: DataFrame, part: Partition, window: int, degree: int = 2) -> Moving:
    """Location and width of each set from polynomials through the windows' extremes.

    The extremes are one row a window, aggregated on the map side.  Least squares need only sums of powers of the windows'
    time over all of them, which is scaled to [-1, 1] for that; the driver solves equations for degree + 1 numbers.
    """
    seen = df.where(F.col("x").isNotNull())
    w = (F.floor(F.col("t") / window) * window).cast("double")
    first, last = seen.agg(F.min(w), F.max(w)).head()
    mid, half = (first + last) / 2, (last - first) / 2 or 1.0
    u = (F.col("w") - mid) / half
    power = lambda k: F.pow(u, F.lit(k)) if k else F.lit(1.0)
    ends = seen.groupBy(w.alias("w")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    sums = ends.agg(
        *(F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)), *(F.sum(F.col(c) * power(k)).alias(f"{c}{k}") for c in "ab" for k in range(degree + 1)),
    ).head()
    size = min(degree, int(sums["s0"]) - 1) + 1
    normal = np.array([[sums[f"s{i + j}"] for j in range(size)] for i in range(size)])

    def fit(c: str) -> np.ndarray:
        scaled = np.linalg.solve(normal, [sums[f"{c}{k}"] for k in range(size)])
        p = np.poly1d(scaled[::-1])(np.poly1d([1 / half, -mid / half])).coeffs
        return np.pad(p, (size - len(p), 0))

    low, high = fit("a"), fit("b")
    low0, high0 = np.polyval(low, first), np.polyval(high, first)
    n = len(part)
    loc, wid = [], []
    for i in range(n):
        k = i / max(1, n - 1)
        c = (1 - k) * low + k * high
        c[-1] -= (1 - k) * low0 + k * high0  # no displacement at the start
        loc.append(tuple(map(float, c)))
        d = (high - low) / n
        d[-1] -= (high0 - low0) / n
        wid.append(tuple(map(float, d)))
    return Moving(part, tuple(loc), tuple(wid), window)


def rules(df: DataFrame, m: Moving, lags: Sequence[int] = (1,), weighted: bool = False) -> DataFrame:
    """path, mid, lower, upper, and k0, k1, ...: mean location coefficients of the successors."""
    x, t = F.col("x"), F.col("t")
    if m.uniform and in_row.learns([m.part] * (len(lags) + 1)):
        seen = in_row.rules(df, m.part, lags, x=m.still(x, t))
    else:
        seen = paths(df, None, lags, rhs=True, fuzzy=m.fired(x, t)).groupBy("path", "rhs_ix").agg(F.count(F.lit(1)).alias("n"))
    w = F.col("n") if weighted else F.lit(1)
    p, j = m.part, F.col("rhs_ix")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    width = max(map(len, m.location))
    coef = [mean(p._pick(j, [((0.0,) * (width - len(c)) + c)[q] for c in m.location])).alias(f"k{q}") for q in range(width)]
    return seen.groupBy("path").agg(mean(p.centroid(j)).alias("mid"), mean(p.lower(j)).alias("lower"), mean(p.upper(j)).alias("upper"), *coef)


def forecast(df: DataFrame, m: Moving, rule_table: DataFrame, lags: Sequence[int] = (1,)) -> DataFrame:
    """target_t, yhat, lower, upper, with the rules' midpoints at the time of the newest input."""
    width = max(map(len, m.location))
    if m.uniform and in_row.fits([m.part] * len(lags)):
        return _forecast_in_row(df, m, rule_table, lags, width)
    f = paths(df, None, lags, fuzzy=m.fired(F.col("x"), F.col("t")))
    j = f.join(small(rule_table, len(m.part) ** len(lags)), "path", "left")
    at = m.time(F.col("t") - 1)
    own = [m.part._pick(F.col("newest"), [((0.0,) * (width - len(c)) + c)[q] for c in m.location]) for q in range(width)]
    shift = F.lit(0.0)
    for q in range(width):
        shift = shift * at + F.coalesce(F.col(f"k{q}"), own[q])
    mu, n = F.col("mu_prod"), F.sum("mu_prod")
    val = lambda c, pick: F.sum(mu * (F.coalesce(F.col(c), pick(F.col("newest"))) + shift)) / n
    return j.groupBy(F.col("t").alias("target_t")).agg(
        val("mid", m.part.centroid).alias("yhat"), val("lower", m.part.lower).alias("lower"), val("upper", m.part.upper).alias("upper"))


def _forecast_in_row(df: DataFrame, m: Moving, rule_table: DataFrame, lags: Sequence[int], width: int) -> DataFrame:
    """For sets that move alike: slots of the grid after the displacement is taken off."""
    part = m.part
    p = in_row.lagged_paths(df, part, lags, "product", x=m.still(F.col("x"), F.col("t")))
    ks = [f"k{q}" for q in range(width)]
    alike = (0.0,) * (width - len(m.location[0])) + tuple(m.location[0])
    own = {"mid": lambda k: part[k[-1]].centroid, "lower": lambda k: part[k[-1]].lower, "upper": lambda k: part[k[-1]].upper}
    own |= {k: (lambda _, v=v: v) for k, v in zip(ks, alike, strict=True)}
    r = in_row.Rules(rule_table, [len(part)] * len(lags), tuple(own), own)
    at = m.time(F.col("t") - 1)

    def shift(c: int) -> Column:
        out = F.lit(0.0)
        for k in ks:
            out = out * at + r.get(k, p.number(c))
        return out

    src = p.df.withColumns({f"d{c}": shift(c) for c in p.range} | {"_n": p.sum(p.degree)})
    mean = lambda col: p.sum(lambda c: p.degree(c) * (r.get(col, p.number(c)) + F.col(f"d{c}"))) / F.col("_n")
    return src.select(F.col("t").alias("target_t"), mean("mid").alias("yhat"), mean("lower").alias("lower"), mean("upper").alias("upper"))


class Conditional:
    """State of one series: residual memory and the last excesses beyond the universe.  Triangles only.

    A step handles few numbers, so it is plain Python rather than arrays.
    """

    def __init__(self, part: Partition, mids: dict[int, float], mean_residual: float, memory: int = 5, residuals: Sequence[float] = ()):
        self.lo, self.hi, self.mean = part.lo, part.hi, mean_residual
        self.c = [s.centroid for s in part.sets]
        self.p = [s.p for s in part.sets]
        self.mids = [mids.get(i, c) for i, c in enumerate(self.c)]
        self.low, self.high = deque([0.0] * 3, 3), deque([0.0] * 3, 3)
        self.residuals: deque[float] = deque(residuals, memory)
        self.before: float | None = None

    def displacement(self, x: float) -> tuple[list[float], list[float]]:
        """(location, scale) of each set.

        Locations are range/2 + w + bias + k for k over [-sd, sd] and w over [low, high], n steps each; the first n of that
        list (k at its start) are the sets', and scales are distances of its neighbours two apart.
        """
        n = len(self.c)
        self.low.appendleft(min(0.0, x - self.lo))
        self.high.appendleft(max(0.0, x - self.hi))
        a, b = min(self.low), max(self.high)
        r = self.residuals
        bias = sum(r) / len(r) if r else 0.0
        sd = math.sqrt(sum((e - bias) ** 2 for e in r) / len(r)) if r else 0.0
        sd = 0.0 if sd < 1 else sd
        step = (b - a) / (n - 1) if n > 1 else 0.0
        base = (b - a) / 2 + self.mean + bias - sd
        loc = [base + a + k * step for k in range(n)]
        after = base + a + (2 * sd / (n - 1) if n > 1 else 0.0)  # the list's next value: k one step on, w at its start
        every = [*loc, after, after + step]
        return loc, [abs(every[0] - every[2]), *(abs(every[k - 1] - every[k + 1]) for k in range(1, n))]

    def step(self, x: float) -> float:
        """Forecast of the value after x."""
        if self.before is not None:
            self.residuals.append(x - self.before)
        self.before = self.value(x, *self.displacement(x))
        return self.before

    def value(self, x: float, loc: Sequence[float], scale: Sequence[float]) -> float:
        """Forecast of the value after x by sets so displaced."""
        num = den = 0.0
        for (a, b, c), d, w, mid in zip(self.p, loc, scale, self.mids, strict=True):
            a, b, c = a + d - w / 2, b + d, c + d + w / 2
            if a < x < c:
                mu = 1.0 if x == b else (x - a) / (b - a) if x < b else (c - x) / (c - b)
                num, den = num + mu * (mid + d), den + mu
        if not den:
            i = 0 if x < self.p[0][1] + loc[0] else len(self.c) - 1
            num, den = self.mids[i] + loc[i], 1.0
        return num / den


def train_residuals(df: DataFrame, part: Partition, rule_mids: dict[int, float], key: str = "series_id", memory: int = 5) -> DataFrame:
    """key, mean, residuals: the mean error of a first forecast over the training rows and its last `memory` errors, by series.

    That forecast has no displacement; its sets are widened by 1.
    """
    n = len(part)
    still, wide = [0.0] * n, [1.0] * n

    def run(batches):
        plain, last, before = Conditional(part, rule_mids, 0.0, memory), object(), None
        total, count, kept = 0.0, 0, deque(maxlen=memory)
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf["x"], strict=True):
                if k != last:
                    if count:
                        out.append((last, total / count, list(kept)))
                    last, before, total, count, kept = k, None, 0.0, 0, deque(maxlen=memory)
                if x == x:
                    if before is not None:
                        total, count = total + float(x) - before, count + 1
                        kept.append(float(x) - before)
                    before = plain.value(float(x), still, wide)
            yield pd.DataFrame(out, columns=[key, "mean", "residuals"])
        if count:
            yield pd.DataFrame([(last, total / count, list(kept))], columns=[key, "mean", "residuals"])

    src = df.select(key, "t", "x").repartition(key).sortWithinPartitions(key, "t")
    return src.mapInPandas(run, f"{key} {src.schema[key].dataType.simpleString()}, mean double, residuals array<double>")


def conditional_forecast(df: DataFrame, part: Partition, rule_mids: dict[int, float], mean_residual: float | DataFrame, key: str = "series_id", memory: int = 5) -> DataFrame:
    """key, target_t, yhat: series are parallel, the rows of one stream in order through a state of fixed size.

    mean_residual: what `train_residuals` gives, or one number for all series, whose memories are empty then.
    """
    trained = isinstance(mean_residual, DataFrame)
    given = 0.0 if trained else mean_residual

    def run(batches):
        state, last = None, object()
        for pdf in batches:
            out = []
            for k, t, x, mean, kept in zip(pdf[key], pdf["t"], pdf["x"], pdf["mean"], pdf["residuals"], strict=True):
                if k != last:
                    state, last = Conditional(part, rule_mids, given, memory), k
                if kept is not None:
                    state = Conditional(part, rule_mids, mean, memory, kept)
                elif x == x:
                    out.append((k, t + 1, state.step(float(x))))
            yield pd.DataFrame(out, columns=[key, "target_t", "yhat"])

    src = df.select(key, F.col("t").cast("long").alias("t"), "x", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("array<double>").alias("residuals"))
    if trained:  # one row a series, before its others
        src = src.unionByName(mean_residual.select(key, F.lit(-(2**63)).cast("long").alias("t"), F.lit(None).cast("double").alias("x"), "mean", "residuals"))
    src = src.repartition(key).sortWithinPartitions(key, "t")
    return src.mapInPandas(run, f"{key} {src.schema[key].dataType.simpleString()}, target_t bigint, yhat double")


def variance_forecast(df: DataFrame, part: Partition, rule_mids: dict[int, float], key: str = "series_id", memory: int = 5) -> DataFrame:
    """Conditional-variance variant: training and displacement are those of the conditional model."""
    return conditional_forecast(df, part, rule_mids, train_residuals(df, part, rule_mids, key, memory), key, memory)
