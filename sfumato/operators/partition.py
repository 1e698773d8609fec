"""Partitioners: a numeric universe into fuzzy sets.

Sets are metadata of a few hundred rows at most.  They are computed from aggregates and then kept on the driver, so that
fuzzification is made of literals and needs no join; as_df gives them as a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.functions.membership import bounds, centroid, degree, membership

MAX_SETS = 10_000


@dataclass(frozen=True)
class FuzzySet:
    name: str
    mf: str
    p: tuple[float, ...]
    centroid: float
    lower: float
    upper: float
    alpha: float = 1.0
    #: Further shapes of a composite set; its degree is the greatest of all.
    more: tuple[tuple[str, tuple[float, ...]], ...] = ()

    def mu(self, x: Column) -> Column:
        shapes = [membership(self.mf, x, self.p), *(membership(m, x, p) for m, p in self.more)]
        mu = F.greatest(*shapes) if len(shapes) > 1 else shapes[0]
        return mu if self.alpha == 1.0 else mu * F.lit(self.alpha)

    def degree(self, x: float) -> float:
        return max(degree(self.mf, x, self.p), *(degree(m, x, p) for m, p in self.more), 0.0) * self.alpha


def make_set(name: str, mf: str, p: Sequence[float], at: float | None = None, alpha: float = 1.0) -> FuzzySet:
    lo, hi = bounds(mf, p)
    return FuzzySet(name, mf, tuple(map(float, p)), float(centroid(mf, p) if at is None else at), float(lo), float(hi), alpha)


@dataclass(frozen=True)
class Partition:
    """Sets in the order of their centroids, over the universe [lo, hi]."""

    sets: tuple[FuzzySet, ...]
    lo: float
    hi: float
    #: (first centroid, step) of a uniform grid of triangles, which is fuzzified by arithmetic.
    grid: tuple[float, float] | None = None
    cyclic: bool = False
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def __len__(self) -> int:
        return len(self.sets)

    def _pick(self, ix: Column, values: Sequence[float]) -> Column:
        return F.get(F.array(*map(F.lit, values)), ix)

    def centroid(self, ix: Column) -> Column:
        return self._pick(ix, [s.centroid for s in self.sets])

    def lower(self, ix: Column) -> Column:
        return self._pick(ix, [s.lower for s in self.sets])

    def upper(self, ix: Column) -> Column:
        return self._pick(ix, [s.upper for s in self.sets])

    def as_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.name, s.mf, list(s.p), s.lower, s.centroid, s.upper, s.alpha) for i, s in enumerate(self.sets)]
        return spark.createDataFrame(rows, "set_ix int, name string, mf string, p array<double>, lower double, centroid double, upper double, alpha double")

    @property
    def lower_set(self) -> FuzzySet:
        return self.sets[0]

    @property
    def upper_set(self) -> FuzzySet:
        return self.sets[-1]

    def __getitem__(self, name: str | int) -> FuzzySet:
        return self.sets[name] if isinstance(name, int) else next(s for s in self.sets if s.name == name)

    def __iter__(self):
        return iter(self.sets)

    def mass(self, bins: int = 100) -> list[float]:
        """Z of each set: the sum of its degrees over equally spaced points of the universe."""
        return [sum(s.degree(self.lo + k * (self.hi - self.lo) / (bins - 1)) for k in range(bins)) for s in self.sets]


def universe(df: DataFrame, x: str, margin: float = 0.1) -> tuple[float, float]:
    """[lo, hi] of a column, widened by a margin away from zero's side; NULL and NaN don't count.  (0, 1) if empty."""
    c = F.col(x).cast("double")
    row = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))).agg(F.min(c).alias("a"), F.max(c).alias("b")).head()
    if row["a"] is None:
        return 0.0, 1.0
    lo = row["a"] * (1 + margin) if row["a"] < 0 else row["a"] * (1 - margin)
    hi = row["b"] * (1 + margin) if row["b"] > 0 else row["b"] * (1 - margin)
    return (lo, hi) if hi > lo else (lo, lo + 1.0)


def _shape(mf: str, c: float, p: float, gauss: float = 3.0) -> tuple[float, ...]:
    return {"trimf": (c - p, c, c + p), "gaussmf": (c, p / gauss), "trapmf": (c - p, c - p / 2, c + p / 2, c + p), "bellmf": (p / 2, 2.0, c)}[mf]


def grid_over(lo: float, hi: float, n: int, mf: str = "trimf", prefix: str = "A") -> Partition:
    """n sets of equal width; the universe's lower end moves down by one step, as published results have it."""
    p = (hi - lo) / (n - 1)
    sets = tuple(make_set(f"{prefix}{i}", mf, _shape(mf, lo + i * p, p), lo + i * p) for i in range(n))
    return Partition(sets, lo - p, hi, (lo, p) if mf == "trimf" else None)


def grid(df: DataFrame, x: str, n: int = 10, mf: str = "trimf", margin: float = 0.1) -> Partition:
    return grid_over(*universe(df, x, margin), n, mf)


def huarng(df: DataFrame, x: str, order: str, mf: str = "trimf") -> Partition:
    """Average-length intervals: the base follows from half the mean change."""
    from sfumato.operators.series import with_lags

    lo, hi = universe(df, x)
    change = with_lags(df.select(F.col(order).alias("t"), F.col(x).alias("x")), ["x"], [1])
    row = change.agg((F.sum(F.coalesce(F.col("x") - F.col("x_1"), F.lit(0.0))) / F.count(F.lit(1))).alias("d")).head()
    d = abs((row["d"] or 0.0) / 2)
    base = 0.1 if d <= 1 else 1.0 if d <= 10 else 10.0 if d <= 100 else 100.0
    n, start = math.ceil((hi - lo) / base), math.ceil(lo)
    if n > MAX_SETS:
        raise ValueError(f"{n} sets; more than {MAX_SETS}")
    return Partition(tuple(make_set(f"A{k}", mf, _shape(mf, start + k * base, base, 2.0), start + k * base) for k in range(n)), lo, hi)


def _between(points: Sequence[float], mf: str, lo: float, hi: float) -> Partition:
    """Interior points of a sorted list as centres of triangles (or trapezoids) that reach to their neighbours."""
    pts = sorted({lo, *points, hi})
    sets = []
    for i in range(1, len(pts) - 1):
        a, b, c = pts[i - 1 : i + 2]
        shape = (a, b, c) if mf == "trimf" else (a, b - (b - a) / 2, b + (c - b) / 2, c)
        sets.append(make_set(f"A{i - 1}", mf, shape, b))
    return Partition(tuple(sets), lo, hi)


#: Distinct values that may come to the driver; where there are more, the same steps run over all rows.
DRIVER_VALUES = 1_000_000


def _finite(df: DataFrame, x: str) -> DataFrame:
    c = F.col(x).cast("double")
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))).select(c.alias("x"))


def histogram(rows: DataFrame, limit: int) -> list[tuple[float, int]] | None:
    """(value, count) of x in order; None where there are more than `limit` distinct values."""
    got = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    return sorted((r["x"], r["n"]) for r in got) if len(got) <= limit else None


def value_at(rows: DataFrame, rank: int, limit: int) -> float:
    """The smallest value of x with at least `rank` values at or below it, exactly.

    The range is narrowed by approximate percentiles whose parts are counted exactly, until its values fit the driver.
    """
    while (values := histogram(rows, limit)) is None:
        cuts = sorted(set(rows.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 10_000).alias("q")).head()["q"]))
        ends = F.array(*map(F.lit, cuts))
        part = F.size(F.filter(ends, lambda c: c < F.col("x")))
        got = rows.withColumn("k", part).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == F.get(ends, F.col("k"))).alias("end")).collect()
        counts, at_end = {r["k"]: r["n"] for r in got}, {r["k"]: r["end"] for r in got}
        k = 0
        while rank > counts.get(k, 0):
            rank, k = rank - counts.get(k, 0), k + 1
        if rank > counts[k] - at_end[k]:
            return cuts[k]
        rows = rows.where((F.col("x") > cuts[k - 1]) if k else F.lit(True)).where((F.col("x") < cuts[k]) if k < len(cuts) else F.lit(True))
    for v, n in values:
        rank -= n
        if rank <= 0:
            return v
    return values[-1][0]


def entropy_thresholds(values: Sequence[tuple[float, int]], n: int) -> list[float]:
    """Thresholds by recursive splits at the first fall of the two-part entropy over sorted (value, count)."""
    total, run, best, theta = sum(c for _, c in values), 0, -math.inf, None
    for v, c in values:
        run += c
        q = run / total
        h = 1.0 if q in (0.0, 1.0) else -(q * math.log(q) + (1 - q) * math.log(1 - q))
        theta = v
        if h < best:
            break
        best = h
    if theta is None:
        return []
    half, odd = (n - n % 2) // 2, n % 2
    if half <= 1:
        return [theta]
    low = [r for r in values if r[0] <= theta]
    high = [r for r in values if r[0] > theta]
    out = [theta]
    n_low, n_high = sum(c for _, c in low), sum(c for _, c in high)
    for part, k in ((low, half + odd * (n_low > n_high)), (high, half + odd * (n_low <= n_high))):
        if len(part) > 1:
            out += entropy_thresholds(part, k)
    return out


def _split_entropy(q: float) -> float:
    return 1.0 if q in (0.0, 1.0) else -(q * math.log(q) + (1 - q) * math.log(1 - q))


def _entropy_over_rows(rows: DataFrame, n: int, limit: int) -> list[float]:
    """entropy_thresholds where the values don't fit the driver.

    The two-part entropy rises up to the half of the rows, so it falls first at the value that reaches the half or at the next.
    """
    values = histogram(rows, limit)
    if values is not None:
        return entropy_thresholds(values, n)
    total = rows.count()
    mid = value_at(rows, -(-total // 2), limit)
    at = rows.agg(F.count_if(F.col("x") < mid).alias("a"), F.count_if(F.col("x") <= mid).alias("b"), F.min(F.when(F.col("x") > mid, F.col("x"))).alias("next")).head()
    falls = at["a"] > 0 and _split_entropy(at["b"] / total) < _split_entropy(at["a"] / total)
    theta = mid if falls or at["next"] is None else at["next"]
    half, odd = (n - n % 2) // 2, n % 2
    if half <= 1:
        return [theta]
    low, high = rows.where(F.col("x") <= theta), rows.where(F.col("x") > theta)
    n_low = low.count()
    out = [theta]
    for part, k in ((low, half + odd * (n_low > total - n_low)), (high, half + odd * (n_low <= total - n_low))):
        ends = part.agg(F.min("x"), F.max("x")).head()
        if ends[0] is not None and ends[0] < ends[1]:
            out += _entropy_over_rows(part, k, limit)
    return out


def entropy(df: DataFrame, x: str, n: int = 10, mf: str = "trimf", limit: int | None = None) -> Partition:
    lo, hi = universe(df, x)
    return _between(_entropy_over_rows(_finite(df, x), n, DRIVER_VALUES if limit is None else limit), mf, lo, hi)


def _start(values: Sequence[tuple[float, int]], k: int) -> list[float]:
    """Quantiles of the histogram, a deterministic start for the clusterings."""
    total, run, out, j = sum(c for _, c in values), 0, [], 0
    for v, c in values:
        run += c
        while j < k and run >= total * (j + 0.5) / k:
            out.append(v)
            j += 1
    return sorted(set(out))


def _start_over_rows(rows: DataFrame, k: int, limit: int) -> list[float]:
    total = rows.count()
    return sorted({value_at(rows, max(1, math.ceil(total * (j + 0.5) / k)), limit) for j in range(k)})


def _sums(rows: DataFrame, weights: Sequence[Column]) -> list[tuple[float, float]]:
    """(sum of w * x, sum of w) for each weight, in one pass that adds up in each task first."""
    r = rows.agg(*(F.sum(w * F.col("x")).alias(f"a{i}") for i, w in enumerate(weights)), *(F.sum(w).alias(f"b{i}") for i, w in enumerate(weights))).head()
    return [(r[f"a{i}"] or 0.0, r[f"b{i}"] or 0.0) for i in range(len(weights))]


def fcm(df: DataFrame, x: str, n: int = 10, mf: str = "trimf", steps: int = 100, delta: float = 1e-3, limit: int | None = None) -> Partition:
    """Fuzzy c-means with fuzziness 2, over the weighted distinct values or, where these are too many, a pass over all rows a step."""
    import numpy as np

    limit = DRIVER_VALUES if limit is None else limit
    lo, hi = universe(df, x)
    rows = _finite(df, x)
    values = histogram(rows, limit)
    if values is not None:
        v, w = np.array([a for a, _ in values]), np.array([b for _, b in values], float)
    c = np.array(_start(values, n) if values is not None else _start_over_rows(rows, n, limit))
    for _ in range(steps):
        if values is not None:
            d2 = np.maximum((v[:, None] - c[None, :]) ** 2, 1e-18)
            m = (1 / d2) / (1 / d2).sum(axis=1, keepdims=True)
            m2 = m**2 * w[:, None]
            new = (m2 * v[:, None]).sum(axis=0) / m2.sum(axis=0)
        else:
            near = [F.lit(1.0) / F.greatest((F.col("x") - float(a)) * (F.col("x") - float(a)), F.lit(1e-18)) for a in c]
            src = rows.select("x", *(a.alias(f"d{i}") for i, a in enumerate(near)))
            src = src.withColumn("all", sum((F.col(f"d{i}") for i in range(len(c))), F.lit(0.0)))
            new = np.array([a / b for a, b in _sums(src, [F.pow(F.col(f"d{i}") / F.col("all"), 2) for i in range(len(c))])])
        moved, c = np.abs(new - c).max(), new
        if moved < delta:
            break
    return _between([round(float(a), 3) for a in c], mf, lo, hi)


def cmeans(df: DataFrame, x: str, n: int = 10, steps: int = 1000, limit: int | None = None) -> Partition:
    """Hard k-means, by prefix sums over the weighted distinct values between the midpoints of the centres or, where these are
    too many, a pass over all rows a step."""
    import numpy as np

    limit = DRIVER_VALUES if limit is None else limit
    lo, hi = universe(df, x)
    rows = _finite(df, x)
    values = histogram(rows, limit)
    if values is not None:
        v, w = np.array([a for a, _ in values]), np.array([b for _, b in values], float)
        sw, sx = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * v)))
    c = np.array(_start(values, n) if values is not None else _start_over_rows(rows, n, limit))
    for _ in range(steps):
        mids = (c[1:] + c[:-1]) / 2
        if values is not None:
            cuts = np.concatenate(([0], np.searchsorted(v, mids), [len(v)]))
            total, size = sx[cuts[1:]] - sx[cuts[:-1]], sw[cuts[1:]] - sw[cuts[:-1]]
        else:
            ends = [-math.inf, *map(float, mids), math.inf]
            got = _sums(rows, [F.when((F.col("x") >= a) & (F.col("x") < b), 1.0).otherwise(0.0) for a, b in zip(ends, ends[1:], strict=False)])
            total, size = np.array([a for a, _ in got]), np.array([b for _, b in got])
        new = np.where(size > 0, total / np.maximum(size, 1e-300), c)
        if np.allclose(new, c, rtol=1e-12, atol=0):
            break
        c = new
    return _between([round(float(a), 3) for a in c], "trimf", lo, hi)


#: Blocks of the unit interval and terms of the expansion in each; the potential is exact to rounding (see below).
_BLOCKS, _TERMS = 64, 24


def _moments(rows: DataFrame, a: float, b: float, scale: float):
    """Moments of the Gaussian expansion about each block's centre, summed over all rows: an array (block, term)."""
    import numpy as np

    u = (F.col("x") - a) / (b - a)
    block = F.least(F.floor(u * _BLOCKS), F.lit(_BLOCKS - 1)).cast("int")
    src = rows.select(block.alias("k"), u.alias("u")).select("k", ((F.col("u") - (F.col("k") + 0.5) / _BLOCKS) * scale).alias("y"))
    terms, power = [], F.exp(-F.col("y") * F.col("y"))
    for t in range(_TERMS):
        terms.append(F.sum(power * F.pow("y", F.lit(float(t))) if t else power).alias(f"m{t}"))
    out = np.zeros((_BLOCKS, _TERMS))
    for r in src.groupBy("k").agg(*terms).collect():
        out[r["k"]] = [r[f"m{t}"] for t in range(_TERMS)]
    return out


def subclust(df: DataFrame, x: str, ra: float = 0.5, eps_sup: float = 0.5, eps_inf: float = 0.15, mf: str = "trimf", batch: int = 4096) -> Partition:
    """Subtractive clustering on values scaled to [0, 1].

    The potential of a value, a sum of Gaussians over all rows, comes from moments of blocks: exp(-(p - q)**2) =
    exp(-p**2) exp(-q**2) sum((2 p q)**t / t!), and |2 p q| within a block is small, so _TERMS terms leave nothing but rounding.
    Each centre takes a pass in which tasks give their own best value; equal potentials go to the smaller value.
    """
    import numpy as np
    import pyarrow as pa

    lo, hi = universe(df, x)
    a, b = universe(df, x, 0.0)
    rows = _finite(df, x)
    if rows.isEmpty():
        return Partition((), lo, hi)
    scale, rb = 2.0 / ra, 1.5 * ra
    moments = _moments(rows, a, b, scale) / np.cumprod([1.0, *range(1, _TERMS)])
    mids = (np.arange(_BLOCKS) + 0.5) / _BLOCKS
    centres: list[tuple[float, float]] = []
    refused: list[float] = []

    def potential(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        for k in np.flatnonzero(moments[:, 0]):
            p = (v - mids[k]) * scale
            out += np.exp(-p * p) * np.polynomial.polynomial.polyval(2 * p, moments[k])
        for c, top in centres:
            out -= top * np.exp(-4 * (v - c) ** 2 / rb**2)
        out[np.isin(v, refused)] = 0
        return out

    def best(batches):
        found = None
        for got in batches:
            v = np.unique((got.column(0).to_numpy() - a) / (b - a))
            for at in range(0, len(v), batch):
                p = potential(v[at : at + batch])
                i = int(p.argmax())
                if found is None or (p[i], -v[at + i]) > (found[0], -found[1]):
                    found = (float(p[i]), float(v[at + i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([found[0]]), pa.array([found[1]])], names=["p", "v"])

    first = None
    while len(centres) < MAX_SETS:
        top = rows.mapInArrow(best, "p double, v double").orderBy(F.col("p").desc(), "v").head()
        first = top["p"] if first is None else first
        if top["p"] <= 0 or top["p"] <= eps_inf * first:
            break
        near = min((abs(top["v"] - c) for c, _ in centres), default=math.inf)
        if top["p"] <= eps_sup * first and near / ra + top["p"] / first < 1:
            refused.append(top["v"])
        else:
            centres.append((top["v"], top["p"]))
    return _between([c * (b - a) + a for c, _ in centres], mf, lo, hi)


def composite(name: str, shapes: Sequence[tuple[str, Sequence[float]]], at: float | None = None) -> FuzzySet:
    """Union of shapes: the greatest degree, the widest bounds, the greatest centroid unless one is given."""
    first, *rest = shapes
    ends = [bounds(m, p) for m, p in shapes]
    c = max(centroid(m, p) for m, p in shapes) if at is None else at
    more = tuple((m, tuple(map(float, p))) for m, p in rest)
    return FuzzySet(name, first[0], tuple(map(float, first[1])), float(c), float(min(a for a, _ in ends)), float(max(b for _, b in ends)), 1.0, more)


def simple(sets: Sequence[tuple[str, str, Sequence[float]]]) -> Partition:
    """Sets given by hand: (name, mf, parameters)."""
    made = sorted((make_set(n, mf, p) for n, mf, p in sets), key=lambda s: s.centroid)
    return Partition(tuple(made), min(s.lower for s in made), max(s.upper for s in made))


def singletons(df: DataFrame, x: str) -> Partition:
    """One set for each distinct value; more than MAX_SETS raise."""
    got = sorted(r["x"] for r in df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x")).distinct().limit(MAX_SETS + 1).collect())
    if len(got) > MAX_SETS:
        raise ValueError("too many distinct values")
    return Partition(tuple(make_set(f"A{i}", "singleton", (v,)) for i, v in enumerate(got)), got[0], got[-1])


def classes(labels: dict[str, int]) -> Partition:
    """Singletons named by class labels."""
    made = sorted((make_set(k, "singleton", (v,)) for k, v in labels.items()), key=lambda s: s.centroid)
    return Partition(tuple(made), made[0].centroid, made[-1].centroid)


def time_grid(season: int, n: int, first: float = 0.0, step: float | None = None) -> Partition:
    """Triangles over a season of n parts; the first also covers the season's end, the last its beginning.

    With a step the midpoints are first, first + step, ... and the ends reach one step; otherwise parts are season / n wide.
    """
    part = season / n if step is None else step
    end = part / 2 if step is None else part
    mids = [part / 2 + k * part for k in range(n)] if step is None else [first + k * part for k in range(n)]
    lo, hi = first, first + season
    sets = [make_set(f"A{i}", "trimf", (m - part, m, m + part), m) for i, m in enumerate(mids)]
    for i, at in ((0, float(season)), (n - 1, 0.0)):
        sets[i] = replace(sets[i], more=(("trimf", (at - end, at, at + end)),))
    return Partition(tuple(sets), lo, hi, cyclic=True)


def explore(df: DataFrame, x: str, builders: dict[str, Callable[[DataFrame, str], Partition]]) -> DataFrame:
    """Sets of several partitioners in one table, with the partitioner's name."""
    spark = df.sparkSession
    out = None
    for name, build in builders.items():
        part = build(df, x).as_df(spark).withColumn("partitioner", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


