"""Fuzzification and defuzzification as projections: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sfumato.operators.partition import Partition

#: Above so many sets of other shapes than the uniform grid their degrees come from a generic expression.
INLINE = 64


def degrees(part: Partition, x: Column) -> Column:
    """array<struct<set_ix, mu>> of all sets."""
    return F.array(*(F.struct(F.lit(i).alias("set_ix"), s.mu(x).alias("mu")) for i, s in enumerate(part.sets)))


def _around(part: Partition, x: Column) -> tuple[Column, Column, Column]:
    """(i, degree in set i, degree in set i + 1) for the sets around x on a grid of triangles; i may lie outside of it."""
    c0, p = part.grid
    near = F.greatest(F.least(x, F.lit(c0 + (len(part) + 1) * p)), F.lit(c0 - 2 * p))  # far values fit a whole number
    i = F.when(x.isNotNull(), F.floor((near - F.lit(c0)) / F.lit(p)).cast("int"))
    return i, *(F.lit(1.0) - F.abs(x - (F.lit(c0) + k * F.lit(p))) / F.lit(p) for k in (i, i + 1))


def fired(part: Partition, x: Column, alpha: float = 0.0, nearest: int | None = None) -> Column:
    """array<struct<set_ix, mu>> of the sets with mu > 0 and mu >= alpha; if none fires, the nearest set with 1.

    On a uniform grid of triangles only the two sets around x can fire, and they follow from arithmetic.
    """
    if part.grid is not None:
        # Plain CASE branches rather than array functions, so that all of it is compiled.
        i, low, high = _around(part, x)
        a, b = (F.struct(k.alias("set_ix"), mu.alias("mu")) for k, mu in ((i, low), (i + 1, high)))
        ok = lambda mu, k: (k >= 0) & (k < len(part)) & (mu > 0) & (mu >= alpha)
        one, two = ok(low, i), ok(high, i + 1)
        none = F.array(F.struct(nearest_set(part, x).alias("set_ix"), F.lit(1.0).alias("mu")))
        return F.when(x.isNotNull(), F.when(one & two, F.array(a, b)).when(one, F.array(a)).when(two, F.array(b)).otherwise(none))
    got = F.filter(degrees(part, x), lambda s: (s["mu"] > 0) & (s["mu"] >= alpha))
    if nearest:
        dist = lambda s: F.abs(part.centroid(s["set_ix"]) - x)
        got = F.slice(F.array_sort(got, lambda a, b: F.when(dist(a) < dist(b), -1).when(dist(a) > dist(b), 1).otherwise(a["set_ix"] - b["set_ix"])), 1, nearest)
    fallback = F.array(F.struct(nearest_set(part, x).alias("set_ix"), F.lit(1.0).alias("mu")))
    return F.when(x.isNotNull(), F.when(F.size(got) > 0, got).otherwise(fallback))


def with_fired(df: DataFrame, part: Partition, x: str, out: str, alpha: float = 0.0) -> DataFrame:
    """Adds fired(part, x) as a column.

    On a grid it goes by steps, each a projection of its own: the place between two sets, its whole part and its rest.  Steps
    used twice aren't inlined by the optimizer, so the compiled code stays small enough for the JVM to compile it in turn.
    """
    if part.grid is None:
        return df.withColumn(out, fired(part, F.col(x), alpha))
    c0, p = part.grid
    n = len(part)
    place = (F.greatest(F.least(F.col(x).cast("double"), F.lit(c0 + (n + 1) * p)), F.lit(c0 - 2 * p)) - F.lit(c0)) / F.lit(p)
    df = df.withColumn("_y", F.when(F.col(x).isNotNull(), place)).withColumn("_i", F.floor("_y").cast("int")).withColumn("_w", F.col("_y") - F.col("_i"))
    i, w = F.col("_i"), F.col("_w")
    a, b = F.struct(i.alias("set_ix"), (1.0 - w).alias("mu")), F.struct((i + 1).alias("set_ix"), w.alias("mu"))
    one, two = (i >= 0) & (i < n), (i >= -1) & (i < n - 1) & (w > 0)
    if alpha > 0:
        one, two = one & (1.0 - w >= alpha), two & (w >= alpha)
    near = F.least(F.greatest(F.when(w > 0.5, i + 1).otherwise(i), F.lit(0)), F.lit(n - 1))
    got = F.when(one & two, F.array(a, b)).when(one, F.array(a)).when(two, F.array(b)).otherwise(F.array(F.struct(near.alias("set_ix"), F.lit(1.0).alias("mu"))))
    return df.withColumn(out, F.when(i.isNotNull(), got)).drop("_y", "_i", "_w")


def with_slots(df: DataFrame, part: Partition, x: str | Column, out: str, alpha: float = 0.0) -> DataFrame:
    """Adds the sets fired(part, x) gives on a grid as a struct of plain values: a, amu and, NULL where only one fires, b, bmu."""
    c0, p = part.grid
    n = len(part)
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    place = (F.greatest(F.least(c, F.lit(c0 + (n + 1) * p)), F.lit(c0 - 2 * p)) - F.lit(c0)) / F.lit(p)
    df = df.withColumn("_y", F.when(c.isNotNull(), place)).withColumn("_i", F.floor("_y").cast("int")).withColumn("_w", F.col("_y") - F.col("_i"))
    i, w = F.col("_i"), F.col("_w")
    inside = F.when(i < 0, 0).when(i >= n, n - 1).otherwise(i)
    both = (i >= 0) & (i < n - 1) & (w > 0)
    if alpha <= 0:
        a, amu = inside, F.when((i >= 0) & (i < n), 1.0 - w).when((i == -1) & (w > 0), w).otherwise(1.0)
    else:  # the set below or above may fall short of alpha
        low, high = (i >= 0) & (i < n) & (1.0 - w >= alpha), (i >= -1) & (i < n - 1) & (w > 0) & (w >= alpha)
        near = F.least(F.greatest(F.when(w > 0.5, i + 1).otherwise(i), F.lit(0)), F.lit(n - 1))
        a, amu = F.when(low, i).when(high, i + 1).otherwise(near), F.when(low, 1.0 - w).when(high, w).otherwise(1.0)
        both = both & (1.0 - w >= alpha) & (w >= alpha)
    df = df.withColumns({"_a": a, "_amu": amu, "_b": F.when(both, i + 1)})
    slots = F.struct(F.col("_a").alias("a"), F.col("_amu").alias("amu"), F.col("_b").alias("b"), F.when(F.col("_b").isNotNull(), w).alias("bmu"))
    return df.withColumn(out, F.when(i.isNotNull(), slots)).drop("_y", "_i", "_w", "_a", "_amu", "_b")


def nearest_set(part: Partition, x: Column) -> Column:
    """Index of the set whose centroid is nearest, ties to the lower one."""
    if part.grid is not None:
        c0, p = part.grid
        place = F.greatest(F.least((x - F.lit(c0)) / F.lit(p) - 0.5, F.lit(float(len(part) - 1))), F.lit(0.0))
        return F.when(x.isNotNull(), F.ceil(place).cast("int"))
    mids = [(a.centroid + b.centroid) / 2 for a, b in zip(part.sets, part.sets[1:], strict=False)]
    return F.size(F.filter(F.array(*map(F.lit, mids)), lambda m: m < x)) if mids else F.lit(0)


def maximum(part: Partition, x: Column) -> Column:
    """Index of the set with the greatest degree, ties to the lower index; the nearest set where none has any."""
    if part.grid is not None:
        i, low, high = _around(part, x)
        return F.when(x.isNotNull(), F.least(F.greatest(F.when(high > low, i + 1).otherwise(i), F.lit(0)), F.lit(len(part) - 1)))
    d = degrees(part, x)
    best = F.array_max(F.transform(d, lambda s: s["mu"]))
    at = F.element_at(F.filter(d, lambda s: s["mu"] == best), 1)["set_ix"]
    return F.when(x.isNotNull(), F.when(best > 0, at).otherwise(nearest_set(part, x)))


def fuzzify(df: DataFrame, part: Partition, x: str = "x", mode: str = "sets", alpha: float = 0.0) -> DataFrame:
    """mode 'sets': one row a fired set (set_ix, mu); 'maximum': set_ix; 'vector': mu array of all sets; 'both': array of structs."""
    c = F.col(x)
    if mode == "sets":
        return with_fired(df, part, x, "_fs", alpha).withColumn("_f", F.explode("_fs")).select("*", "_f.set_ix", "_f.mu").drop("_f", "_fs")
    if mode == "maximum":
        return df.withColumn("set_ix", maximum(part, c))
    if mode == "vector":
        return df.withColumn("mu", F.transform(degrees(part, c), lambda s: s["mu"]))
    if mode == "both":
        return with_fired(df, part, x, "fuzzy", alpha)
    raise ValueError(mode)


def defuzzify(part: Partition, fuzzy: Column, weighted: bool = True) -> Column:
    """Value of an array of (set_ix, mu): the mean of centroids, weighted by mu unless told otherwise."""
    w = (lambda s: s["mu"]) if weighted else (lambda s: F.lit(1.0))
    add = lambda f: F.aggregate(fuzzy, F.lit(0.0), lambda acc, s: acc + f(s))
    return F.try_divide(add(lambda s: w(s) * part.centroid(s["set_ix"])), add(w))


def clip(part: Partition, x: Column) -> Column:
    """x within [lower of the first set, upper of the last]."""
    return F.greatest(F.least(x, F.lit(part.sets[-1].upper)), F.lit(part.sets[0].lower))


def clip_universe(part: Partition, x: Column) -> Column:
    """x within the universe of discourse."""
    return F.greatest(F.least(x, F.lit(part.hi)), F.lit(part.lo))
