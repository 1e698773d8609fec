"""Rule induction: transitions between fuzzy sets, their grouping and weights.

Rule tables have at most (number of sets) ** order left sides, so their size is known; it is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import maximum, with_fired
from sfumato.operators.partition import Partition
from sfumato.operators.series import with_lags

#: A rule table of at most so many possible rows is broadcast.
SMALL = 1_000_000


def small(df: DataFrame, bound: int) -> DataFrame:
    """df marked for broadcast if its proven bound of rows allows it."""
    return F.broadcast(df) if bound <= SMALL else df


def transitions(df: DataFrame, part: Partition, h: int = 1, keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """keys, t, lhs, rhs: the sets of greatest degree at t and t + h."""
    a = df.select(*keys, "t", maximum(part, F.col(x)).alias("a"))
    return with_lags(a, ["a"], [-h], keys).select(*keys, "t", F.col("a").alias("lhs"), F.col(f"a_{-h}").alias("rhs")).where(F.col("rhs").isNotNull())


def indexed(df: DataFrame, part: Partition, season: str, h: int = 1, keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """keys, t, lhs, rhs, season: transitions with the season of the right side's time."""
    a = df.select(*keys, "t", maximum(part, F.col(x)).alias("a"), F.col(season).alias("season"))
    o = with_lags(a, ["a", "season"], [-h], keys).where(F.col(f"a_{-h}").isNotNull())
    return o.select(*keys, "t", F.col("a").alias("lhs"), F.col(f"a_{-h}").alias("rhs"), F.col(f"season_{-h}").alias("season"))


def nonrecurrent(tr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct transitions with the time of their first occurrence."""
    return tr.groupBy(*keys, "lhs", "rhs").agg(F.min("t").alias("first_t"))


def occurrence(tr: DataFrame, by: Sequence[str | Column], block: int = 1 << 16) -> DataFrame:
    """Adds k, the running number (from 1) of a row in time order among rows equal in `by`.

    Two levels: numbers within blocks of t, plus the counts of earlier blocks, so that one long series is no single task.
    """
    cols = [c if isinstance(c, Column) else F.col(c) for c in by]
    named = tr.withColumns({f"_by{i}": c for i, c in enumerate(cols)}).withColumn("_block", F.floor(F.col("t") / block))
    names = [f"_by{i}" for i in range(len(cols))]
    inside = named.withColumn("_k", F.row_number().over(Window.partitionBy(*names, "_block").orderBy("t")))
    counts = named.groupBy(*names, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*names, "_block", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(before, [*names, "_block"]).withColumn("k", F.col("_k") + F.col("_before")).drop(*names, "_block", "_k", "_before")


def paths(
    df: DataFrame, part: Partition | None, lags: Sequence[int], alpha: float = 0.0, keys: Sequence[str] = (), rhs: bool = False, x: str = "x",
    fuzzy: Column | None = None,
) -> DataFrame:
    """keys, t (target), path (array of sets, oldest first), mu_min, mu_prod, newest; with rhs also rhs_ix and rhs_mu.

    fuzzy, an array of (set_ix, mu), stands in for the fuzzification of x where sets depend on more than x.
    The target t is forecast from x at t - o for each lag o.  Without rhs the step after the last row is a target too.
    Each row explodes to at most 2 ** order paths on a grid of triangles; nothing is shuffled after the lags.
    """
    if fuzzy is None:
        src = with_fired(df.select(*keys, "t", F.col(x).alias("_x")), part, "_x", "f", alpha).select(*keys, "t", "f")
    else:
        src = df.select(*keys, "t", fuzzy.alias("f"))
    if not rhs:  # one more target after the end, to be forecast; grouping by key combines on the map side
        end = src.groupBy(*keys).agg((F.max("t") + 1).alias("t")) if keys else src.agg((F.max("t") + 1).alias("t"))
        src = src.unionByName(end.withColumn("f", F.lit(None).cast(src.schema["f"].dataType)))
    src = with_lags(src, ["f"], list(lags), keys)
    for o in lags:
        src = src.where(F.col(f"f_{o}").isNotNull())
    order = sorted(lags, reverse=True)
    if rhs:
        src = src.where(F.col("f").isNotNull())
    for o in order:
        src = src.withColumn(f"s_{o}", F.explode(f"f_{o}"))
    out = [
        *keys, "t",
        F.array(*(F.col(f"s_{o}.set_ix") for o in order)).alias("path"),
        (F.least(*(F.col(f"s_{o}.mu") for o in order)) if len(order) > 1 else F.col(f"s_{order[0]}.mu")).alias("mu_min"),
        _product([F.col(f"s_{o}.mu") for o in order]).alias("mu_prod"),
        F.col(f"s_{order[-1]}.set_ix").alias("newest"),
    ]
    if rhs:
        return src.withColumn("s", F.explode("f")).select(*out, F.col("s.set_ix").alias("rhs_ix"), F.col("s.mu").alias("rhs_mu"))
    return src.select(*out)


def _product(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Rule counts of several batches as one table: sums by rule, so batches may come in any order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    keys = [c for c in out.columns if c not in ("n", "mass")]
    return out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in out.columns if c in ("n", "mass")))
