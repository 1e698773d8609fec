"""Series as (t, x) rows: dense time, lags and leads without a single-task window, and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one series that one task handles in a blocked window.
BLOCK = 1 << 16


def clean(x: Column) -> Column:
    """NaN and infinities to NULL, since aggregates skip NULL but not NaN."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x.cast("double"))


def dense(df: DataFrame, order: str, keys: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Adds t = 0, 1, ... in the order of a number or time column, by key.

    Rows are put in buckets by approximate quantiles of the column, numbered within (key, bucket), and moved by the rows
    in the key's earlier buckets, so that neither one long series nor a hot key is one task.
    """
    c = F.col(order)
    if df.schema[order].dataType.typeName() == "timestamp_ntz":
        c = c.cast("timestamp")
    c = c.cast("double")
    cuts = df.agg(F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).head()["q"] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda q: q < c)) if cuts else F.lit(0)
    rows = df.withColumn("_b", bucket)
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b")  # at most `buckets` rows a key
    before = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(before, [*keys, "_b"]).withColumn("t", F.col("_n") - 1 + F.col("_before")).drop("_b", "_n", "_before")


def with_lags(
    df: DataFrame, cols: Sequence[str], lags: Sequence[int], keys: Sequence[str] = (), t: str = "t", block: int = BLOCK, gaps: bool = False,
) -> DataFrame:
    """Adds <col>_<o> = the column's value at t - o (o < 0: a lead), NULL where there is no such t.

    t is whole numbers, unique by key and dense unless gaps is set.  Rows go to blocks of t, the rows near a block's edge also to
    the neighbour that looks at them, so there is one shuffle of little more than the input and no task holds a whole series.
    """
    back, ahead = max([0, *lags]), max([0, *(-o for o in lags)])
    if max(back, ahead) >= block:
        raise ValueError("a lag exceeds the block")
    b = F.floor(F.col(t) / block).cast("long")
    place = F.pmod(F.col(t), F.lit(block))
    # A row serves the next block if it lies in the last `back` places, the block before if in the first `ahead`.
    # Plain branches rather than array functions, so that the projection is compiled.
    homes = F.array(b)
    if back:
        homes = F.when(place >= block - back, F.array(b, b + 1)).otherwise(homes)
    if ahead:
        homes = F.when(place < ahead, F.array(b, b - 1)).otherwise(homes)
    if back and ahead and back + ahead > block:
        raise ValueError("lags and leads together exceed the block")
    rows = df.withColumn("_block", F.explode(homes)) if back or ahead else df.withColumn("_block", b)
    w = Window.partitionBy(*keys, "_block").orderBy(t)
    out = rows
    for o in lags:
        look, step = (F.lag, o) if o > 0 else (F.lead, -o)
        new = {}
        for c in cols:
            if gaps:  # a range frame finds the value by its time
                new[f"{c}_{o}"] = F.max(F.col(c)).over(w.rangeBetween(-o, -o))
            else:
                new[f"{c}_{o}"] = F.when(look(t, step).over(w) == F.col(t) - o, look(c, step).over(w))
        out = out.withColumns(new)
    return out.where(F.col("_block") == b).drop("_block")


def sliding_windows(df: DataFrame, size: int, train: float = 0.8, inc: float = 0.2, n: int | None = None, t: str = "t") -> DataFrame:
    """Rows by window: window_id, part ('train' or 'test'), and the row.

    Window k starts at k * round(size * inc); its first round(size * train) rows are for training.  The windows of a row
    follow from its t by arithmetic, so there's no join.
    """
    step, cut = max(1, round(size * inc)), round(size * train)
    last = F.floor(F.col(t) / step).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col(t) - size) / step).cast("long") + 1)
    rows = df.withColumn("window_id", F.explode(F.sequence(first, F.greatest(first, last)))).where(F.col("window_id") * step <= F.col(t))
    if n is not None:  # windows start within n - size + step
        rows = rows.where(F.col("window_id") * step < n - size + step)
    return rows.withColumn("part", F.when(F.col(t) - F.col("window_id") * step < cut, "train").otherwise("test"))
