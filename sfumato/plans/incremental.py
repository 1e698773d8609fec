"""Time-variant models: every `batch` steps a model of the last `window` values, as one plan over all windows.

Each window has its own grid, kept as columns (lo, p), so a million windows are one aggregation by window, no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.series import with_lags


def _ix(x: Column, lo: Column, p: Column, n: int) -> Column:
    """Set of greatest degree on a grid of triangles, ties to the lower index."""
    i = F.floor((x - lo) / p).cast("int")
    first = F.lit(1.0) - F.abs(x - (lo + i * p)) / p
    second = F.lit(1.0) - F.abs(x - (lo + (i + 1) * p)) / p
    best = F.when((i < 0) | ((second > first) & (i + 1 < n)), i + 1).otherwise(i)
    return F.least(F.greatest(best, F.lit(0)), F.lit(n - 1))


def windows(df: DataFrame, window: int, batch: int) -> DataFrame:
    """Rows by window_id: window k is trained on t in [k * batch - window, k * batch); windows that begin before 0 aren't made."""
    first = F.floor(F.col("t") / batch).cast("long") + 1
    last = F.floor((F.col("t") + window) / batch).cast("long")
    return df.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array()))).where(F.col("window_id") * batch >= window)


def train(df: DataFrame, window: int, batch: int, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(grids: window_id, lo, p; rules: window_id, lhs, mid) of the mean-of-distinct model."""
    pairs = with_lags(df.select("t", "x"), ["x"], [-1])
    w = windows(pairs, window, batch)
    a, b = F.min("x"), F.max("x")
    lo = F.when(a < 0, a * 1.1).otherwise(a * 0.9)
    hi = F.when(b > 0, b * 1.1).otherwise(b * 0.9)
    grids = w.groupBy("window_id").agg(lo.alias("lo"), hi.alias("hi")).select("window_id", "lo", (F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / (n - 1)).alias("p"))
    inside = w.where((F.col("t") + 1 < F.col("window_id") * batch) & F.col("x_-1").isNotNull()).join(grids, "window_id")
    tr = inside.select("window_id", "lo", "p", _ix(F.col("x"), F.col("lo"), F.col("p"), n).alias("lhs"), _ix(F.col("x_-1"), F.col("lo"), F.col("p"), n).alias("rhs")).distinct()
    rules = tr.groupBy("window_id", "lhs").agg(F.avg(F.col("lo") + F.col("rhs") * F.col("p")).alias("mid"))
    return grids, rules


def predict(df: DataFrame, grids: DataFrame, rules: DataFrame, batch: int, n: int = 10, models: int = 1) -> DataFrame:
    """target_t, model (0 the newest), yhat: each row by the last `models` windows that had ended by then."""
    now = F.floor(F.col("t") / batch).cast("long")
    rows = df.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model")).withColumn("window_id", now - F.col("model"))
    f = rows.join(grids, "window_id").withColumn("lhs", _ix(F.col("x"), F.col("lo"), F.col("p"), n))
    j = f.join(rules, ["window_id", "lhs"], "left")
    return j.select((F.col("t") + 1).alias("target_t"), "model", F.coalesce("mid", F.col("lo") + F.col("lhs") * F.col("p")).alias("yhat"))


def incremental_ensemble(df: DataFrame, window: int, batch: int, models: int = 3, n: int = 10) -> DataFrame:
    """target_t, yhat: exponential mix of the last models, the newest with the greatest weight."""
    grids, rules = train(df, window, batch, n)
    m = predict(df, grids, rules, batch, n, models).withColumn("w", F.exp(-F.col("model").cast("double")))
    return m.groupBy("target_t").agg((F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"))


def last_models(rules: DataFrame, keep: int) -> DataFrame:
    """Rules of the newest `keep` windows."""
    ids = rules.select("window_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("window_id").desc()))).where(F.col("_r") <= keep)
    return rules.join(F.broadcast(ids.drop("_r")), "window_id", "left_semi")
