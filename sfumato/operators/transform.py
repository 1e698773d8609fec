"""Transformations of series and their inverses; windows over one long series run in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.series import with_lags


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def difference(df: DataFrame, lag: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """y = x - x at t - lag; 0 for the first rows."""
    o = with_lags(df, ["x"], [lag], keys)
    return o.withColumn("y", F.coalesce(F.col("x") - F.col(f"x_{lag}"), F.lit(0.0))).drop(f"x_{lag}")


def undifference(df: DataFrame, y: str, lag: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse for one-step results: y + the actual x at t - lag."""
    o = with_lags(df, ["x"], [lag], keys)
    return o.withColumn("x_back", F.coalesce(F.col(y) + F.col(f"x_{lag}"), F.col("x"))).drop(f"x_{lag}")


def running_sum(df: DataFrame, col: str, out: str, t: str = "t", keys: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """Cumulative sum in time order: within blocks of t, plus the totals of earlier blocks."""
    src = df.withColumn("_block", F.floor(F.col(t) / block))
    totals = src.groupBy(*keys, "_block").agg(F.sum(col).alias("_total"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = src.withColumn("_run", F.sum(col).over(Window.partitionBy(*keys, "_block").orderBy(t)))
    return inside.join(before, [*keys, "_block"]).withColumn(out, F.col("_run") + F.col("_before")).drop("_block", "_run", "_before")


def scale(df: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Linear to [lo, hi]; adds the fitted x_min and x_max for the inverse.  A constant series maps to lo."""
    fit = df.agg(F.min("x").alias("a"), F.max("x").alias("b")).head()
    a, b = fit["a"] or 0.0, fit["b"] if fit["b"] is not None else 1.0
    y = F.lit(lo) + (F.col("x") - a) / (b - a) * (hi - lo) if b > a else F.lit(lo)
    return df.withColumns({"y": y, "x_min": F.lit(a), "x_max": F.lit(b)})


def unscale(y: Column, x_min: Column, x_max: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return (y - lo) / (hi - lo) * (x_max - x_min) + x_min


def normalize(df: DataFrame) -> DataFrame:
    """(x - mean) / population deviation; 0 for a constant series."""
    fit = df.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).head()
    m, s = fit["m"] or 0.0, fit["s"] or 0.0
    return df.withColumns({"y": (F.col("x") - m) / s if s else F.lit(0.0), "mean": F.lit(m), "deviation": F.lit(s)})


def boxcox(x: Column, lam: float) -> Column:
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def unboxcox(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam))


def roi(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Relative change; 0 for the first row, NULL after a zero."""
    o = with_lags(df, ["x"], [1], keys)
    return o.withColumn("y", F.when(F.col("x_1").isNull(), 0.0).otherwise(F.try_divide(F.col("x") - F.col("x_1"), F.col("x_1")))).drop("x_1")


def unroi(df: DataFrame, r: str, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse for one-step results: the actual x before, times 1 + r."""
    o = with_lags(df, ["x"], [1], keys)
    return o.withColumn("x_back", F.coalesce(F.col("x_1") * (1 + F.col(r)), F.col("x"))).drop("x_1")


def adaptive_expectation(previous: Column, forecast: Column, h: float = 0.5) -> Column:
    """The forecast, drawn towards the value before."""
    return previous + h * (forecast - previous)


def linear_trend(df: DataFrame) -> DataFrame:
    """x without its least-squares line over t; adds slope and intercept for the inverse."""
    fit = df.agg(F.regr_slope("x", F.col("t").cast("double")).alias("s"), F.regr_intercept("x", F.col("t").cast("double")).alias("i")).head()
    s, i = fit["s"] or 0.0, fit["i"] or 0.0
    return df.withColumns({"y": F.col("x") - (F.col("t") * s + i), "slope": F.lit(s), "intercept": F.lit(i)})


def retrend(y: Column, t: Column, slope: Column, intercept: Column) -> Column:
    return y + t * slope + intercept


def moving_average(df: DataFrame, steps: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the `steps` values before; the first `steps` rows stay raw."""
    o = with_lags(df, ["x"], range(1, steps + 1), keys)
    mean = _sum([F.col(f"x_{k}") for k in range(steps, 0, -1)]) / steps
    return o.withColumn("y", F.coalesce(mean, F.col("x"))).drop(*(f"x_{k}" for k in range(1, steps + 1)))


def exponential_smoothing(df: DataFrame, steps: int = 5, beta: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of beta * (1 - beta) ** k * x at t - k over the last `steps` values, not normalised; missing ones count 0."""
    o = with_lags(df, ["x"], range(1, steps), keys)
    terms = [F.col("x") * beta] + [F.coalesce(F.col(f"x_{k}"), F.lit(0.0)) * (beta * (1 - beta) ** k) for k in range(1, steps)]
    return o.withColumn("y", _sum(terms)).drop(*(f"x_{k}" for k in range(1, steps)))


def pooling(df: DataFrame, how: str = "avg", kernel: int = 5, stride: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Mean or maximum of the `kernel` values before t (t itself excluded; the first row takes itself), every stride-th row."""
    o = with_lags(df, ["x"], range(1, kernel + 1), keys)
    cols = [F.col(f"x_{k}") for k in range(1, kernel + 1)]
    if how == "max":
        y = F.coalesce(F.greatest(*cols), F.col("x"))
    else:
        n = _sum([c.isNotNull().cast("int") for c in cols])
        y = F.when(n > 0, F.try_divide(_sum([F.coalesce(c, F.lit(0.0)) for c in reversed(cols)]), n)).otherwise(F.col("x"))
    return o.withColumn("y", y).where(F.pmod(F.col("t"), F.lit(stride)) == 0).drop(*(f"x_{k}" for k in range(1, kernel + 1)))


def pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """Linear bottleneck: projection to k components of the scaled columns, in place of a trained autoencoder."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(v).transform(v)
    v = PCA(k=k, inputCol="_s", outputCol="_p").fit(v).transform(v).withColumn("_a", vector_to_array("_p"))
    return v.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_v", "_s", "_p", "_a")
