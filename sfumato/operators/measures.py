"""Accuracy measures and statistical tests as aggregates: one pass over forecasts joined to actuals.

Pairs with a NULL on either side don't count; measures of no pair are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.series import with_lags


def actuals(df: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecasts (target_t, ...) joined to x at their target time."""
    return forecasts.join(df.select(*keys, F.col("t").alias("target_t"), F.col("x").alias("y")), [*keys, "target_t"])


def _agg(df: DataFrame, keys: Sequence[str], cols) -> DataFrame:
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def point(df: DataFrame, keys: Sequence[str] = (), y: str = "y", f: str = "yhat") -> DataFrame:
    """rmse, nrmse, mae, mape, smape1 to 3, theil_inequality by key (for instance by horizon)."""
    a, b = F.col(y), F.col(f)
    e = a - b
    rmse = F.sqrt(F.avg(e * e))
    return _agg(df.where(a.isNotNull() & b.isNotNull()), keys, [
        rmse.alias("rmse"), F.try_divide(rmse, F.max(a) - F.min(a)).alias("nrmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(F.try_divide(e, a))) * 100).alias("mape"),
        F.avg(F.try_divide(F.abs(e), (F.abs(a) + F.abs(b)) / 2)).alias("smape1"),
        (F.avg(F.try_divide(F.abs(e), F.abs(a) + F.abs(b))) * 100).alias("smape2"),
        F.try_divide(F.sum(F.abs(e)), F.sum(a + b)).alias("smape3"),
        F.try_divide(F.sqrt(F.sum(e * e)), F.sqrt(F.sum(a * a)) + F.sqrt(F.sum(b * b))).alias("theil_inequality"),
    ])


def theil_u(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """U against the naive forecast, from (target_t, y, yhat): the last point has no successor and drops out."""
    o = with_lags(df.select(*keys, F.col("target_t").alias("t"), "y", "yhat"), ["y"], [-1], keys).where(F.col("y_-1").isNotNull())
    return _agg(o, keys, [F.sqrt(F.try_divide(F.sum(F.pow(F.col("yhat") - F.col("y"), 2)), F.sum(F.pow(F.col("y_-1") - F.col("y"), 2)))).alias("u")])


def interval(df: DataFrame, keys: Sequence[str] = (), taus: Sequence[float] = (0.05, 0.25, 0.75, 0.95), winkler: Sequence[float] = (0.05, 0.25)) -> DataFrame:
    """sharpness, resolution, coverage, pinball and winkler scores from (y, lower, upper)."""
    y, lo, up = F.col("y"), F.col("lower"), F.col("upper")
    width = up - lo
    d = df.where(y.isNotNull() & lo.isNotNull() & up.isNotNull())
    mean = _agg(d, keys, [F.avg(width).alias("sharpness")])
    d = d.join(F.broadcast(mean), list(keys)) if keys else d.withColumn("_one", F.lit(1)).join(F.broadcast(mean.withColumn("_one", F.lit(1))), "_one")

    def pin(tau: float):
        f = lo if tau <= 0.5 else up
        return F.when(y >= f, tau * (y - f)).otherwise((1 - tau) * (f - y))

    def wink(tau: float):
        return width + F.when(y < lo, 2 * (lo - y) / tau).when(y > up, 2 * (y - up) / tau).otherwise(0.0)

    return _agg(d, keys, [
        F.first("sharpness").alias("sharpness"), F.avg(F.abs(width - F.col("sharpness"))).alias("resolution"),
        F.avg(F.when((y >= lo) & (y <= up), 1.0).otherwise(0.0)).alias("coverage"),
        *(F.avg(pin(t)).alias(f"pinball{round(t * 100):02d}") for t in taus), *(F.avg(wink(t)).alias(f"winkler{round(t * 100):02d}") for t in winkler),
    ])


def interval_midpoint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rmse_interval and mape_interval of the interval's middle; the latter is relative to the forecast."""
    mid = (F.col("lower") + F.col("upper")) / 2
    e = F.col("y") - mid
    d = df.where(F.col("y").isNotNull() & mid.isNotNull())
    return _agg(d, keys, [F.sqrt(F.avg(e * e)).alias("rmse_interval"), (F.avg(F.abs(F.try_divide(e, mid))) * 100).alias("mape_interval")])


def distribution(actual: DataFrame, dist: DataFrame, n_bins: int, lo: float, hi: float) -> DataFrame:
    """crps, brier and log_score from actual (target_t, y) and dist (target_t, bin_ix, bin, density).

    Bins without a row have density 0: between two rows the cdf is level, so each row stands for the bins up to the next.
    """
    step = (hi - lo) / (n_bins - 1)
    tb = F.least(F.greatest(F.ceil((F.col("y") - lo) / step), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    j = dist.join(actual.select("target_t", "y", tb.alias("tb")), "target_t")
    w = Window.partitionBy("target_t").orderBy("bin_ix")
    j = j.withColumns({"cdf": F.sum("density").over(w), "nxt": F.coalesce(F.lead("bin_ix").over(w), F.lit(n_bins))})
    at = F.col("bin_ix")
    below = F.greatest(F.least(F.col("nxt"), F.col("tb")) - at, F.lit(0))
    above = F.col("nxt") - F.greatest(at, F.col("tb"))
    above = F.greatest(above, F.lit(0))
    part = below * F.pow("cdf", 2) + above * F.pow(F.col("cdf") - 1, 2)
    # Bins before the first row have cdf 0: those at or above the target count one each.
    head = F.when(at == F.col("first"), F.greatest(at - F.col("tb"), F.lit(0))).otherwise(0)
    j = j.withColumn("first", F.min("bin_ix").over(Window.partitionBy("target_t")))
    hit = F.sum(F.when(at == F.col("tb"), F.col("density")).otherwise(0.0))
    each = j.groupBy("target_t").agg(
        F.sum(part + head).alias("crps"),
        (F.sum(F.when(at == F.col("tb"), 0.0).otherwise(F.pow("density", 2))) + F.pow(hit - 1, 2)).alias("brier"),
        F.when(hit > 0, -F.ln(hit)).alias("log_score"))
    return each.agg(F.avg("crps").alias("crps"), F.avg("brier").alias("brier"), F.avg("log_score").alias("log_score"))


def acf(df: DataFrame, lags: Sequence[int], x: str = "x") -> DataFrame:
    """lag, r: autocorrelation sum((x_t - m)(x_(t+k) - m)) / ((n - k) var), all lags in one blocked pass."""
    o = with_lags(df.select("t", F.col(x).alias("x")), ["x"], [-k for k in lags])
    fit = df.agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.count(x).alias("n")).head()
    m, v, n = fit["m"] or 0.0, fit["v"] or 0.0, fit["n"]
    sums = o.agg(*(F.sum((F.col("x") - m) * (F.col(f"x_{-k}") - m)).alias(f"s{k}") for k in lags))
    out = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), F.lit((n - k) * v)).alias("r")) for k in lags))
    return sums.select(F.explode(out).alias("o")).select("o.lag", "o.r")


def portmanteau(r: Sequence[float], n: int, as_coded: bool = False) -> dict[str, float]:
    """Box-Pierce and Ljung-Box statistics of autocorrelations r of n values; as_coded has n(n - 2) in place of n(n + 2)."""
    ks = range(1, len(r) + 1)
    return {
        "box_pierce": n * sum(x * x for x in r),
        "ljung_box": n * (n - 2 if as_coded else n + 2) * sum(x * x / (n - k) for k, x in zip(ks, r, strict=True)),
    }


def chi2_sf(q: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > q), by the incomplete gamma series or its continued fraction."""
    a, x = k / 2, q / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        i = a
        while abs(term) > abs(total) * 1e-15:
            i += 1
            term *= x / i
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def residuals(df: DataFrame, lags: int = 10, alpha: float = 0.05) -> dict[str, float | str]:
    """Mean and deviation of y - yhat and its Ljung-Box test, from (target_t, y, yhat)."""
    e = df.select(F.col("target_t").alias("t"), (F.col("y") - F.col("yhat")).alias("x")).where(F.col("x").isNotNull())
    s = e.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n")).head()
    r = [x["r"] or 0.0 for x in acf(e, range(1, lags + 1)).orderBy("lag").collect()]
    q = portmanteau(r, s["n"])["ljung_box"]
    p = chi2_sf(q, lags)
    return {"mean": s["m"], "std": s["s"], "q": q, "p": p, "h0": "rejected" if p < alpha else "accepted"}


def friedman_aligned(df: DataFrame, block: str = "dataset", item: str = "model", value: str = "value") -> DataFrame:
    """item, rank_sum, mean_rank: aligned ranks over all blocks, equal values share their mean rank.

    Differences are equal if they agree in six decimals, so that ranks don't depend on the order in which a mean was summed.
    Values are counted before they are ranked, so only the distinct differences are in the ranking window.
    """
    diff = df.withColumn("_d", F.round(F.col(value) - F.avg(value).over(Window.partitionBy(block)), 6))
    counts = diff.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_d"))
    ranks = counts.select("_d", (run - (F.col("_n") - 1) / 2).alias("_r"))
    return diff.join(ranks, "_d").groupBy(item).agg(F.sum("_r").alias("rank_sum"), F.avg("_r").alias("mean_rank"))


def friedman(df: DataFrame, block: str = "dataset", item: str = "model", value: str = "value") -> dict[str, float]:
    """Friedman's statistic over the blocks that hold every item, and its p-value; ranks are means for equal values."""
    items = df.select(item).distinct().count()
    w = Window.partitionBy(block)
    r = df.withColumns({
        "_r": F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(block, value)) - 1) / 2.0,
        "_k": F.count(F.lit(1)).over(w)}).where(F.col("_k") == items)
    sums = r.groupBy(item).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, k = (sums[0]["n"] if sums else 0), items
    if not n or k < 2:
        return {"blocks": 0, "statistic": 0.0, "p": 1.0}
    q = 12 / (n * k * (k + 1)) * sum(x["s"] ** 2 for x in sums) - 3 * n * (k + 1)
    return {"blocks": n, "statistic": q, "p": chi2_sf(q, k - 1)}


def post_hoc(p_values: dict[str, float], method: str = "holm") -> dict[str, float]:
    """Adjusted p-values of comparisons with a control: 'bonferroni', 'holm' or 'finner'."""
    k = len(p_values)
    out, top = {}, 0.0
    for i, (name, p) in enumerate(sorted(p_values.items(), key=lambda x: x[1]), 1):
        adj = {"bonferroni": p * k, "holm": p * (k - i + 1), "finner": 1 - (1 - p) ** (k / i)}[method]
        top = max(top, min(1.0, adj)) if method != "bonferroni" else min(1.0, adj)
        out[name] = top
    return out
