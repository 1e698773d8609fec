"""Ensembles: forecasts of members in one table, aggregated by target."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sfumato.functions.scalars import KERNELS
from sfumato.operators import partition as P
from sfumato.plans import first_order as fo
from sfumato.plans import high_order as ho


def union(members: dict[str, DataFrame]) -> DataFrame:
    """model, target_t, yhat of all members."""
    out = None
    for name, df in members.items():
        part = df.select(F.lit(name).alias("model"), "target_t", "yhat")
        out = part if out is None else out.unionByName(part)
    return out


def simple_members(df: DataFrame, partitions: Sequence[int], orders: Sequence[int] = (1,), method: str = "chen") -> dict[str, DataFrame]:
    """One member a pair of partitions and order: the first-order method for order 1, high-order means above."""
    out = {}
    for n in partitions:
        part = P.grid(df, "x", n)
        for o in orders:
            lags = tuple(range(1, o + 1))
            fc = fo.fit(df, part, method).predict(df) if o == 1 else ho.forecast(df, part, ho.rules(df, part, lags, False), lags)
            out[f"{method if o == 1 else 'hofts'}-{n}-{o}"] = fc
    return out


def all_method_members(df: DataFrame, part: P.Partition, orders: Sequence[int] = (1, 2), min_order: int = 1) -> dict[str, DataFrame]:
    """Every first-order method, and high-order methods of the orders from min_order on."""
    out = {m: fo.fit(df, part, m).predict(df) for m in fo.RULES} if min_order <= 1 else {}
    for o in orders:
        if o > 1 and o >= min_order:
            lags = tuple(range(1, o + 1))
            out[f"hofts-{o}"] = ho.forecast(df, part, ho.rules(df, part, lags, False), lags)
            out[f"hwang-{o}"] = ho.hwang(df, part, o)
    return out


def point(members: DataFrame, how: str = "mean", alpha: float = 0.5, keys: Sequence[str] = ("target_t",), rank: str | None = None) -> DataFrame:
    """'mean', 'median', 'quantile' (of alpha) or 'exponential' (weights e**-k, k from 0 at the greatest `rank`)."""
    if how == "exponential":
        k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(rank or "model").desc())) - 1
        w = members.withColumn("w", F.exp(-k.cast("double")))
        return w.groupBy(*keys).agg((F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"))
    y = {"mean": F.avg("yhat"), "median": F.percentile("yhat", 0.5), "quantile": F.percentile("yhat", alpha)}[how]
    return members.groupBy(*keys).agg(y.alias("yhat"))


def interval(members: DataFrame, how: str = "extremum", alpha: float = 0.05, keys: Sequence[str] = ("target_t",)) -> DataFrame:
    """'extremum', 'quantile' (alpha and 1 - alpha) or 'normal' (mean -/+ z * population deviation)."""
    if how == "normal":
        z = NormalDist().inv_cdf(1 - alpha)
        lo, up = F.avg("yhat") - z * F.stddev_pop("yhat"), F.avg("yhat") + z * F.stddev_pop("yhat")
    elif how == "quantile":
        lo, up = F.percentile("yhat", alpha), F.percentile("yhat", 1 - alpha)
    else:
        lo, up = F.min("yhat"), F.max("yhat")
    return members.groupBy(*keys).agg(lo.alias("lower"), up.alias("upper"))


def sampler(members: DataFrame, keys: Sequence[str] = ("target_t",), extremes: bool = False) -> DataFrame:
    """One row a percentile 10, 20, ... 90 (and 0, 100) of the members' forecasts."""
    qs = [i / 10 for i in range(0 if extremes else 1, 11 if extremes else 10)]
    p = members.groupBy(*keys).agg(F.percentile("yhat", qs).alias("p"))
    return p.select(*keys, F.posexplode("p").alias("i", "value")).select(*keys, F.round(F.get(F.array(*map(F.lit, qs)), F.col("i")), 1).alias("q"), "value")


def distribution(members: DataFrame, lo: float, hi: float, n: int = 100, trim: float = 0.0, keys: Sequence[str] = ("target_t",)) -> DataFrame:
    """keys, bin_ix, density: histogram of the members' forecasts, optionally without the outer `trim` share on both ends."""
    w = Window.partitionBy(*keys).orderBy("yhat")
    m = members
    if trim:
        m = m.withColumns({"_r": F.row_number().over(w), "_m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        m = m.where((F.col("_r") >= F.ceil(F.col("_m") * trim)) & (F.col("_r") < F.ceil(F.col("_m") * (1 - trim)) + 1))
    step = (hi - lo) / (n - 1)
    ix = F.least(F.greatest(F.ceil((F.col("yhat") - lo) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    c = m.groupBy(*keys, ix.alias("bin_ix")).agg(F.count(F.lit(1)).alias("c"))
    return c.select(*keys, "bin_ix", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).alias("density"))


def kde(members: DataFrame, lo: float, hi: float, n: int = 100, h: float = 10.0, kernel: str = "gaussian", keys: Sequence[str] = ("target_t",)) -> DataFrame:
    """keys, bin_ix, bin, density: kernel density of the members' forecasts of each target; the members are few."""
    step = (hi - lo) / (n - 1)
    each = members.withColumn("bin_ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.lit(lo) + F.col("bin_ix") * step
    g = each.groupBy(*keys, "bin_ix").agg((F.sum(KERNELS[kernel]((at - F.col("yhat")) / h)) / (F.count(F.lit(1)) * h)).alias("density"))
    return g.select(*keys, "bin_ix", (F.lit(lo) + F.col("bin_ix") * step).alias("bin"), "density")


def seasonal(df: DataFrame, part: P.Partition, seasons: Sequence[str]) -> DataFrame:
    """Members of a contextual seasonal model for each season column, with the model's name."""
    from sfumato.plans.seasonal import contextual_forecast, contextual_rules

    return union({s: contextual_forecast(df, part, contextual_rules(df, part, s), s) for s in seasons})
