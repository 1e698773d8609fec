"""Probability distributions as rows (bin_ix, bin, density) and their functionals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sfumato.functions.scalars import KERNELS


def bins(spark: SparkSession, lo: float, hi: float, n: int = 100) -> DataFrame:
    """bin_ix and bin: n equally spaced points."""
    return spark.range(n).select(F.col("id").cast("int").alias("bin_ix"), (F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1))).alias("bin"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, n: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the values in each bin; a value belongs to the first bin at or above it, the last bin takes what exceeds it.

    A hash aggregation with map-side combining; empty bins have no row.
    """
    step = (hi - lo) / (n - 1)
    ix = F.least(F.greatest(F.ceil((F.col(x) - lo) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, ix.alias("bin_ix")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))  # over at most n rows
    return counts.select(*keys, "bin_ix", (F.lit(lo) + F.col("bin_ix") * step).alias("bin"), (F.col("n") / total).alias("density"))


def interval_mass(df: DataFrame, lower: str, upper: str, lo: float, hi: float, n: int = 100) -> DataFrame:
    """Share of intervals that hold each bin: +1 where an interval begins, -1 behind its end, then a running sum over bins."""
    step = (hi - lo) / (n - 1)
    at = lambda c, f: F.least(F.greatest(f((F.col(c) - lo) / step), F.lit(-1)), F.lit(n)).cast("int")
    marks = df.select(F.explode(F.array(
        F.struct(F.greatest(at(lower, F.ceil), F.lit(0)).alias("bin_ix"), F.lit(1).alias("d")),
        F.struct((at(upper, F.floor) + 1).alias("bin_ix"), F.lit(-1).alias("d")))).alias("m")).groupBy("m.bin_ix").agg(F.sum("m.d").alias("d"))
    run = bins(df.sparkSession, lo, hi, n).join(F.broadcast(marks), "bin_ix", "left").withColumn(
        "n", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("bin_ix")))
    return run.select("bin_ix", "bin", "n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("density"))


def kde(df: DataFrame, x: str, h: float, lo: float, hi: float, n: int = 100, kernel: str = "epanechnikov") -> DataFrame:
    """Density at each bin: sum of K((bin - x) / h) / (rows * h).

    Every row meets every bin, so equal values are counted first; each distinct value explodes to the bins and is summed on
    the map side, so the shuffle holds n rows a task.
    """
    step = (hi - lo) / (n - 1)
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    each = counts.withColumn("bin_ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.lit(lo) + F.col("bin_ix") * step
    k = KERNELS[kernel]((at - F.col("_x")) / h)
    total = F.sum("_c").alias("rows")
    sums = each.groupBy("bin_ix").agg(F.sum(k * F.col("_c")).alias("s"), total)
    return sums.select("bin_ix", (F.lit(lo) + F.col("bin_ix") * step).alias("bin"), (F.col("s") / (F.col("rows") * h)).alias("density"))


def from_point(spark: SparkSession, x: float, lo: float, hi: float, n: int = 100) -> DataFrame:
    """Mass one in the first bin at or above x."""
    b = bins(spark, lo, hi, n).where(F.col("bin") >= x).orderBy("bin_ix").limit(1)
    return b.withColumn("density", F.lit(1.0))


def shift(dist: DataFrame, delta) -> DataFrame:
    """The distribution moved by a difference."""
    return dist.withColumn("bin", F.col("bin") + delta)


def cdf(dist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds cdf, the running sum by bin."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("bin_ix")
    return dist.withColumn("cdf", F.sum("density").over(w))


def quantile(dist: DataFrame, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """First bin at which the cdf reaches each q."""
    c = cdf(dist, keys)
    out = [F.min(F.when(F.col("cdf") >= q - 1e-12, F.col("bin"))).alias(f"q{round(q * 100):02d}") for q in qs]
    return c.groupBy(*keys).agg(*out) if keys else c.agg(*out)


def functionals(dist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """expected value and entropy by key."""
    d = F.col("density")
    out = [F.sum(F.col("bin") * d).alias("expected"), F.sum(F.when(d > 0, -d * F.ln(d)).otherwise(0.0)).alias("entropy")]
    return dist.groupBy(*keys).agg(*out) if keys else dist.agg(*out)


def divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """cross_entropy -sum p ln q and kl sum p ln(p / q), over bins where both have density."""
    j = p.select("bin_ix", F.col("density").alias("p")).join(q.select("bin_ix", F.col("density").alias("q")), "bin_ix").where("p > 0 AND q > 0")
    return j.agg(F.sum(-F.col("p") * F.ln("q")).alias("cross_entropy"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def log_likelihood(df: DataFrame, x: str, dist: DataFrame, lo: float, hi: float, n: int = 100) -> DataFrame:
    """empirical: mean ln of the density of each value's bin; pseudo: sum of ln of the positive densities; n: values that count."""
    step = (hi - lo) / (n - 1)
    ix = F.least(F.greatest(F.ceil((F.col(x) - lo) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    counts = df.groupBy(ix.alias("bin_ix")).agg(F.count(F.lit(1)).alias("c"))
    j = counts.join(dist.where("density > 0"), "bin_ix")
    return j.agg((F.sum(F.col("c") * F.ln("density")) / F.sum("c")).alias("empirical"), F.sum(F.ln("density")).alias("pseudo"), F.sum("c").alias("n"))


def mixture(parts: Sequence[tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of distributions over the same bins."""
    out = None
    for w, d in parts:
        d = d.select("bin_ix", "bin", (F.col("density") * w).alias("density"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("bin_ix", "bin").agg(F.sum("density").alias("density"))
