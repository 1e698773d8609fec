"""Synthetic series: chaotic maps as a Python data source, noise and drift as projections of a range."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _henon(n, a=1.4, b=0.3, x=1.0, y=1.0):
    for _ in range(n + 1):
        yield (x, y, None)
        x, y = a + b * y - x * x, x


def _logistic(n, r=4.0, x=0.3):
    for _ in range(n):
        yield (x, None, None)
        x = r * x * (1 - x)


def _lorenz(n, a=10.0, b=28.0, c=8.0 / 3.0, dt=0.01, x=0.1, y=0.0, z=0.0):
    for _ in range(n + 1):
        yield (x, y, z)
        x, y, z = x + dt * (a * (y - x)), y + dt * (x * (b - z) - y), z + dt * (x * y - c * z)


def _rossler(n, a=0.2, b=0.2, c=5.7, dt=0.01, x=0.001, y=0.001, z=0.001):
    for _ in range(n + 1):
        yield (x, y, z)
        x, y, z = x + dt * -(y + z), y + dt * (x + a * y), z + dt * (b + z * x - z * c)


def _mackey_glass(n, b=0.1, c=0.2, tau=17, skip=100):
    tau = int(tau)
    y = [0.5 + i / tau for i in range(tau + 1)]
    for k in range(n + skip):
        if k >= skip:
            yield (y[0], None, None)
        y.append(y[-1] - b * y[-1] + c * y[-1 - tau] / (1 + y[-1 - tau] ** 10))
        y.pop(0)


MAPS = {"henon": _henon, "logistic": _logistic, "lorenz": _lorenz, "rossler": _rossler, "mackey_glass": _mackey_glass}


class ChaosReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]  # each value needs the one before

    def read(self, partition) -> Iterator[tuple]:
        own = {k: float(v) for k, v in self.options.items() if k not in ("map", "n")}
        for t, row in enumerate(MAPS[self.options.get("map", "logistic")](int(self.options.get("n", 1000)), **own)):
            yield (t, *row)


class ChaosSource(DataSource):
    """format('chaos'), options map, n, and the map's coefficients."""

    @classmethod
    def name(cls) -> str:
        return "chaos"

    def schema(self) -> str:
        return "t bigint, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return ChaosReader(self.options)


def chaos(spark: SparkSession, kind: str, n: int, **coefficients: float) -> DataFrame:
    spark.dataSource.register(ChaosSource)
    return spark.read.format("chaos").options(map=kind, n=n, **coefficients).load()


def _clip(x: Column, vmin: float | None, vmax: float | None) -> Column:
    x = F.greatest(x, F.lit(vmin)) if vmin is not None else x
    return F.least(x, F.lit(vmax)) if vmax is not None else x


def gaussian_drift(spark: SparkSession, mu: float, sigma: float, mu_inc: float, sigma_inc: float, steps: int = 100, num: int = 10, vmin=None, vmax=None, seed: int = 1) -> DataFrame:
    """num draws a step; mean and deviation move by their increments each step."""
    k = F.floor(F.col("id") / num)
    x = F.randn(seed) * (F.lit(sigma) + k * sigma_inc) + F.lit(mu) + k * mu_inc
    return spark.range(steps * num).select(F.col("id").alias("t"), _clip(x, vmin, vmax).alias("x"))


def triangle(k: Column, period: int) -> Column:
    """0, 1, ..., period, period - 1, ..., 0, ...: the first leg ascends."""
    m = F.pmod(k, F.lit(2 * period))
    return F.when(m <= period, m).otherwise(2 * period - m)


def gaussian_periodic(spark: SparkSession, period: int, mu_min: float, sigma_min: float, mu_max: float, sigma_max: float, steps: int = 100, num: int = 10, vmin=None, vmax=None, seed: int = 1) -> DataFrame:
    """Mean and deviation go up and down between their ends in `period` steps; the deviation is at least 0.005."""
    share = triangle(F.floor(F.col("id") / num), period) / period
    sigma = F.greatest(F.lit(0.005), F.lit(sigma_min) + share * (sigma_max - sigma_min))
    x = F.randn(seed) * sigma + F.lit(mu_min) + share * (mu_max - mu_min)
    return spark.range(steps * num).select(F.col("id").alias("t"), _clip(x, vmin, vmax).alias("x"))


def gaussian_sinusoidal(spark: SparkSession, period: float, mu_min: float, sigma_min: float, mu_max: float, sigma_max: float, steps: int = 100, num: int = 10, vmin=None, vmax=None, seed: int = 1) -> DataFrame:
    """Mean and deviation as running sums of range * sin(period * k), in closed form."""
    k = F.floor(F.col("id") / num)
    # sum of sin(p * i) for i = 0..k
    total = F.sin(k * (period / 2)) * F.sin((k + 1) * (period / 2)) / math.sin(period / 2)
    sigma = F.greatest(F.lit(0.005), F.lit(sigma_min) + total * (sigma_max - sigma_min))
    x = F.randn(seed) * sigma + F.lit(mu_min) + total * (mu_max - mu_min)
    return spark.range(steps * num).select(F.col("id").alias("t"), _clip(x, vmin, vmax).alias("x"))


def uniform_drift(spark: SparkSession, low: float, high: float, low_inc: float, high_inc: float, steps: int = 100, num: int = 10, vmin=None, vmax=None, seed: int = 1) -> DataFrame:
    k = F.floor(F.col("id") / num)
    lo, hi = F.lit(low) + k * low_inc, F.lit(high) + k * high_inc
    return spark.range(steps * num).select(F.col("id").alias("t"), _clip(lo + F.rand(seed) * (hi - lo), vmin, vmax).alias("x"))


def white_noise(spark: SparkSession, n: int = 500, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("t"), F.randn(seed).alias("x"))


def random_walk(spark: SparkSession, n: int = 500, kind: str = "gaussian", seed: int = 1) -> DataFrame:
    """Running sum of steps, from 0."""
    from sfumato.operators.transform import running_sum

    step = F.randn(seed) if kind == "gaussian" else F.rand(seed) * 2 - 1
    steps = spark.range(n).select(F.col("id").alias("t"), F.when(F.col("id") == 0, 0.0).otherwise(step).alias("s"))
    return running_sum(steps, "s", "x").select("t", "x")


class Emulator:
    """Components added over each other or one after another; run gives (t, x)."""

    def __init__(self, spark: SparkSession, seed: int = 1):
        self.spark, self.seed, self.parts, self.end = spark, seed, [], 0

    def _add(self, df: DataFrame, length: int, start: int, additive: bool) -> Emulator:
        at = start if additive else self.end
        self.parts.append(df.select((F.col("t") + at).alias("t"), "x"))
        self.end = max(self.end, at + length)
        self.seed += 1
        return self

    def stationary_gaussian(self, mu: float, sigma: float, length: int = 100, start: int = 0, additive: bool = True) -> Emulator:
        df = self.spark.range(length).select(F.col("id").alias("t"), (F.randn(self.seed) * sigma + mu).alias("x"))
        return self._add(df, length, start, additive)

    def incremental_gaussian(self, mu_inc: float, sigma_inc: float, length: int = 100, start: int = 0, additive: bool = True, mu: float = 0.0, sigma: float = 0.0) -> Emulator:
        return self._add(gaussian_drift(self.spark, mu, sigma, mu_inc, sigma_inc, length, 1, seed=self.seed), length, start, additive)

    def periodic_gaussian(self, kind: str, period: float, mu_min: float, sigma_min: float, mu_max: float, sigma_max: float, length: int = 100, start: int = 0, additive: bool = True) -> Emulator:
        make = gaussian_periodic if kind == "linear" else gaussian_sinusoidal
        return self._add(make(self.spark, period, mu_min, sigma_min, mu_max, sigma_max, length, 1, seed=self.seed), length, start, additive)

    def blip(self, intensity: float, at: int) -> Emulator:
        """One value added at a place."""
        df = self.spark.range(1).select(F.col("id").alias("t"), F.lit(float(intensity)).alias("x"))
        return self._add(df, 1, at, True)

    def run(self, length: int | None = None) -> DataFrame:
        base = self.spark.range(length or self.end).select(F.col("id").alias("t"), F.lit(0.0).alias("x"))
        for p in self.parts:
            base = base.unionByName(p)
        return base.groupBy("t").agg(F.sum("x").alias("x")).where(F.col("t") < (length or self.end))
