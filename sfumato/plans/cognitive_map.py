"""Fuzzy cognitive maps: activations of concepts (the sets) from their lagged degrees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sfumato.functions.scalars import ACTIVATIONS
from sfumato.operators.fuzzify import degrees
from sfumato.operators.partition import Partition
from sfumato.operators.series import with_lags


@dataclass
class CognitiveMap:
    """weights[k][i][j]: from concept i at the k-th oldest lag to concept j; bias[k][j]."""

    part: Partition
    weights: np.ndarray
    bias: np.ndarray
    activation: str = "sigmoid"
    history: list[float] = field(default_factory=list)

    @property
    def order(self) -> int:
        return len(self.weights)

    def _lagged(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        mu = F.transform(degrees(self.part, F.col("x")), lambda s: s["mu"])
        src = df.select("t", *extra, mu.alias("m"))
        lags = list(range(1, self.order))
        src = with_lags(src, ["m"], lags) if lags else src
        for o in lags:
            src = src.where(F.col(f"m_{o}").isNotNull())
        return src.withColumnRenamed("m", "m_0")

    def activate(self, lagged: Sequence[Column]) -> Column:
        """Array of activations; lagged are arrays of degrees, oldest first."""
        total = []
        for j in range(len(self.part)):
            s = F.lit(float(self.bias[:, j].sum()))
            for k, m in enumerate(lagged):
                for i in range(len(self.part)):
                    s = s + F.get(m, F.lit(i)) * float(self.weights[k, i, j])
            total.append(s)
        if self.activation == "softmax":
            e = [F.exp(s) for s in total]
            all_ = sum(e[1:], e[0])
            return F.array(*(x / all_ for x in e))
        return F.array(*(ACTIVATIONS[self.activation](s) for s in total))

    def forecast(self, df: DataFrame) -> DataFrame:
        """target_t, yhat: centroids weighted by activations over max(1, their sum)."""
        src = self._lagged(df).withColumn("a", self.activate([F.col(f"m_{o}") for o in reversed(range(self.order))]))
        a = [F.get("a", F.lit(i)) for i in range(len(self.part))]
        num = sum((x * s.centroid for x, s in zip(a[1:], self.part.sets[1:], strict=True)), a[0] * self.part.sets[0].centroid)
        return src.select((F.col("t") + 1).alias("target_t"), (num / F.greatest(F.lit(1.0), sum(a[1:], a[0]))).alias("yhat"))


def initial(part: Partition, order: int = 1, seed: int = 7) -> CognitiveMap:
    rng = np.random.default_rng(seed)
    n = len(part)
    return CognitiveMap(part, rng.normal(0, 0.1, (order, n, n)), rng.normal(0, 0.1, (order, n)))


def train_gradient(df: DataFrame, part: Partition, order: int = 1, epochs: int = 20, rate: float = 1.0, momentum: float = 0.5, seed: int = 7) -> CognitiveMap:
    """Gradient descent with momentum on the squared error of the next degrees.

    Each epoch is one pass: partitions add up their gradients and only those sums, of the weights' size, come to the driver.
    """
    m = initial(part, order, seed)
    n = len(part)
    src = with_lags(m._lagged(df), ["m_0"], [-1]).withColumnRenamed("m_0_-1", "goal").where("goal IS NOT NULL")
    src = src.select("goal", *(f"m_{o}" for o in reversed(range(order)))).persist()
    speed_w, speed_b = np.zeros_like(m.weights), np.zeros_like(m.bias)
    try:
        for _ in range(epochs):
            w, b = m.weights.copy(), m.bias.copy()

            def gradient(batches, w=w, b=b):
                total, rows, loss = np.zeros(w.size + b.size), 0, 0.0
                for pdf in batches:
                    if not len(pdf):
                        continue
                    x = [np.stack(pdf.iloc[:, 1 + k].to_numpy()) for k in range(order)]
                    y = np.stack(pdf["goal"].to_numpy())
                    z = sum(x[k] @ w[k] + b[k] for k in range(order))
                    a = 1 / (1 + np.exp(-z))
                    d = (a - y) * a * (1 - a)
                    total += np.concatenate([np.stack([x[k].T @ d for k in range(order)]).ravel(), np.stack([d.sum(axis=0)] * order).ravel()])
                    rows, loss = rows + len(pdf), loss + float(((a - y) ** 2).sum())
                yield pd.DataFrame({"i": np.arange(len(total) + 2), "g": np.append(total, [rows, loss])})

            got = src.mapInPandas(gradient, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()
            g = np.array([r["g"] for r in got])
            rows, loss = max(g[-2], 1.0), g[-1]
            m.history.append(float(loss / rows))
            speed_w = momentum * speed_w - rate * g[: w.size].reshape(w.shape) / rows
            speed_b = momentum * speed_b - rate * g[w.size : w.size + b.size].reshape(b.shape) / rows
            m.weights, m.bias = w + speed_w, b + speed_b
    finally:
        src.unpersist()
    return m


def train_genetic(df: DataFrame, part: Partition, order: int = 1, generations: int = 10, population: int = 20, seed: int = 7) -> CognitiveMap:
    """Real-coded genetic search; one pass a generation gives the errors of the whole population."""
    rng = np.random.default_rng(seed)
    base = initial(part, order, seed)
    size = base.weights.size + base.bias.size
    pop = rng.normal(0, 1, (population, size))
    n = len(part)
    centres = np.array([s.centroid for s in part.sets])
    src = with_lags(base._lagged(df, ["x"]), ["x"], [-1]).where(F.col("x_-1").isNotNull())
    src = src.select(F.col("x_-1").alias("goal"), *(f"m_{o}" for o in reversed(range(order)))).persist()

    def errors(genes: np.ndarray) -> np.ndarray:
        def run(batches):
            total, rows = np.zeros(len(genes)), 0
            for pdf in batches:
                x = [np.stack(pdf.iloc[:, 1 + k].to_numpy()) for k in range(order)] if len(pdf) else []
                for i, g in enumerate(genes if len(pdf) else ()):
                    w, b = g[: order * n * n].reshape(order, n, n), g[order * n * n :].reshape(order, n)
                    a = 1 / (1 + np.exp(-sum(x[k] @ w[k] + b[k] for k in range(order))))
                    y = a @ centres / np.maximum(1, a.sum(axis=1))
                    total[i] += float(((y - pdf["goal"].to_numpy()) ** 2).sum())
                rows += len(pdf)
            yield pd.DataFrame({"i": np.arange(len(total) + 1), "e": np.append(total, rows)})

        got = src.mapInPandas(run, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).orderBy("i").collect()
        e = np.array([r["e"] for r in got])
        return np.sqrt(e[:-1] / max(e[-1], 1))

    try:
        score = errors(pop)
        history = [float(score.min())]
        for _ in range(generations):
            pick = lambda: pop[min(rng.integers(0, population, 2), key=lambda i: score[i])]
            child = []
            for _ in range(population - 1):
                mix = rng.random(size)
                c = mix * pick() + (1 - mix) * pick()
                child.append(np.where(rng.random(size) < 0.1, c + rng.normal(0, 0.5, size), c))
            pop = np.vstack([pop[score.argmin()], *child])
            score = errors(pop)
            history.append(float(score.min()))
    finally:
        src.unpersist()
    g = pop[score.argmin()]
    return CognitiveMap(part, g[: order * n * n].reshape(order, n, n), g[order * n * n :].reshape(order, n), "sigmoid", history)
