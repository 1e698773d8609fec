"""Self-organising maps by batch updates: each epoch adds up neighbourhood sums over all rows and moves the grid once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Som:
    """weights[row, column, variable] over variables scaled by mean and deviation."""

    cols: tuple[str, ...]
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    history: list[float] = field(default_factory=list)

    def _winners(self, x: np.ndarray) -> np.ndarray:
        flat = self.weights.reshape(-1, len(self.cols))
        return ((x[:, None, :] - flat[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep, som_row, som_col of each row; rows with a NULL or NaN variable have none."""
        rows, columns = self.weights.shape[:2]
        me = self
        src = df.select(*keep, *(F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(self.cols)))
        schema = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep), "som_row int", "som_col int"])

        def run(batches):
            for pdf in batches:
                x = (pdf[[f"_s{i}" for i in range(len(me.cols))]].to_numpy(float) - me.mean) / me.std
                ok = np.isfinite(x).all(axis=1)
                win = np.zeros(len(x), int)
                if ok.any():
                    win[ok] = me._winners(x[ok])
                out = pdf[list(keep)].copy()
                out["som_row"] = pd.Series(np.where(ok, win // columns, -1)).where(ok).astype("Int32").to_numpy()
                out["som_col"] = pd.Series(np.where(ok, win % columns, -1)).where(ok).astype("Int32").to_numpy()
                yield out

        del rows
        return src.mapInPandas(run, schema)


def train(df: DataFrame, cols: Sequence[str], grid: tuple[int, int] = (6, 6), epochs: int = 10, seed: int = 7) -> Som:
    """A pass an epoch; tasks send sums of the grid's size to the driver."""
    ok = df.select(*(F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(cols))).na.drop()
    fit = ok.agg(*(f(F.col(f"_s{i}")) for i in range(len(cols)) for f in (F.avg, F.stddev_pop))).head()
    mean = np.array([fit[2 * i] or 0.0 for i in range(len(cols))])
    std = np.array([fit[2 * i + 1] or 1.0 for i in range(len(cols))])
    rows, columns = grid
    rng = np.random.default_rng(seed)
    m = Som(tuple(cols), rng.normal(0, 0.5, (rows, columns, len(cols))), mean, std)
    where = np.stack(np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij"), axis=2).reshape(-1, 2)
    far = ((where[:, None, :] - where[None, :, :]) ** 2).sum(axis=2)
    for epoch in range(epochs):
        radius = max(0.5, max(grid) / 2 * (1 - epoch / epochs))
        near = np.exp(-far / (2 * radius**2))
        now = Som(m.cols, m.weights.copy(), mean, std)

        def sums(batches, now=now):
            n = len(where)
            total, count, error = np.zeros((n, len(cols))), np.zeros(n), 0.0
            for pdf in batches:
                x = (pdf.to_numpy(float) - mean) / std
                x = x[np.isfinite(x).all(axis=1)]
                if not len(x):
                    continue
                win = now._winners(x)
                np.add.at(total, win, x)
                np.add.at(count, win, 1)
                error += float(((x - now.weights.reshape(n, -1)[win]) ** 2).sum())
            flat = np.concatenate([total.ravel(), count, [error]])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        got = ok.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not got:
            return m
        v = np.array([r["v"] for r in got])
        n = len(where)
        total, count = v[: n * len(cols)].reshape(n, len(cols)), v[n * len(cols) : -1]
        m.history.append(float(v[-1] / max(1.0, count.sum())))
        weight = near @ count
        flat = np.where(weight[:, None] > 1e-12, near @ total / np.maximum(weight, 1e-12)[:, None], m.weights.reshape(n, -1))
        m.weights = flat.reshape(m.weights.shape)
    return m
