"""Nearest neighbours of one lag by the order of values, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sfumato.plans import baselines
from sfumato.queries import core


def _brute(xs, k):
    v, x, t = np.array(xs[:-1]), np.array(xs[1:], dtype=object), np.arange(1, len(xs))
    out = {}
    for i in range(len(t)):
        if not np.isfinite(v[i]):
            continue
        d = np.abs(v - v[i])
        d[i] = np.inf
        near = [j for j in np.lexsort((t, d))[:k] if np.isfinite(d[j])]
        if near:
            out[int(t[i])] = float(np.mean([x[j] for j in near]))
    return out


def _series(kind):
    rng = np.random.default_rng(5)
    return {
        "smooth": rng.normal(0, 10, 700),
        "few values": rng.integers(0, 40, 900).astype(float),
        "one hot": np.where(rng.random(800) < 0.8, 3.0, np.round(rng.normal(0, 2, 800), 1)),
        "constant": np.full(200, 7.0),
        "short": np.array([1.0, 2.0, 1.5]),
        "equally far after rounding": np.where(rng.random(600) < 0.05, 1e17, rng.permutation(600) / 8.0),
    }[kind].tolist()


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("kind", ["smooth", "few values", "one hot", "constant", "short", "equally far after rounding"])
def test_knn_by_order(spark, monkeypatch, kind, k):
    monkeypatch.setattr(baselines, "RANGE_ROWS", 60)
    monkeypatch.setattr(baselines, "RANGE_STEP", 16)
    xs = _series(kind)
    s = spark.createDataFrame(list(enumerate(xs)), "t bigint, x double")
    got = {r["target_t"]: r["yhat"] for r in baselines.knn(s, k, 1, every=1).collect()}
    want = _brute(xs, k)
    assert got.keys() == want.keys()
    assert all(np.isclose(got[t], y, rtol=1e-9) for t, y in want.items())


def test_no_pass_by_block_of_queries(spark, monkeypatch):
    """The queries don't come to the driver, whose blocks of them each met every row."""
    monkeypatch.setattr(baselines, "QUERY_BLOCK", 10)
    monkeypatch.setattr(baselines, "_knn_by_scan", None)
    s = spark.range(500).select(F.col("id").alias("t"), F.round(50 * F.sin("id"), 1).alias("x"))
    assert baselines.knn(s, 5, 1, every=5).count() == 99


def test_knn_lag_forecasts_every_row(spark, data):
    got = core.queries()["knn_lag"](spark, data)
    assert got.select("target_t").distinct().count() == got.count() == spark.read.parquet(f"{data}/events.parquet").count() - 1
