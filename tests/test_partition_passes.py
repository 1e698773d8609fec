"""Partitioners by passes over all rows, used where values don't fit the driver, against the same ones over the values."""

import math
import random

import numpy as np
import pytest

from sfumato.operators import partition as P


@pytest.fixture(scope="module")
def xs():
    rng = random.Random(2)
    return [round(rng.choice((10, 40, 90)) + rng.gauss(0, 6), 1) for _ in range(900)] + [33.3] * 300


@pytest.fixture(scope="module")
def df(spark, xs):
    return spark.createDataFrame([(x,) for x in [*xs, None, math.nan]], "x double").cache()


def test_value_at(df, xs):
    rows, order = P._finite(df, "x"), sorted(xs)
    for rank in (1, 2, 599, 600, 1199, 1200):
        assert P.value_at(rows, rank, 10) == P.value_at(rows, rank, 10_000) == order[rank - 1]


@pytest.mark.parametrize("build", [P.entropy, P.fcm, P.cmeans])
def test_same_sets(df, build):
    few, all_ = build(df, "x", 6, limit=20), build(df, "x", 6, limit=10_000)
    assert [s.centroid for s in few] == pytest.approx([s.centroid for s in all_], abs=2e-3)


def test_subtractive_clustering(df, xs):
    v = np.unique(xs)
    w = np.array([xs.count(x) for x in v], float)
    u, ra = (v - v.min()) / (v.max() - v.min()), 0.3
    p = (w[None, :] * np.exp(-4 * (u[:, None] - u[None, :]) ** 2 / ra**2)).sum(axis=1)
    centres, first, refused = [], p.max(), []
    while True:
        i = int(p.argmax())
        if p[i] <= 0.15 * first:
            break
        if p[i] <= 0.5 * first and centres and min(abs(u[i] - u[j]) for j in centres) / ra + p[i] / first < 1:
            p[i] = 0
            refused.append(i)
            continue
        centres.append(i)
        p = p - p[i] * np.exp(-4 * (u - u[i]) ** 2 / (1.5 * ra) ** 2)
        p[refused] = 0
    assert [s.centroid for s in P.subclust(df, "x", ra)] == pytest.approx(sorted(v[i] for i in centres))
    assert len(P.subclust(df.limit(0), "x")) == 0
