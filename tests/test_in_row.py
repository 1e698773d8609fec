"""Forecasts within the row against the same models by joins, which large rule tables use."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sfumato.operators import partition as P
from sfumato.plans import first_order as fo
from sfumato.plans import high_order as ho
from sfumato.plans import in_row
from sfumato.plans import multivariate as mv
from sfumato.plans import nonstationary as ns
from sfumato.operators.rules import transitions


@pytest.fixture(scope="module")
def s(spark):
    rng = random.Random(3)
    rows = [(t, None if t % 97 == 5 else round(50 + 30 * math.sin(t / 9) + rng.gauss(0, 9), 2), float(t % 24), "abc"[t % 3]) for t in range(600)]
    return spark.createDataFrame(rows, "t long, x double, h double, label string").cache()


def _both(monkeypatch, run, key):
    got = []
    for rules, learn in ((20_000, True), (0, False)):
        monkeypatch.setattr(in_row, "RULES", rules)
        monkeypatch.setattr(in_row, "learns", (lambda parts: all(p.grid is not None for p in parts)) if learn else (lambda parts: False))
        df = run()
        cols = sorted(df.columns)
        got.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=str))
    assert got[0] and len(got[0]) == len(got[1])
    for a, b in zip(*got, strict=True):
        assert a == pytest.approx(b, abs=1e-8), key


@pytest.mark.parametrize("lags,weighted,mode,alpha", [((1, 2), True, "weighted", 0.0), ((1, 3), False, "mean", 0.3)])
def test_high_order(s, monkeypatch, lags, weighted, mode, alpha):
    part = P.grid(s, "x", 5)
    _both(monkeypatch, lambda: ho.forecast(s, part, ho.rules(s, part, lags, weighted, alpha), lags, mode, alpha), lags)


@pytest.mark.parametrize("lags", [(1, 2)])
def test_probabilistic(s, monkeypatch, lags):
    part = P.grid(s, "x", 5)
    _both(monkeypatch, lambda: ho.pwfts_point(s, part, ho.pwfts_groups(ho.pwfts_rules(s, part, lags), part), lags), lags)
    _both(monkeypatch, lambda: ho.pwfts_distribution(s, part, ho.pwfts_rules(s, part, lags, 2), lags, 12), lags)


def test_song(s, monkeypatch):
    part = P.grid(s, "x", 7)
    _both(monkeypatch, lambda: fo.song_predict(s, fo.song_rules(transitions(s, part), part), part), "song")


def test_values_outside_of_the_training_range(s, monkeypatch):
    part = P.grid_over(30.0, 60.0, 4)
    _both(monkeypatch, lambda: ho.forecast(s, part, ho.rules(s, part, (1, 2), True), (1, 2)), "outside")
    _both(monkeypatch, lambda: fo.song_predict(s, fo.song_rules(transitions(s, part), part), part), "outside")


@pytest.mark.parametrize("weighted", [True])
def test_multivariate(s, monkeypatch, weighted):
    x, h = mv.Variable("x", F.col("x"), P.grid(s, "x", 5), 0.2), mv.Variable("h", F.col("h"), P.grid(s, "h", 4))
    _both(monkeypatch, lambda: mv.forecast(s, [h, x], x, mv.rules(s, [h, x], x, weighted)), weighted)
    _both(monkeypatch, lambda: mv.forecast(s, [h], x, mv.rules(s, [h], x, weighted, h=2), h=2), weighted)


@pytest.mark.parametrize("activation", ["softmax", "argmax"])
def test_classifier(s, monkeypatch, activation):
    vs = [mv.Variable("x", F.col("x"), P.grid(s, "x", 5)), mv.Variable("h", F.col("h"), P.grid(s, "h", 4))]
    weights = {"b": 1.25}
    _both(monkeypatch, lambda: mv.classify(s, vs, mv.class_rules(s, vs, "label"), "t", activation, weights, 3), activation)


@pytest.mark.parametrize("lags", [(1, 2)])
def test_moving_sets(s, monkeypatch, lags):
    m = ns.Moving(P.grid(s, "x", 5), ((0.0001, 0.02, 0.0),) * 5, ((0.0, 0.0),) * 5, 50)
    assert m.uniform
    _both(monkeypatch, lambda: ns.forecast(s, m, ns.rules(s, m, lags, True), lags), lags)
