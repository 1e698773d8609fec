"""Windows evaluated by blocks and together, against plain loops over single ones."""

import numpy as np
import pytest

from sfumato.operators.series import sliding_windows
from sfumato.plans import experiment, search


def _loop(train, test, n, lags, alpha):
    lo, hi = (e * (1.1 if up(e) else 0.9) for e, up in ((train.min(), lambda e: e < 0), (train.max(), lambda e: e > 0)))
    p = (hi - lo) / (n - 1) if hi > lo else 1.0
    c = lo + np.arange(n) * p

    def fire(x):
        d = np.maximum(0.0, 1 - np.abs(np.clip(x, lo, hi)[:, None] - c[None, :]) / p)
        return [[int(i) for i in np.flatnonzero((r > 0) & (r >= alpha))] or [int(r.argmax())] for r in d]

    def paths(f, t):
        out = [()]
        for o in sorted(lags, reverse=True):
            out = [k + (i,) for k in out for i in f[t - o]]
        return out

    f, g, rules, top = fire(train), fire(test), {}, max(lags)
    for t in range(top, len(train)):
        for k in paths(f, t):
            rules.setdefault(k, []).extend(c[j] for j in f[t])
    y = [np.mean([np.mean(rules[k]) if k in rules else c[k[-1]] for k in paths(g, t)]) for t in range(top, len(test))]
    return float(np.sqrt(np.mean((test[top:] - np.array(y)) ** 2))), len(rules)


CONFIGS = [(5, (1,), 0.0), (40, (1, 2), 0.2), (100, (1, 4, 6), 0.5), (7, (2, 3), 0.0)]


@pytest.mark.parametrize("places", [0, 1 << 20])
def test_windows_together(places):
    rng = np.random.default_rng(4)
    for x in (rng.normal(0, 5, (6, 200)), rng.integers(0, 9, (6, 200)) * 1.0, np.full((2, 200), 4.0)):
        for n, lags, alpha in CONFIGS:
            got = experiment.evaluate_windows(x[:, :160], x[:, 160:], "whofts", n, lags, alpha, np.zeros(places, np.int32))
            assert np.allclose(list(zip(*got)), [_loop(r[:160], r[160:], n, lags, alpha) for r in x], rtol=1e-9)


@pytest.mark.parametrize("inc", [0.2, 0.5, 1.5])
def test_blocks_hold_the_same_windows(spark, inc):
    rng = np.random.default_rng(6)
    s = spark.createDataFrame([(t, float(x)) for t, x in enumerate(rng.normal(9, 2, 1037)) if t != 333], "t bigint, x double")
    configs = [{"method": "whofts", "partitions": n, "lags": lags, "alpha": a} for n, lags, a in CONFIGS] + [{"method": "chen"}, {"method": "naive"}]
    got = {(r["window_id"], r["config"]): r for r in experiment.windowed_benchmarks(s, 60, configs, 0.8, inc).collect()}
    rows = sliding_windows(s, 60, 0.8, inc).toPandas().sort_values("t")
    assert {k for k, _ in got} == set(rows["window_id"]) and len(got) == len(configs) * rows["window_id"].nunique()
    for k, w in rows.groupby("window_id"):
        train, test = (w.loc[w["part"] == q, "x"].to_numpy() for q in ("train", "test"))
        for j, c in enumerate(configs):
            r = got[k, j]
            want = experiment.evaluate_window(train, test, c["method"], c.get("partitions", 10), c.get("lags", (1,)), c.get("alpha", 0.0))
            assert np.allclose((r["rmse"], r["size"]), want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("run", [search.genetic, search.random_search])
def test_search_cuts_the_windows_once(spark, monkeypatch, run):
    s = spark.range(900).selectExpr("id AS t", "sin(id / 9) * 10 + 20 AS x")
    made, blocks = [], experiment.window_blocks
    monkeypatch.setattr(experiment, "window_blocks", lambda *a: made.append(a) or blocks(*a))
    run(s, size=200, inc=0.2, **({"generations": 2, "population": 4} if run is search.genetic else {"steps": 10}))
    assert len(made) == 1


@pytest.mark.parametrize("alpha", [0.0, 0.5, 0.7])
@pytest.mark.parametrize("lags", [(1,), (1, 3), (1, 2, 4)])
def test_values_on_centres_and_midpoints(lags, alpha):
    rng = np.random.default_rng(8)
    x = rng.integers(20, 201, (20, 200)) / 2
    x[:, :2] = 10, 100  # with 102 sets, their centres are whole numbers from 9 to 110
    x[:4, 180:] *= 3  # beyond the grid
    got = experiment.evaluate_windows(x[:, :160], x[:, 160:], "whofts", 102, lags, alpha, np.zeros(1 << 21, np.int32))
    assert np.allclose(list(zip(*got)), [_loop(r[:160], r[160:], 102, lags, alpha) for r in x], rtol=1e-9)


@pytest.mark.parametrize("name,value", [("DENSE", 0), ("DENSE", 1 << 20), ("EXACT", 0)])
def test_tables_and_places_have_the_same_sums(monkeypatch, name, value):
    monkeypatch.setattr(experiment, name, value)
    x, places = np.random.default_rng(9).normal(3, 5, (20, 200)), np.full(1 << 20, 99, np.int32)
    x[7, 50] = x[8, 190] = np.nan
    sound = np.isfinite(x).all(axis=1)
    for n, lags, alpha in CONFIGS[:2] + [(30, (1, 4, 6), 0.1)]:
        got = experiment.evaluate_windows(x[:, :160], x[:, 160:], "whofts", n, lags, alpha, places)
        rmse, rules = map(np.array, got)
        assert np.allclose(np.stack([rmse, rules], axis=1)[sound], [_loop(r[:160], r[160:], n, lags, alpha) for r in x[sound]], rtol=1e-9)
        assert np.isnan(rmse[~sound]).all()


@pytest.mark.parametrize("kind", ["bigint", "int", "double", "decimal(12, 0)"])
def test_blocks_come_in_few_pieces(spark, kind):
    rows, size, step, n = 30_000, 60, 12, 20
    s = spark.range(-50, rows).selectExpr(f"CAST(IF(id = 700, NULL, id) AS {kind}) AS t", "IF(id = 900, NULL, id / 7) AS x")
    got = {r["block"]: r for r in experiment.window_blocks(s, size).collect()}
    assert sum(len(r["rows"]) for r in got.values()) < rows / 20
    assert set(got) == set(range(-(-rows // (n * step)))) and {r["n"] for r in got.values()} == {n}
    for b, r in got.items():
        t, x = np.frombuffer(b"".join(r["rows"])).reshape(-1, 2).T
        order = np.argsort(t)
        want = np.array([i for i in range(b * n * step, min(rows, (b + 1) * n * step + size - step)) if i != 700])
        assert np.array_equal(t[order] + b * n * step, want)
        assert np.allclose(x[order], np.where(want == 900, np.nan, want / 7), equal_nan=True)
