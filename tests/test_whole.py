"""Queries do their whole job: no row, window or session is left out."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sfumato.operators import partition
from sfumato.plans import nonstationary, search
from sfumato.queries import core
from sfumato.streaming import online

QUERIES = core.queries()


@pytest.mark.parametrize("name", ["classify_scale_all", "classify_softmax_all"])
def test_every_line_is_classified(spark, data, name):
    got = QUERIES[name](spark, data)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert got.dropDuplicates(["l_orderkey", "l_linenumber", "q", "d"]).agg(F.sum("n")).head()[0] == rows
    worst = got.groupBy("l_orderkey", "l_linenumber", "q", "d").agg(F.sum("p").alias("p")).agg(F.max(F.abs(F.col("p") - 1))).head()[0]
    assert worst < 1e-5


def test_every_event_is_in_a_session(spark, data):
    got = QUERIES["stream_sessions"](spark, data)
    assert got.agg(F.sum("n")).head()[0] == spark.read.parquet(f"{data}/events.parquet").count()


@pytest.mark.parametrize("files", [None, 1])
def test_open_sessions_of_a_stream(spark, tmp_path, files):
    src = str(tmp_path / "in")
    for minutes in ((0, 10, 25), (100, 110), (115, 300)):
        rows = spark.createDataFrame([("a", m) for m in minutes], "series_id string, m int")
        rows.select("series_id", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(src)
    stream = online.file_stream(spark, src, spark.read.parquet(src), files)
    got = online.collect_whole(online.sessions(stream).select(F.unix_timestamp("w.start").alias("began"), "n"), str(tmp_path / "work"))
    assert sorted((r["began"] // 60, r["n"]) for r in got.collect()) == [(0, 3), (100, 3), (300, 1)]


@pytest.mark.parametrize("n,window,degree", [(25_000, 1, 2), (25_000, 1000, 2), (3000, 1000, 5), (10, 1000, 2)])
def test_drift_is_fitted_on_every_window(spark, n, window, degree):
    s = spark.range(n).select(F.col("id").alias("t"), (F.sin(F.col("id") / 3) + F.greatest(F.lit(0.0), F.col("id") - 10_000.0) / 500).alias("x"))
    m = nonstationary.polynomial(s, partition.grid(s, "x", 4), window, degree)
    x = s.toPandas().sort_values("t")["x"].to_numpy()
    t = np.arange(0, n, window, dtype=float)
    parts = np.split(x, range(window, n, window))
    low, high = (np.polyfit(t, [f(p) for p in parts], min(degree, len(t) - 1)) for f in (np.min, np.max))
    drift = lambda p: np.polyval(p, t) - np.polyval(p, t[0])
    assert np.allclose(np.polyval(m.location[0], t), drift(low), atol=1e-6)
    assert np.allclose(np.polyval(m.location[-1], t), drift(high), atol=1e-6)
    assert np.allclose(np.polyval(m.width[0], t), (drift(high) - drift(low)) / 4, atol=1e-6)


@pytest.mark.parametrize("name,jobs,most", [("grid_search", 1, 4), ("genetic_search", 9, 20), ("random_search", 5, 5)])
def test_searches_run_in_full_over_windows_that_tile(spark, data, monkeypatch, name, jobs, most):
    seen = []

    def evaluate(df, population, size=800, train=0.8, inc=0.2):
        seen.append((len(population), round(size * inc), size - round(size * train)))
        return [replace(p, f1=1.0, f2=1.0, rmse=1.0, size=1.0) for p in population]

    monkeypatch.setattr(search, "evaluate", evaluate)
    assert QUERIES[name](spark, data).count() >= 1
    assert len(seen) >= jobs and max(n for n, _, _ in seen) == most
    assert all(step == test for _, step, test in seen)


def test_conditional_model_starts_from_trained_residuals(spark):
    rng = np.random.default_rng(3)
    xs = {k: (base + 20 * np.sin(np.arange(120) / 5) + rng.normal(0, 4, 120)).tolist() for k, base in (("a", 40), ("b", 70))}
    s = spark.createDataFrame([(k, t, x) for k, v in xs.items() for t, x in enumerate(v)] + [("one", 0, 50.0)], "series_id string, t bigint, x double")
    p = partition.grid(s, "x", 6)
    mids = {0: p.sets[1].centroid, 3: p.sets[2].centroid}
    trained = nonstationary.train_residuals(s, p, mids)
    got = {r["series_id"]: r for r in trained.collect()}
    ys = {}
    for name, f in (("given", nonstationary.conditional_forecast(s, p, mids, trained)), ("variance", nonstationary.variance_forecast(s, p, mids))):
        ys[name] = {k: [r["yhat"] for r in f.where(F.col("series_id") == k).orderBy("target_t").collect()] for k in (*xs, "one")}
    assert set(got) == {"a", "b"} and len(ys["given"]["one"]) == 1
    for k, v in xs.items():
        e = []
        for x, after in zip(v, v[1:]):
            mu = [max(0.0, min((x - (q.p[0] - 0.5)) / (q.p[1] - (q.p[0] - 0.5)), ((q.p[2] + 0.5) - x) / ((q.p[2] + 0.5) - q.p[1]))) for q in p.sets]
            y = sum(m * mids.get(i, q.centroid) for i, (m, q) in enumerate(zip(mu, p.sets))) / sum(mu)
            e.append(after - y)
        assert np.isclose(got[k]["mean"], np.mean(e)) and np.allclose(got[k]["residuals"], e[-5:])
        state = nonstationary.Conditional(p, mids, np.mean(e), 5, e[-5:])
        want = [state.step(x) for x in v]
        assert np.allclose(ys["given"][k], want) and np.allclose(ys["variance"][k], want)
        plain = nonstationary.Conditional(p, mids, 0.0)
        assert not np.allclose(want, [plain.step(x) for x in v])


def test_friedman_over_all_models(spark, tmp_path):
    models = [f"m{i}" for i in range(6)]
    rows = [(10 * b + i, f"d{b}", m, "RMSE", float((i * (b + 2)) % 7)) for b in range(5) for i, m in enumerate(models) if (b, i) != (4, 5)]
    spark.createDataFrame(rows, "id bigint, dataset string, model string, measure string, value double").write.parquet(str(tmp_path / "benchmarks.parquet"))
    ranks = [[sorted((i * (b + 2)) % 7 for i in range(6)).index((i * (b + 2)) % 7) + 1 for i in range(6)] for b in range(4)]
    q = 12 / (4 * 6 * 7) * sum(sum(c) ** 2 for c in zip(*ranks)) - 3 * 4 * 7
    got = QUERIES["friedman_all"](spark, str(tmp_path)).head()
    assert got["blocks"] == 4 and abs(got["statistic"] - q) < 1e-6
