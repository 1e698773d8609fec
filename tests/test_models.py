"""Models and operators against small independent implementations and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sfumato.functions.membership import REGISTRY, degree, membership, register
from sfumato.functions.scalars import KERNELS
from sfumato.operators import distribution, measures, partition, transform
from sfumato.operators.fuzzify import fired, fuzzify, maximum
from sfumato.operators.rules import merge_counts, transitions
from sfumato.operators.series import clean, dense, sliding_windows, with_lags
from sfumato.plans import baselines, cognitive_map, experiment, first_order, high_order, incremental, nonstationary, search
from sfumato.sources import datasets, store, synthetic
from sfumato.streaming import online


def frame(spark, xs):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "t bigint, x double")


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(1)
    xs = 50 + 30 * np.sin(np.arange(400) / 7) + rng.normal(0, 3, 400)
    return frame(spark, xs.tolist()).cache(), xs


@pytest.mark.parametrize("mf,p", [("trimf", (0, 2, 5)), ("trapmf", (0, 1, 3, 4)), ("gaussmf", (2, 1)), ("bellmf", (1, 2, 2)), ("sigmf", (1, 2)), ("singleton", (2,))])
def test_memberships_in_unit_interval_and_same_on_driver(spark, mf, p):
    df = frame(spark, np.arange(-1, 6, 0.25).tolist()).withColumn("mu", membership(mf, F.col("x"), p))
    for r in df.collect():
        assert 0 <= r["mu"] <= 1 and math.isclose(r["mu"], degree(mf, r["x"], p), abs_tol=1e-12)


def test_membership_null_and_registered(spark):
    register("half", lambda x, p: F.lit(0.5))
    try:
        rows = frame(spark, [1, None]).select(membership("half", F.col("x"), (1.0,)).alias("m")).collect()
        assert [r["m"] for r in rows] == [0.5, None]
    finally:
        del REGISTRY["half"]


def test_kernels_integrate_to_one(spark):
    df = spark.range(4001).select(((F.col("id") - 2000) / 100).alias("u"))
    for k, f in KERNELS.items():
        assert abs(df.agg((F.sum(f(F.col("u"))) / 100).alias("s")).head()["s"] - 1) < 0.02, k


def test_grid_sums_to_one_and_tiny_series(spark):
    s = frame(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    p = partition.grid(s, "x", 5)
    sums = fuzzify(s, p).groupBy("t").agg(F.sum("mu").alias("m")).collect()
    assert len(sums) == 10 and all(abs(r["m"] - 1) < 1e-12 for r in sums)
    generic = partition.Partition(p.sets, p.lo, p.hi)  # without the grid's arithmetic
    both = s.select(maximum(p, F.col("x")).alias("a"), maximum(generic, F.col("x")).alias("b"), fired(p, F.col("x")).alias("f"), fired(generic, F.col("x")).alias("g")).collect()
    assert all(r["a"] == r["b"] for r in both)
    assert all([x["set_ix"] for x in r["f"]] == [x["set_ix"] for x in r["g"]] for r in both)


def test_edges_constant_null_empty(spark):
    for xs in ([5, 5, 5], [0, 0], [None, None], [], [-3, None, 4]):
        s = frame(spark, xs)
        p = partition.grid(s, "x", 4)
        m = first_order.fit(s, p)
        got = m.predict(s).collect()
        assert len(got) == len(xs)
    nan = spark.createDataFrame([(0, math.nan), (1, math.inf)], "t int, x double").select(clean(F.col("x")).alias("x"))
    assert [r["x"] for r in nan.collect()] == [None, None]
    far = frame(spark, [-1e9, 1e9]).select(maximum(partition.grid_over(0, 10, 5), F.col("x")).alias("i")).collect()
    assert [r["i"] for r in far] == [0, 4]


def first_order_loop(xs, method, n):
    lo = xs.min() * (1.1 if xs.min() < 0 else 0.9)
    hi = xs.max() * (1.1 if xs.max() > 0 else 0.9)
    p = (hi - lo) / (n - 1)
    c = lo + np.arange(n) * p
    a = (1 - np.abs(xs[:, None] - c[None, :]) / p).argmax(axis=1)
    rhs = {}
    for i, j in zip(a[:-1], a[1:], strict=True):
        rhs.setdefault(i, []).append(j)
    out = []
    for i in a:
        js = rhs.get(i)
        if js is None:
            out.append(c[i])
            continue
        if method == "chen":
            js, w = sorted(set(js)), None
        elif method == "yu":
            w = np.arange(1, len(js) + 1)
        elif method == "sadaei":
            w = 1.1 ** np.arange(len(js))
        elif method == "cheng":
            seen, w = {}, []
            for j in js:
                k = np.sign(j - i)
                seen[k] = seen.get(k, 0) + 1
                w.append(seen[k])
        else:
            w = None
        out.append(np.average(c[js], weights=w))
    return np.array(out)


@pytest.mark.parametrize("method", ["chen", "yu", "cheng", "sadaei", "ismail_efendi"])
def test_first_order_against_loop(spark, wave, method):
    s, xs = wave
    got = first_order.fit(s, partition.grid(s, "x", 12), method).predict(s.repartition(5)).orderBy("target_t").toPandas()["yhat"]
    assert np.allclose(got, first_order_loop(xs, method, 12))


def test_high_order_against_loop(spark, wave):
    s, xs = wave
    p = partition.grid(s, "x", 7)
    fc = high_order.forecast(s, p, high_order.rules(s, p, (1, 2), True), (1, 2)).where("target_t < 400").orderBy("target_t").toPandas()
    err = (fc["yhat"].to_numpy() - xs[2:])
    rmse, _ = experiment.evaluate_window(xs, xs, "whofts", 7, (1, 2))
    assert math.isclose(rmse, float(np.sqrt((err**2).mean())), rel_tol=1e-9)
    assert (fc["lower"] <= fc["upper"]).all()


def test_pwfts_distribution_has_mass_one(spark, wave):
    s, _ = wave
    p = partition.grid(s, "x", 7)
    mass = high_order.pwfts_rules(s, p, (1,))
    d = high_order.pwfts_distribution(s, p, mass, (1,), 50).groupBy("target_t").agg(F.sum("density").alias("m")).collect()
    assert all(abs(r["m"] - 1) < 1e-9 for r in d)
    assert abs(high_order.pwfts_groups(mass, p).agg(F.sum("p")).head()[0] - 1) < 1e-12
    assert high_order.pwfts_rules(s, p, (1,), h=3).count() > 0


def test_rules_of_batches_merge_to_the_whole(spark, wave):
    s, _ = wave
    p = partition.grid(s, "x", 6)
    count = lambda df: df.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n"))
    whole = count(transitions(s, p))
    parts = merge_counts(count(transitions(s.where("t <= 150"), p)), count(transitions(s.where("t >= 150"), p)))
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_blocked_lags(spark):
    s = frame(spark, range(100)).where("t != 40")
    rows = {r["t"]: r for r in with_lags(s, ["x"], [1, 3, -2], block=10, gaps=True).collect()}
    assert rows[41]["x_1"] is None and rows[43]["x_3"] is None and rows[38]["x_-2"] is None
    assert rows[10]["x_1"] == 9 and rows[12]["x_3"] == 9 and rows[9]["x_-2"] == 11 and rows[0]["x_1"] is None and len(rows) == 99
    d = {r["t"]: r for r in with_lags(frame(spark, range(50)), ["x"], [2, -1], block=7).collect()}
    assert d[7]["x_2"] == 5 and d[6]["x_-1"] == 7 and d[49]["x_-1"] is None


def test_dense_time_with_and_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), (F.col("id") % 3).alias("k"))
    assert df.count() == dense(df, "o").where("t = o").count()
    per = dense(df, "o", ["k"]).groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.countDistinct("t").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] + 1 == r["n"] for r in per)
    assert dense(df.limit(0), "o").count() == 0


def test_sliding_windows(spark):
    w = sliding_windows(frame(spark, range(20)), 10, 0.8, 0.5).toPandas()
    first = w[w.window_id == 0].sort_values("t")
    assert first["t"].tolist() == list(range(10)) and first["part"].tolist() == ["train"] * 8 + ["test"] * 2


def test_transform_inverses(spark, wave):
    s, xs = wave
    back = transform.undifference(transform.difference(s, 3), "y", 3).orderBy("t").toPandas()["x_back"]
    assert np.allclose(back, xs)
    z = transform.scale(s).select(transform.unscale(F.col("y"), F.col("x_min"), F.col("x_max")).alias("b"), "x").toPandas()
    assert np.allclose(z["b"], z["x"])
    n = transform.normalize(s).agg(F.avg("y"), F.stddev_pop("y")).head()
    assert abs(n[0]) < 1e-9 and abs(n[1] - 1) < 1e-9
    assert transform.scale(frame(spark, [3, 3])).select("y").distinct().count() == 1
    ma = transform.moving_average(frame(spark, [1, 2, 3, 4]), 2).orderBy("t").toPandas()["y"].tolist()
    assert ma == [1, 2, 1.5, 2.5]
    run = transform.running_sum(frame(spark, range(100)), "x", "y", block=9).orderBy("t").toPandas()["y"]
    assert np.allclose(run, np.cumsum(np.arange(100)))


def test_chi_square_and_portmanteau():
    assert abs(measures.chi2_sf(18.307, 10) - 0.05) < 1e-4
    assert abs(measures.chi2_sf(2.558, 10) - 0.99) < 1e-3
    p = measures.portmanteau([0.5, 0.2], 10)
    assert math.isclose(p["box_pierce"], 10 * 0.29) and math.isclose(p["ljung_box"], 120 * (0.25 / 9 + 0.04 / 8))
    holm = measures.post_hoc({"a": 0.01, "b": 0.04, "c": 0.03})
    assert math.isclose(holm["a"], 0.03) and math.isclose(holm["c"], 0.06) and math.isclose(holm["b"], 0.06)


def test_distribution_functionals(spark):
    h = distribution.histogram(frame(spark, [1, 1, 2, 9, None]), "x", 0, 10, 11)
    assert {r["bin_ix"]: r["density"] for r in h.collect()} == {1: 0.5, 2: 0.25, 9: 0.25}
    assert distribution.functionals(h).head()["expected"] == 0.5 + 0.5 + 2.25
    q = distribution.quantile(h, (0.5, 0.9)).head()
    assert (q["q50"], q["q90"]) == (1, 9)


def test_partitioners(spark):
    two = frame(spark, [1.0 + i % 5 / 10 for i in range(100)] + [9.0 + i % 5 / 10 for i in range(100)])
    c = partition.cmeans(two, "x", 2)
    assert [round(s.centroid, 1) for s in c.sets] == [1.2, 9.2]
    f = partition.fcm(two, "x", 2)
    assert abs(f.sets[0].centroid - 1.2) < 0.2 and abs(f.sets[1].centroid - 9.2) < 0.2
    sub = partition.subclust(two, "x", 0.3)
    assert len(sub) == 2
    assert len(partition.entropy(two, "x", 6)) >= 1
    s = partition.simple([("low", "trimf", (0, 1, 2)), ("high", "trapmf", (2, 3, 4, 5))])
    assert [x.name for x in s.sets] == ["low", "high"] and s.sets[1].centroid == 3.5
    assert [x.name for x in partition.classes({"b": 1, "a": 0}).sets] == ["a", "b"]
    assert len(partition.singletons(frame(spark, [1, 1, 2]), "x")) == 2


def test_incremental_equals_a_loop(spark, wave):
    s, xs = wave
    got = incremental.predict(s, *incremental.train(s, 100, 50, 8), 50, 8).orderBy("target_t").toPandas()
    for k in (2, 4, 7):
        w = xs[k * 50 - 100 : k * 50]
        lo, hi = w.min() * 0.9, w.max() * 1.1
        p = (hi - lo) / 7
        c = lo + np.arange(8) * p
        a = (1 - np.abs(w[:, None] - c) / p).argmax(axis=1)
        rhs = {}
        for i, j in zip(a[:-1], a[1:], strict=True):
            rhs.setdefault(i, set()).add(j)
        for t in range(k * 50, k * 50 + 50):
            i = int((1 - np.abs(xs[t] - c) / p).argmax())
            want = np.mean(c[sorted(rhs[i])]) if i in rhs else c[i]
            assert math.isclose(got[got.target_t == t + 1]["yhat"].iloc[0], want, rel_tol=1e-9)


def test_nonstationary(spark, wave):
    s, _ = wave
    p = partition.grid(s, "x", 6)
    still = nonstationary.Moving(p, ((0.0, 0.0),) * 6, ((0.0, 0.0),) * 6)
    a = nonstationary.forecast(s, still, nonstationary.rules(s, still)).orderBy("target_t").toPandas()
    assert a["yhat"].notna().all() and (a["lower"] <= a["upper"]).all()
    panel = s.withColumn("series_id", F.lit("a")).unionByName(s.withColumn("series_id", F.lit("b")))
    y = nonstationary.conditional_forecast(panel, p, {}, 0.0).toPandas()
    x, z = (y[y.series_id == k].sort_values("target_t")["yhat"].to_numpy() for k in "ab")
    assert len(x) == 400 and np.array_equal(x, z)
    state = nonstationary.Conditional(p, {}, 0.0)
    xs = s.orderBy("t").toPandas()["x"]
    assert np.allclose(x, [state.step(v) for v in xs])


def test_cognitive_map_learns(spark, wave):
    s, _ = wave
    p = partition.grid(s, "x", 5)
    m = cognitive_map.train_gradient(s, p, 1, epochs=8, rate=2.0)
    assert m.history[-1] < m.history[0]
    g = cognitive_map.train_genetic(s, p, 1, generations=3, population=8)
    assert g.history[-1] <= g.history[0]
    assert m.forecast(s).count() == 400


def test_autoregression_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x = [0.0, 0.0]
    for e in rng.normal(0, 1, 5000):
        x.append(1 + 0.6 * x[-1] - 0.3 * x[-2] + e)
    s = frame(spark, x[2:])
    m = baselines.fit_ar(s, 2)
    assert np.allclose(m.beta, [1, 0.6, -0.3], atol=0.06) and abs(m.sigma - 1) < 0.05
    f = m.forecast(s, 0.05).join(s.withColumnRenamed("t", "target_t"), "target_t")
    assert 0.87 < f.select(F.avg(((F.col("x") >= F.col("lower")) & (F.col("x") <= F.col("upper"))).cast("double"))).head()[0] < 0.93
    assert len(m.ahead(x[-2:], 3)) == 3
    b = baselines.quantile_ar(s, 0.9, 2)
    below = s.count()
    q = baselines.quantile_forecast(s, (0.9,), 2).join(s.withColumnRenamed("t", "target_t"), "target_t")
    assert below and len(b) == 3 and abs(q.select(F.avg((F.col("x") <= F.col("q90")).cast("double"))).head()[0] - 0.9) < 0.02


def test_knn_against_brute_force(spark, wave):
    s, xs = wave
    got = baselines.knn(s, 5, 2, every=50).orderBy("target_t").toPandas()
    v = np.stack([xs[1:-1], xs[:-2]], axis=1)
    for t, y in got.itertuples(index=False):
        d = np.sqrt(((v - v[t - 2]) ** 2).sum(axis=1))
        d[t - 2] = np.inf
        near = np.argsort(d, kind="stable")[:5]
        assert math.isclose(y, xs[near + 2].mean(), rel_tol=1e-9)


def test_searches(spark, wave):
    s, _ = wave
    best, stats = search.genetic(s, generations=2, population=4, size=200, inc=0.5)
    assert best.f1 < float("inf") and stats[-1]["best_f1"] <= stats[0]["best_f1"]
    grid = search.grid_search(s, (5, 10), ((1,), (1, 2)), size=200, inc=0.5)
    assert [p.f1 for p in grid] == sorted(p.f1 for p in grid)


def test_store_round_trip(spark, wave, tmp_path):
    s, _ = wave
    p = partition.grid(s, "x", 6)
    m = first_order.fit(s, p)
    store.save_model(str(tmp_path / "m"), p, m.rules, h=1)
    part, rules, config = store.load_model(spark, str(tmp_path / "m"))
    assert part == p and config == {"h": 1}
    assert sorted(first_order.FirstOrder(part, rules).predict(s).collect()) == sorted(m.predict(s).collect())
    path = str(tmp_path / "results")
    r = spark.createDataFrame([(1, "a", "rmse", 2.0), (2, "a", "rmse", 1.0)], "id int, model string, measure string, value double")
    store.append_results(r, path)
    store.append_results(r, path)
    assert store.read_results(spark, path, "value < 2").count() == 2
    assert store.find_best(store.read_results(spark, path), "rmse", ("model",)).head()["value"] == 1.0
    store.to_csv(r, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 2


def test_dataset_reader(spark, tmp_path):
    (tmp_path / "Enrollments.csv").write_text("Year;Enrollments\n1971;13055\n1972;13563\n1973;bad\n")
    got = datasets.series(spark, "enrollments", str(tmp_path)).orderBy("ts").collect()
    assert [r["x"] for r in got] == [13055.0, 13563.0, None] and got[0]["ts"].year == 1971
    with pytest.raises(ValueError):
        datasets.series(spark, "sonda", str(tmp_path))


def test_sources(spark):
    assert [round(r["x"], 4) for r in synthetic.chaos(spark, "logistic", 3).orderBy("t").collect()] == [0.3, 0.84, 0.5376]
    e = synthetic.Emulator(spark).stationary_gaussian(10, 0.0, 50).blip(5, 7).incremental_gaussian(1, 0.0, 10, additive=False)
    rows = {r["t"]: r["x"] for r in e.run().collect()}
    assert len(rows) == 60 and rows[0] == 10 and rows[7] == 15 and rows[59] == 9
    tri = spark.range(9).select(synthetic.triangle(F.col("id"), 3).alias("v")).collect()
    assert [r["v"] for r in tri] == [0, 1, 2, 3, 2, 1, 0, 1, 2]
    assert synthetic.random_walk(spark, 100).where("t = 0").head()["x"] == 0


def test_stream_rules_in_micro_batches(spark, tmp_path, wave):
    s, _ = wave
    p = partition.grid(s, "x", 6)
    src = tmp_path / "in"
    for k in range(4):
        s.where(f"t >= {k * 100} AND t < {k * 100 + 100}").withColumn("series_id", F.lit("a")).coalesce(1).write.mode("append").parquet(str(src))
    stream = online.file_stream(spark, str(src), s.withColumn("series_id", F.lit("a")), files=1)
    got = online.run_rules(stream, p, str(tmp_path / "work"))
    want = transitions(s, p).groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(got.select("lhs", "rhs", "n").collect()) == sorted(want.collect())
