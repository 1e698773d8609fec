"""Queries of sources, experiments, reports, searches and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.operators import partition as P
from sfumato.operators.entries import entries, measure_key, valid
from sfumato.operators.series import dense, sliding_windows
from sfumato.plans import experiment, search
from sfumato.queries.base import S, rounded, series, steady, steady_sql
from sfumato.sources import store, synthetic
from sfumato.streaming import online
from sfumato.session import shared_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


@query("WITH RECURSIVE m(t, x) AS (SELECT 0::BIGINT, 0.3::DOUBLE UNION ALL SELECT t + 1, 4.0::DOUBLE * x * (1 - x) FROM m WHERE t < 99) SELECT t, round(x, 6) AS x FROM m")
def logistic_map(spark, d):
    return rounded(synthetic.chaos(spark, "logistic", 100).select("t", "x"), "x")


@query("WITH RECURSIVE m(t, x, y) AS (SELECT 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT t + 1, 1.4::DOUBLE + 0.3::DOUBLE * y - x * x, x FROM m WHERE t < 60) SELECT t, round(x, 6) AS x, round(y, 6) AS y FROM m")
def henon_map(spark, d):
    return rounded(synthetic.chaos(spark, "henon", 60).select("t", "x", "y"), "x", "y")


@query("WITH RECURSIVE m(t, x, y, z) AS (SELECT 0::BIGINT, 0.1::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT t + 1, x + 0.01::DOUBLE * (10.0::DOUBLE * (y - x)), y + 0.01::DOUBLE * (x * (28.0::DOUBLE - z) - y), z + 0.01::DOUBLE * (x * y - 8.0::DOUBLE / 3.0::DOUBLE * z) FROM m WHERE t < 500) SELECT t, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM m")
def lorenz(spark, d):
    return synthetic.chaos(spark, "lorenz", 500).select("t", *(F.round(c, 5).alias(c) for c in "xyz"))


@query("WITH RECURSIVE m(t, x, y, z) AS (SELECT 0::BIGINT, 0.001::DOUBLE, 0.001::DOUBLE, 0.001::DOUBLE UNION ALL SELECT t + 1, x + 0.01::DOUBLE * -(y + z), y + 0.01::DOUBLE * (x + 0.2::DOUBLE * y), z + 0.01::DOUBLE * (0.2::DOUBLE + z * x - z * 5.7::DOUBLE) FROM m WHERE t < 500) SELECT t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM m")
def rossler(spark, d):
    return rounded(synthetic.chaos(spark, "rossler", 500).select("t", "x", "y", "z"), "x", "y", "z")


@query()
def mackey_glass(spark, d):
    return rounded(synthetic.chaos(spark, "mackey_glass", 1000).select("t", "x"), "x")


@query()
def synthetic_signals(spark, d):
    parts = {
        "gaussian_drift": synthetic.gaussian_drift(spark, 10, 1, 0.1, 0.01), "gaussian_periodic": synthetic.gaussian_periodic(spark, 10, 1, 0.1, 5, 1),
        "gaussian_sinusoidal": synthetic.gaussian_sinusoidal(spark, 0.5, 1, 0.1, 5, 1), "uniform_drift": synthetic.uniform_drift(spark, 0, 1, 0.1, 0.1),
        "white_noise": synthetic.white_noise(spark), "random_walk": synthetic.random_walk(spark),
        "emulator": synthetic.Emulator(spark).stationary_gaussian(10, 1, 100).periodic_gaussian("linear", 20, 0, 0.1, 5, 0.2, 100).incremental_gaussian(0.1, 0.0, 50, additive=False).blip(100, 30).run(),
    }
    out = None
    for k, v in parts.items():
        v = v.select(F.lit(k).alias("kind"), F.col("t").cast("bigint").alias("t"), "x")
        out = v if out is None else out.unionByName(v)
    return out


@query(f"WITH {S}, w AS (SELECT s.*, CAST(k AS BIGINT) AS window_id FROM s, range(0, (SELECT CAST(max(t) // 200 + 1 AS BIGINT) FROM s)) r(k) WHERE t >= k * 200 AND t < k * 200 + 1000) SELECT window_id, CASE WHEN t - window_id * 200 < 800 THEN 'train' ELSE 'test' END AS part, count(*) AS n, {steady_sql("avg(x)")} AS mean FROM w GROUP BY 1, 2")
def sliding_window_split(spark, d):
    w = sliding_windows(series(spark, d), 1000)
    return steady(w.groupBy("window_id", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS t FROM events")
def dense_time(spark, d):
    return dense(table(spark, d, "events").select("event_id", "ts"), "ts").select("event_id", "t")


@query(f"""WITH {S}, w AS (SELECT s.*, CAST(k AS BIGINT) AS window_id FROM s, range(0, (SELECT CAST(max(t) // 200 + 1 AS BIGINT) FROM s)) r(k) WHERE t >= k * 200 AND t < k * 200 + 1000),
e AS (SELECT window_id, x - lag(x) OVER (PARTITION BY window_id ORDER BY t) AS e, t - window_id * 200 AS o FROM w) SELECT window_id, round(sqrt(avg(e * e)), 6) AS rmse FROM e WHERE o > 800 GROUP BY window_id""")
def window_naive_rmse(spark, d):
    b = experiment.windowed_benchmarks(series(spark, d), 1000, [{"method": "naive"}])
    return rounded(b.where(F.col("rmse").isNotNull() & ~F.isnan("rmse")).select("window_id", "rmse"), "rmse")


@query()
def windowed_benchmarks(spark, d):
    configs = [{"method": m, "partitions": n} for m in ("chen", "yu", "ismail_efendi") for n in (10, 20)] + [{"method": "whofts", "order": 2}]
    b = experiment.windowed_benchmarks(series(spark, d), 1000, configs).drop("seconds")
    return rounded(b.withColumn("rmse", F.when(~F.isnan("rmse"), F.col("rmse"))), "rmse")


# Reports over result tables.
def _results(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = table(spark, d, "benchmarks").where(valid("value") & F.col("dataset").isNotNull() & measure_key("measure").isin("rmse", "mape", "u", "time"))
    return entries(rows.withColumn("measure", measure_key("measure")), "dataset", "model", "measure", "value", *more)


_R = "r AS (SELECT DISTINCT id, dataset, model, lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) AS measure, value, fts_order FROM benchmarks WHERE isfinite(value) AND dataset IS NOT NULL AND lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) IN ('rmse', 'mape', 'u', 'time'))"


@query(f"WITH {_R} SELECT dataset, model, measure, {steady_sql("avg(value)")} AS mean, count(*) AS n FROM r GROUP BY 1, 2, 3")
def result_synthetic(spark, d):
    return steady(experiment.synthetic(_results(spark, d)).select("dataset", "model", "measure", "mean", "n"), "mean")


@query(f"WITH {_R} SELECT dataset, model, " + ", ".join(steady_sql(f"avg(CASE WHEN measure = '{m}' THEN value END)") + f" AS {m}" for m in ("rmse", "mape", "u", "time")) + " FROM r GROUP BY 1, 2")
def result_pivot(spark, d):
    return steady(experiment.analytic(_results(spark, d), ["dataset", "model"], ["rmse", "mape", "u", "time"]), "rmse", "mape", "u", "time")


@query(f"WITH {_R}, k AS (SELECT *, min(value) OVER g AS a, max(value) OVER g AS b FROM r WINDOW g AS (PARTITION BY dataset, measure)) SELECT id, round(CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END, 6) AS scaled FROM k")
def result_scaled(spark, d):
    return rounded(experiment.scaled(_results(spark, d)).select("id", "scaled"), "scaled")


@query(f"WITH {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY model, fts_order ORDER BY value, id) AS rn FROM r WHERE measure = 'rmse') SELECT model, fts_order, id, value FROM k WHERE rn = 1")
def find_best(spark, d):
    return store.find_best(_results(spark, d, "fts_order"), "rmse").select("model", "fts_order", "id", "value")


@query(f"WITH {_R}, m AS (SELECT dataset, measure, model, avg(value) AS v FROM r GROUP BY 1, 2, 3) SELECT dataset, measure, model, CAST(rank() OVER (PARTITION BY dataset, measure ORDER BY v) AS INTEGER) AS rank FROM m")
def rank_models(spark, d):
    return experiment.rank_models(_results(spark, d)).select("dataset", "measure", "model", "rank")


_P, _Q = (steady_sql(f"avg(CASE WHEN model = '{m}' THEN value END)") for m in ("PWFTS", "HOFTS"))


@query(f"WITH {_R} SELECT dataset, {_P} AS pwfts, {_Q} AS hofts FROM r WHERE measure = 'rmse' GROUP BY dataset")
def experiment_table(spark, d):
    t = experiment.experiment_table(_results(spark, d), "rmse", ["PWFTS", "HOFTS"])
    return steady(t.select("dataset", F.col("PWFTS").alias("pwfts"), F.col("HOFTS").alias("hofts")), "pwfts", "hofts")


@query(f"WITH {_R} SELECT CASE WHEN model LIKE '%Ensemble%' THEN 'ensemble' WHEN model LIKE '%MVFTS%' THEN 'multivariate' ELSE model END AS model, count(*) AS n FROM r WHERE model NOT LIKE '%ARIMA%' AND model NOT LIKE '%KNN%' GROUP BY 1")
def result_names(spark, d):
    r = experiment.rename(experiment.ignore(_results(spark, d), "model", ["ARIMA", "KNN"]), "model", {"Ensemble": "ensemble", "MVFTS": "multivariate"})
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R}, w AS (SELECT dataset, model, avg(CASE WHEN measure = 'rmse' THEN value END) AS rmse, avg(CASE WHEN measure = 'u' THEN value END) AS u FROM r GROUP BY 1, 2) SELECT dataset, model, 'rmse' AS measure, {steady_sql("rmse")} AS value FROM w UNION ALL SELECT dataset, model, 'u', {steady_sql("u")} FROM w")
def result_unpivot(spark, d):
    a = experiment.analytic(_results(spark, d), ["dataset", "model"], ["rmse", "u"])
    return steady(experiment.to_measures(a, ["dataset", "model"], ["rmse", "u"]), "value")


# Searches.
def _small(spark, d):
    return series(spark, d)


@query()
def grid_search(spark, d):
    s = _small(spark, d)
    return rounded(search.as_frame(s, search.grid_search(s, (5, 10), ((1,), (1, 2)), size=800, inc=0.2)), "f1", "f2", "rmse", "size")


@query()
def genetic_search(spark, d):
    s = _small(spark, d)
    best, _ = search.genetic(s, size=800, inc=0.2)
    return search.as_frame(s, [best])


@query()
def random_search(spark, d):
    s = _small(spark, d)
    return search.as_frame(s, [search.random_search(s, size=800, inc=0.2)])


# Streams.
def _stream(spark, d):
    raw = online.file_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events"))
    return raw.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("t"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


def _folder(spark: SparkSession) -> str:
    """A fresh place for a stream, beside the checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("""WITH e AS (SELECT event_type, event_id AS t, value AS x FROM events), u AS (SELECT min(x) * 0.9::DOUBLE AS lo, max(x) * 1.1::DOUBLE AS hi FROM e),
a AS (SELECT event_type, t, CAST(least(greatest(ceil((x - lo) / ((hi - lo) / 9) - 0.5::DOUBLE), 0), 9) AS INTEGER) AS i FROM e, u), tr AS (SELECT lag(i) OVER (PARTITION BY event_type ORDER BY t) AS lhs, i AS rhs FROM a)
SELECT lhs, rhs, count(*) AS n FROM tr WHERE lhs IS NOT NULL GROUP BY 1, 2""")
def stream_rules(spark, d):
    return online.run_rules(_stream(spark, d), P.grid(series(spark, d), "x", 10), _folder(spark))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_windows(spark, d):
    out = online.window_statistics(_stream(spark, d)).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", F.round("mean", 6).alias("mean"))
    return online.collect_whole(out, _folder(spark))


@query()
def stream_drift(spark, d):
    return rounded(online.collect_stream(online.drift_state(_stream(spark, d).select("series_id", "t", "x")), _folder(spark)), "drift")


@query()
def stream_sessions(spark, d):
    out = online.sessions(_stream(spark, d)).select("series_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")
    return online.collect_whole(out, _folder(spark))
