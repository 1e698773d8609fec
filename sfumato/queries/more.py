"""Queries of multi-step forecasts, maps, the model interface and further reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sfumato.functions.scalars import date_part
from sfumato.operators import partition as P
from sfumato.operators.entries import entries, measure_key, valid
from sfumato.operators.rules import indexed
from sfumato.operators import measures as M
from sfumato.plans import ahead, ensemble, experiment, high_order, model, search, som
from sfumato.plans import multivariate as mv
from sfumato.queries.base import FUZZY, S, rounded, series
from sfumato.queries.measures import SQL as MEASURES
from sfumato.queries.models import _ENS, _dense_panel, _members, _mv
from sfumato.queries.models import SQL as MODELS
from sfumato.queries.univariate import _OUT, _RULE_SQL, TRANS
from sfumato.queries.univariate import SQL as UNI
from sfumato.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


@query(f"SELECT target_t, yhat FROM ({UNI['chen_ahead']}) WHERE horizon = 3")
def forecast_step(spark, d):
    s = series(spark, d)
    return rounded(model.Model("chen", 10).fit(s).predict(s, step_to=3).select("target_t", "yhat"), "yhat")


@query(TRANS.replace(S, "s AS (SELECT event_id AS t, ln(value + 1) AS x FROM events)") + ", " + _RULE_SQL["chen"] + _OUT.replace("round(coalesce(m.mid, a.c), 6)", "round(exp(coalesce(m.mid, a.c)) - 1, 6)"))
def transformed_model(spark, d):
    s = series(spark, d)
    log = model.Step(lambda x: F.ln(x + 1), lambda y: F.exp(y) - 1)
    return rounded(model.Model("chen", 10, steps=(log,)).fit(s).predict(s), "yhat")


@query(TRANS + ", " + _RULE_SQL["chen"] + " SELECT 'A' || i AS lhs, round(mid, 6) AS mid FROM m")
def model_rules(spark, d):
    return rounded(model.Model("chen", 10).fit(series(spark, d)).render(), "mid")


@query(TRANS.replace("WITH ", "WITH e AS (SELECT event_id AS t, CAST(hour(ts) AS INTEGER) AS season FROM events), ", 1) + " SELECT tr.t, tr.i AS lhs, tr.j AS rhs, e.season FROM tr JOIN e ON e.t = tr.t + 1")
def flr_indexed(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x"), date_part("hour_of_day", F.col("ts")).alias("hour"))
    return indexed(s, P.grid(s, "x", 10), "hour")


@query(FUZZY + ", k AS (SELECT s.t, g.set_ix, row_number() OVER (PARTITION BY s.t ORDER BY (s.x - (g.c - g.p)) * (s.x - (g.c - g.p)) + (s.x - g.c) * (s.x - g.c) + (s.x - (g.c + g.p)) * (s.x - (g.c + g.p)), g.set_ix) AS rn FROM s, g) SELECT t, CAST(rn AS INTEGER) AS place, set_ix FROM k WHERE rn <= 3")
def nearest_sets(spark, d):
    s = series(spark, d)
    near = model.nearest(P.grid(s, "x", 10), F.col("x"), 3)
    return s.select("t", F.posexplode(near).alias("place", "set_ix")).select("t", (F.col("place") + 1).alias("place"), "set_ix")


def _one_series_fit(spark, d, method, lags, n=6):
    """Rules of the whole series, applied at the end of each event type's series."""
    return model.Model(method, n, lags).fit(series(spark, d)), _dense_panel(spark, d)


@query()
def hofts_ahead(spark, d):
    m, panel = _one_series_fit(spark, d, "whofts", (1, 2))
    return rounded(m.predict(panel, steps_ahead=5), "yhat")


@query()
def ifts_ahead(spark, d):
    m, panel = _one_series_fit(spark, d, "wifts", (1, 2))
    return rounded(m.predict(panel, "interval", 5), "lower", "upper")


@query()
def pwfts_ahead(spark, d):
    m, panel = _one_series_fit(spark, d, "pwfts", (1,))
    return rounded(m.predict(panel, steps_ahead=5), "yhat")


@query()
def pwfts_ahead_interval(spark, d):
    m, panel = _one_series_fit(spark, d, "pwfts", (1,))
    return rounded(m.predict(panel, "interval", 5), "lower", "upper")


@query()
def pwfts_ahead_distribution(spark, d):
    m, panel = _one_series_fit(spark, d, "pwfts", (1,))
    return rounded(m.predict(panel, "distribution", 3), "density")


@query()
def mvfts_ahead(spark, d):
    s, vs, x = _mv(spark, d)
    rules = cut(mv.rules(s, vs, x, weighted=True))  # read by every step
    end = s.agg(F.max("t")).head()[0]
    future = spark.range(1, 6).select((F.col("id") + end).alias("t"), F.lit(0.0).alias("x"), F.pmod(F.col("id"), F.lit(24)).cast("double").alias("h"))
    return rounded(ahead.multivariate_ahead(s.where(F.col("t") == end).select("t", "x", "h"), future, lambda now: mv.forecast(now, vs, x, rules), "x", 5), "yhat")


@query()
def som_projection(spark, d):
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return som.train(s, cols, (4, 4), 4).transform(s, ["l_orderkey", "l_linenumber"])


@query(_ENS + ", k AS (SELECT CAST(i AS INTEGER) AS bin_ix, i * (500.0::DOUBLE / 9) AS bin FROM range(0, 10) r(i)), e AS (SELECT target_t, bin_ix, (bin - y) / 50 AS u FROM al, k) SELECT target_t, bin_ix, round(sum(exp(-u * u / 2.0) / sqrt(2 * pi())) / (count(*) * 50), 6) AS density FROM e GROUP BY target_t, bin_ix")
def ensemble_kde(spark, d):
    return rounded(ensemble.kde(_members(spark, d), 0.0, 500.0, 10, 50.0).select("target_t", "bin_ix", "density"), "density")


@query("""WITH b AS (SELECT DISTINCT id, dataset, model, value FROM benchmarks WHERE lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) = 'rmse' AND isfinite(value) AND dataset IS NOT NULL),
m AS (SELECT dataset, model, min(value) AS v FROM b GROUP BY dataset, model), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY dataset) AS k FROM m),
s AS (SELECT dataset, max(v) - min(v) AS sp FROM m GROUP BY dataset), q AS (SELECT dataset, rank() OVER (ORDER BY sp) + (count(*) OVER (PARTITION BY sp) - 1) / 2.0::DOUBLE AS q FROM s)
SELECT model, round(sum(q * (r - (k + 1) / 2.0::DOUBLE)), 3) AS s, round(sum(q * r), 3) AS w FROM r JOIN q ON q.dataset = r.dataset GROUP BY model""")
def quade(spark, d):
    b = table(spark, d, "benchmarks").where((measure_key("measure") == "rmse") & valid("value") & F.col("dataset").isNotNull())
    m = entries(b, "dataset", "model", "value").groupBy("dataset", "model").agg(F.min("value").alias("value"))
    return model.quade(m).select("model", F.round("s", 3).alias("s"), F.round("w", 3).alias("w"))


def _clustered(spark, d):
    s, vs, x = _mv(spark, d)
    return mv.cluster_symbols(s, vs), mv.cluster_partition(vs, x), F.col("f")


@query()
def clustered_point(spark, d):
    """Probabilistic model over multivariate sets."""
    s, p, f = _clustered(spark, d)
    mass = high_order.pwfts_rules(s, p, (1,), fuzzy=f)
    return rounded(high_order.pwfts_point(s, p, high_order.pwfts_groups(mass, p), (1,), fuzzy=f), "yhat", "lower", "upper")


# Ties of degree go to the greater number of the combination.
@query(MODELS["clustered_mvfts"].replace("co AS (SELECT f.t, f.set_ix || '-' || fh.set_ix AS path,", "co AS (SELECT f.t, f.set_ix * 6 + fh.set_ix AS path,"))
def clustered_weighted(spark, d):
    """Frequency-weighted model over multivariate sets."""
    s, p, f = _clustered(spark, d)
    return rounded(high_order.forecast(s, p, high_order.rules(s, p, (1,), True, fuzzy=f), (1,), fuzzy=f).select("target_t", "yhat"), "yhat")


@query()
def clustered_distribution(spark, d):
    s, p, f = _clustered(spark, d)
    out = high_order.pwfts_distribution(s, p, high_order.pwfts_rules(s, p, (1,), fuzzy=f), (1,), 20, fuzzy=f)
    return rounded(out, "bin", "density").where(F.col("density") > 0)


@query()
def multivariate_search(spark, d):
    s, _, _ = _mv(spark, d)
    best = search.multivariate_search(s.select("t", "x", "h"), "x", ["h"], steps=3)
    return spark.createDataFrame([(",".join(f"{c}:{n}" for c, n in best.variables), best.f1, best.f2)], "variables string, f1 double, f2 double")


@query(MEASURES["interval_measures"].split("SELECT round(avg(up - lo)")[0] + "SELECT round(sqrt(avg(pow(y - (lo + up) / 2, 2))), 6) AS rmse_interval, round(avg(abs((y - (lo + up) / 2) / nullif((lo + up) / 2, 0))) * 100, 6) AS mape_interval FROM yy")
def interval_midpoint(spark, d):
    s = series(spark, d)
    p = P.grid(s, "x", 6)
    fc = high_order.forecast(s, p, high_order.rules(s, p, (1, 2), True), (1, 2))
    return rounded(M.interval_midpoint(M.actuals(s, fc)), "rmse_interval", "mape_interval")


@query("""WITH b AS (SELECT DISTINCT id, dataset, model, value FROM benchmarks WHERE lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) = 'rmse' AND isfinite(value) AND dataset IS NOT NULL AND model IN ('PWFTS', 'HOFTS', 'WHOFTS', 'CFTS')),
m AS (SELECT dataset, model, min(value) AS v FROM b GROUP BY dataset, model), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY dataset) AS k FROM m),
s AS (SELECT model, sum(r) AS s, count(*) AS n FROM r WHERE k = 4 GROUP BY model) SELECT max(n) AS blocks, round(12.0::DOUBLE / (max(n) * 20) * sum(s * s) - 15 * max(n), 6) AS statistic FROM s""")
def friedman(spark, d):
    b = table(spark, d, "benchmarks").where((measure_key("measure") == "rmse") & valid("value") & F.col("dataset").isNotNull() & F.col("model").isin("PWFTS", "HOFTS", "WHOFTS", "CFTS"))
    m = entries(b, "dataset", "model", "value").groupBy("dataset", "model").agg(F.min("value").alias("value"))
    r = M.friedman(m)
    return rounded(spark.createDataFrame([(r["blocks"], float(r["statistic"]))], "blocks bigint, statistic double"), "statistic")


@query("""WITH b AS (SELECT DISTINCT id, dataset, model, value FROM benchmarks WHERE lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) = 'rmse' AND isfinite(value) AND dataset IS NOT NULL AND model IS NOT NULL),
m AS (SELECT dataset, model, min(value) AS v FROM b GROUP BY dataset, model), a AS (SELECT count(DISTINCT model)::DOUBLE AS k FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY dataset) AS own FROM m),
s AS (SELECT model, sum(r) AS s, count(*) AS n FROM r, a WHERE own = k GROUP BY model)
SELECT coalesce(max(n), 0) AS blocks, coalesce(round(12.0::DOUBLE / (max(n) * max(k) * (max(k) + 1)) * sum(s * s) - 3 * max(n) * (max(k) + 1), 6), 0) AS statistic FROM a LEFT JOIN s ON k > 1""")
def friedman_all(spark, d):
    """Over all models, of the datasets that hold every one."""
    b = table(spark, d, "benchmarks").where((measure_key("measure") == "rmse") & valid("value") & F.col("dataset").isNotNull() & F.col("model").isNotNull())
    m = entries(b, "dataset", "model", "value").groupBy("dataset", "model").agg(F.min("value").alias("value"))
    r = M.friedman(m)
    return rounded(spark.createDataFrame([(r["blocks"], float(r["statistic"]))], "blocks bigint, statistic double"), "statistic")


@query()
def best_config(spark, d):
    configs = [{"method": m, "partitions": n} for m in ("chen", "yu") for n in (5, 10, 20)]
    b = experiment.windowed_benchmarks(series(spark, d), 500, configs)
    return rounded(experiment.best_config(b.where(~F.isnan("rmse"))), "rmse")
