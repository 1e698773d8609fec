"""Queries of seasonal, multivariate, non-stationary, ensemble, incremental, neural and baseline models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.functions.scalars import SEASONS, date_part
from sfumato.operators import partition as P
from sfumato.operators.fuzzify import fuzzify
from sfumato.operators.rules import transitions
from sfumato.operators.series import dense
from sfumato.plans import baselines, cognitive_map, ensemble, incremental
from sfumato.plans import first_order as fo
from sfumato.plans import multivariate as mv
from sfumato.plans import nonstationary as ns
from sfumato.plans import seasonal as se
from sfumato.queries.base import S, fuzzy_sql, rounded, series, sets_sql
from sfumato.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# Seasonal.
def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("t"), F.col("value").alias("x"), "ts",
        se.time_index(F.col("ts"), "hour_of_day").alias("hour"), se.time_index(F.col("ts"), "day_of_week").alias("weekday"))


_WD, _H = "(isodow(ts) - 1)", "hour(ts)"
_MONTH0, _DAY0, _YDAY0 = "(month(ts) - 1)", "(day(ts) - 1)", "(dayofyear(ts) - 1)"
_PARTS = {
    "year": "year(ts)", "half": f"{_MONTH0} // 6 + 1", "third": f"{_MONTH0} // 4 + 1", "quarter": f"{_MONTH0} // 3 + 1", "sixth": f"{_MONTH0} // 2 + 1",
    "month": "month(ts)", "day_of_year": "dayofyear(ts)", "day_of_month": "day(ts)", "day_of_week": _WD, "hour_of_day": _H, "hour_of_week": f"{_WD} * 24 + {_H}",
    "hour_of_month": f"{_DAY0} * 24 + {_H}", "hour_of_year": f"{_YDAY0} * 24 + {_H}", "minute_of_hour": "minute(ts)", "minute_of_day": f"{_H} * 60 + minute(ts)",
    "minute_of_week": f"({_WD} * 24 + {_H}) * 60 + minute(ts)", "minute_of_month": f"({_DAY0} * 24 + {_H}) * 60 + minute(ts)",
    "minute_of_year": f"({_YDAY0} * 24 + {_H}) * 60 + minute(ts)", "second_of_minute": "second(ts)", "second_of_hour": "minute(ts) * 60 + second(ts)",
    "second_of_day": f"({_H} * 60 + minute(ts)) * 60 + second(ts)",
}
assert set(_PARTS) == set(SEASONS)


@query("SELECT event_id AS t, " + ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in _PARTS.items()) + " FROM events")
def dateparts(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("t"), *(date_part(n, F.col("ts")).alias(n) for n in _PARTS))


@query("SELECT event_id AS t, CAST(event_id // 10 % 7 AS INTEGER) AS season, CAST(floor(value / 50) AS INTEGER) AS field_season FROM events")
def season_index(spark, d):
    return series(spark, d).select("t", se.linear_index(F.col("t"), 10, 7).alias("season"), se.field_index(F.col("x"), 50).alias("field_season"))


_TIMED = f"WITH s AS (SELECT event_id AS t, value AS x, CAST({_H} AS INTEGER) AS hour, CAST({_WD} AS INTEGER) AS weekday FROM events), {sets_sql()}, {fuzzy_sql()}"


@query(_TIMED + ", m AS (SELECT s.hour, quantile_cont(a.c, 0.5) AS y FROM a JOIN s ON s.t = a.t GROUP BY s.hour) SELECT s.t, round(m.y, 6) AS yhat FROM s JOIN m ON m.hour = s.hour")
def seasonal_fts(spark, d):
    s = _timed(spark, d)
    p = P.grid(s, "x", 10)
    return rounded(se.seasonal_forecast(s, se.seasonal_rules(s, p, ["hour"]), ["hour"]).select("t", "yhat"), "yhat")


@query(_TIMED + ", m AS (SELECT s.weekday, s.hour, avg(a.c) AS y FROM a JOIN s ON s.t = a.t GROUP BY s.weekday, s.hour) SELECT s.t, round(m.y, 6) AS yhat FROM s JOIN m ON m.hour = s.hour AND m.weekday = s.weekday")
def multi_seasonal_fts(spark, d):
    s = _timed(spark, d)
    p = P.grid(s, "x", 10)
    return rounded(se.seasonal_forecast(s, se.seasonal_rules(s, p, ["weekday", "hour"], "mean"), ["weekday", "hour"]).select("t", "yhat"), "yhat")


def _ctx(season):
    return f"""pr{season} AS (SELECT DISTINCT w.{season} AS season, q.set_ix AS i, f.set_ix AS j, f.c FROM f q JOIN s w ON w.t = q.t + 1 JOIN f ON f.t = w.t),
ru{season} AS (SELECT season, i, sum(c) AS total, count(*) AS n FROM pr{season} GROUP BY season, i),
cf{season} AS (SELECT f.t + 1 AS target_t, sum(coalesce(r.total, f.c)) / sum(coalesce(r.n, 1)) AS yhat FROM f JOIN s ON s.t = f.t LEFT JOIN ru{season} r ON r.season = s.{season} AND r.i = f.set_ix
  WHERE s.{season} IN (SELECT season FROM ru{season}) GROUP BY f.t
  UNION ALL SELECT t + 1, NULL FROM s WHERE {season} NOT IN (SELECT season FROM ru{season}))"""


@query(_TIMED + ", " + _ctx("hour") + " SELECT target_t, round(yhat, 6) AS yhat FROM cfhour")
def contextual_seasonal_fts(spark, d):
    s = _timed(spark, d)
    p = P.grid(s, "x", 10)
    return rounded(se.contextual_forecast(s, p, se.contextual_rules(s, p, "hour"), "hour"), "yhat")


@query(_TIMED + ", " + _ctx("hour") + ", " + _ctx("weekday") + " SELECT target_t, round(avg(yhat), 6) AS yhat FROM (SELECT * FROM cfhour UNION ALL SELECT * FROM cfweekday) GROUP BY target_t")
def seasonal_ensemble(spark, d):
    s = _timed(spark, d)
    return rounded(ensemble.point(ensemble.seasonal(s, P.grid(s, "x", 10), ["hour", "weekday"])), "yhat")


@query("""WITH g AS (SELECT CAST(i AS INTEGER) AS set_ix, 1.5::DOUBLE + i * 3 AS m FROM range(0, 8) r(i)), h AS (SELECT event_id AS t, CAST(hour(ts) AS DOUBLE) AS x FROM events),
e AS (SELECT t, set_ix, greatest(0, 1 - abs(x - m) / 3, CASE WHEN set_ix = 0 THEN 1 - abs(x - 24) / 1.5::DOUBLE ELSE 0 END, CASE WHEN set_ix = 7 THEN 1 - abs(x) / 1.5::DOUBLE ELSE 0 END) AS mu FROM h, g)
SELECT t, set_ix, round(mu, 6) AS mu FROM e WHERE mu > 0""")
def time_grid(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("t"), F.hour("ts").cast("double").alias("x"))
    return rounded(fuzzify(s, P.time_grid(24, 8)).select("t", "set_ix", "mu"), "mu")


# Multivariate: value and hour.
def _mv(spark, d):
    s = _timed(spark, d).withColumn("h", F.col("hour").cast("double"))
    x = mv.Variable("x", F.col("x"), P.grid(s, "x", 6))
    h = mv.Variable("h", F.col("h"), P.grid(s, "h", 6))
    return s, [x, h], x


_MV = f"""WITH s AS (SELECT event_id AS t, value AS x, CAST({_H} AS DOUBLE) AS h FROM events), {sets_sql(6)}, {sets_sql(6, "s", "h", "h")}, {fuzzy_sql()}, {fuzzy_sql("s", "h", "h")},
co AS (SELECT f.t, f.set_ix || '-' || fh.set_ix AS path, least(f.mu, fh.mu) AS mu, f.set_ix AS own, f.c AS oc, f.l AS ol, f.u AS ou FROM f JOIN fh ON fh.t = f.t),
pr AS (SELECT co.t, co.path, f.set_ix AS j, f.c, f.l, f.u FROM co JOIN f ON f.t = co.t + 1)"""


def _mvq(weighted):
    def run(spark, d):
        s, vs, x = _mv(spark, d)
        return rounded(mv.forecast(s, vs, x, mv.rules(s, vs, x, weighted)), "yhat", "lower", "upper")

    m = "SELECT path, avg(c) AS mid, avg(l) AS lower, avg(u) AS upper FROM pr GROUP BY path" if weighted else "SELECT path, avg(c) AS mid, min(l) AS lower, max(u) AS upper FROM (SELECT DISTINCT path, j, c, l, u FROM pr) GROUP BY path"
    sql = _MV + f", m AS ({m}) SELECT co.t + 1 AS target_t, round(sum(mu * coalesce(mid, oc)) / sum(mu), 6) AS yhat, round(sum(mu * coalesce(lower, ol)) / sum(mu), 6) AS lower, round(sum(mu * coalesce(upper, ou)) / sum(mu), 6) AS upper FROM co LEFT JOIN m ON m.path = co.path GROUP BY co.t"
    return run, sql


for _name, _w in (("mvfts", False), ("weighted_mvfts", True)):
    _f, _sql = _mvq(_w)
    query(_sql, _name)(_f)

_CLS = f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS t, l_quantity AS q, l_discount AS d, l_returnflag AS cls, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup FROM lineitem),
{sets_sql(5, "s", "q", "q")}, {sets_sql(5, "s", "d", "d")},
sq AS (SELECT DISTINCT q FROM s), sd AS (SELECT DISTINCT d FROM s),
fq AS (SELECT q, set_ix, 1 - abs(q - c) / p AS mu FROM sq, gq WHERE 1 - abs(q - c) / p > 0), fd AS (SELECT d, set_ix, 1 - abs(d - c) / p AS mu FROM sd, gd WHERE 1 - abs(d - c) / p > 0),
co AS (SELECT s.t, s.cls, fq.set_ix || '-' || fd.set_ix AS path, least(fq.mu, fd.mu) AS mu FROM s JOIN fq ON fq.q = s.q JOIN fd ON fd.d = s.d WHERE s.dup = 1),
sh AS (SELECT path, cls, count(*) / sum(count(*)) OVER (PARTITION BY path) AS share FROM co GROUP BY path, cls),
sc AS (SELECT co.t, sh.cls, sum(sh.share * co.mu) AS score FROM co JOIN sh ON sh.path = co.path GROUP BY co.t, sh.cls)"""


def _cls(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("cls"))
    pq, pd_ = P.grid(s, "q", 5), P.grid(s, "d", 5)
    once = s.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("q", "d", "cls"))).where("n = 1")
    once = once.withColumn("t", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return once, [mv.Variable("q", F.col("q"), pq), mv.Variable("d", F.col("d"), pd_)]


@query(_CLS + " SELECT t, cls AS class, round(score / sum(score) OVER (PARTITION BY t), 6) AS p FROM sc")
def classify_scale(spark, d):
    s, vs = _cls(spark, d)
    return rounded(mv.classify(s, vs, mv.class_rules(s, vs, "cls")), "p")


@query(_CLS + " SELECT t, cls AS class, round(exp(score) / sum(exp(score)) OVER (PARTITION BY t), 6) AS p FROM sc")
def classify_softmax(spark, d):
    s, vs = _cls(spark, d)
    return rounded(mv.classify(s, vs, mv.class_rules(s, vs, "cls"), activation="softmax"), "p")


# Over every row: a key that repeats is told apart by its values, equal rows are counted.
_CLS_ALL = f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_returnflag AS cls FROM lineitem),
{sets_sql(5, "s", "q", "q")}, {sets_sql(5, "s", "d", "d")},
sq AS (SELECT DISTINCT q FROM s), sd AS (SELECT DISTINCT d FROM s),
fq AS (SELECT q, set_ix, 1 - abs(q - c) / p AS mu FROM sq, gq WHERE 1 - abs(q - c) / p > 0), fd AS (SELECT d, set_ix, 1 - abs(d - c) / p AS mu FROM sd, gd WHERE 1 - abs(d - c) / p > 0),
co AS (SELECT fq.q, fd.d, fq.set_ix || '-' || fd.set_ix AS path, least(fq.mu, fd.mu) AS mu FROM fq, fd),
sh AS (SELECT path, cls, count(*) / sum(count(*)) OVER (PARTITION BY path) AS share FROM s JOIN co ON co.q = s.q AND co.d = s.d GROUP BY path, cls),
sc AS (SELECT co.q, co.d, sh.cls, sum(sh.share * co.mu) AS score FROM co JOIN sh ON sh.path = co.path GROUP BY co.q, co.d, sh.cls),
n AS (SELECT l_orderkey, l_linenumber, q, d, count(*) AS n FROM s GROUP BY 1, 2, 3, 4)"""


def _classified(spark, d, activation):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("cls"))
    vs = [mv.Variable("q", F.col("q"), P.grid(s, "q", 5)), mv.Variable("d", F.col("d"), P.grid(s, "d", 5))]
    keys = ["l_orderkey", "l_linenumber", "q", "d"]
    rows = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.struct(*keys, "n"))
    return rounded(mv.classify(rows, vs, mv.class_rules(s, vs, "cls"), "row", activation), "p").select("row.*", "class", "p")


@query(_CLS_ALL + " SELECT l_orderkey, l_linenumber, q, d, n, cls AS class, round(score / sum(score) OVER (PARTITION BY l_orderkey, l_linenumber, q, d), 6) AS p FROM n JOIN sc USING (q, d)")
def classify_scale_all(spark, d):
    return _classified(spark, d, "scale")


@query(_CLS_ALL + " SELECT l_orderkey, l_linenumber, q, d, n, cls AS class, round(exp(score) / sum(exp(score)) OVER (PARTITION BY l_orderkey, l_linenumber, q, d), 6) AS p FROM n JOIN sc USING (q, d)")
def classify_softmax_all(spark, d):
    return _classified(spark, d, "softmax")


@query(_MV + """, ra AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mu DESC, own DESC, path DESC) AS rn FROM co), cl AS (SELECT t, path, own, oc FROM ra WHERE rn <= 2),
ru AS (SELECT q.path, avg(w.oc) AS mid FROM cl q JOIN cl w ON w.t = q.t + 1 GROUP BY q.path) SELECT cl.t + 1 AS target_t, round(avg(coalesce(ru.mid, cl.oc)), 6) AS yhat FROM cl LEFT JOIN ru ON ru.path = cl.path GROUP BY cl.t""")
def clustered_mvfts(spark, d):
    s, vs, x = _mv(spark, d)
    c = mv.clusters(s, vs)
    return rounded(mv.cluster_forecast(c, mv.cluster_rules(c, x), x), "yhat")


@query()
def granular_mvfts(spark, d):
    """Order 2 over the combinations seen in training."""
    s, vs, x = _mv(spark, d)
    c = mv.clusters(s, vs, seen_only=mv.argmax_symbols(s, vs))
    return rounded(mv.cluster_forecast(c, mv.cluster_rules(c, x, lags=(1, 2)), x, lags=(1, 2)), "yhat")


@query(_MV + " SELECT path, count(*) AS n FROM (SELECT a.set_ix || '-' || ah.set_ix AS path FROM a JOIN ah ON ah.t = a.t) GROUP BY path")
def cluster_grid(spark, d):
    s, vs, _ = _mv(spark, d)
    return mv.argmax_symbols(s, vs).groupBy(F.concat_ws("-", F.transform("path", lambda i: i.cast("string"))).alias("path")).agg(F.count(F.lit(1)).alias("n"))


# Non-stationary.
_NS = f"""WITH {S}, {sets_sql(6)}, k AS (SELECT t, x, 0.001::DOUBLE * (t - t % 100) AS dl FROM s),
m0 AS (SELECT t, dl, set_ix, c, p, CASE WHEN x < (c - p) + dl OR x > (c + p) + dl THEN 0 WHEN x < c + dl THEN (x - ((c - p) + dl)) / ((c + dl) - ((c - p) + dl)) WHEN x = c + dl THEN 1
      ELSE (((c + p) + dl) - x) / (((c + p) + dl) - (c + dl)) END AS mu FROM k, g),
f AS (SELECT * FROM m0 WHERE mu > 0 UNION ALL
      SELECT t, dl, CASE WHEN x < lo + dl THEN 0 ELSE 5 END, CASE WHEN x < lo + dl THEN lo ELSE lo + 5 * p END, p, 1.0::DOUBLE FROM k, (SELECT min(lo) AS lo, min(p) AS p FROM g) WHERE t NOT IN (SELECT t FROM m0 WHERE mu > 0))"""


def _moving(s: DataFrame) -> ns.Moving:
    return ns.Moving(P.grid(s, "x", 6), ((0.001, 0.0),) * 6, ((0.0, 0.0),) * 6, 100)


def _nsq(weighted):
    def run(spark, d):
        s = series(spark, d)
        m = _moving(s)
        return rounded(ns.forecast(s, m, ns.rules(s, m, weighted=weighted)), "yhat", "lower", "upper")

    agg = "SELECT i, avg(c) AS mid FROM pr GROUP BY i" if weighted else "SELECT i, avg(c) AS mid FROM (SELECT DISTINCT i, j, c FROM pr) GROUP BY i"
    sql = _NS + f""", pr AS (SELECT q.set_ix AS i, w.set_ix AS j, w.c FROM f q JOIN f w ON w.t = q.t + 1), m AS ({agg})
SELECT f.t + 1 AS target_t, round(sum(mu * (coalesce(mid, f.c) + dl)) / sum(mu), 6) AS yhat, round(sum(mu * (coalesce(mid, f.c) - p + dl)) / sum(mu), 6) AS lower,
  round(sum(mu * (coalesce(mid, f.c) + p + dl)) / sum(mu), 6) AS upper FROM f LEFT JOIN m ON m.i = f.set_ix GROUP BY f.t"""
    return run, sql


for _name, _w in (("nsfts_unconditional", False), ("weighted_nsfts", True)):
    _f, _sql = _nsq(_w)
    query(_sql, _name)(_f)


@query()
def high_order_nsfts(spark, d):
    s = series(spark, d)
    m = ns.polynomial(s, P.grid(s, "x", 6), 1000)
    fc = ns.forecast(s, m, ns.rules(s, m, (1, 2), True), (1, 2))
    return fc.select("target_t", *(F.round(c, 4).alias(c) for c in ("yhat", "lower", "upper")))


def _mids(s: DataFrame, p: P.Partition) -> dict[int, float]:
    return {r["lhs"]: r["mid"] for r in fo.chen_rules(transitions(s, p, keys=["series_id"]), p).collect()}


@query()
def nsfts_conditional(spark, d):
    s = _dense_panel(spark, d)
    p = P.grid(s, "x", 8, margin=-0.05)
    mids = _mids(s, p)
    return ns.conditional_forecast(s, p, mids, ns.train_residuals(s, p, mids)).withColumn("yhat", F.round("yhat", 4))


def _dense_panel(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), "event_id", F.col("value").alias("x"))
    return dense(e, "event_id", ["series_id"]).drop("event_id")


@query()
def cvfts(spark, d):
    s = _dense_panel(spark, d)
    p = P.grid(s, "x", 8, margin=-0.05)
    return ns.variance_forecast(s, p, _mids(s, p)).withColumn("yhat", F.round("yhat", 4))


@query("SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS t, value AS x FROM events")
def panel(spark, d):
    return _dense_panel(spark, d)


# Ensembles of first-order members with 5, 10 and 15 sets.
def _member(n):
    k = f"_{n}"
    return f"""{sets_sql(n, "s", "x", k)}, {fuzzy_sql("s", "x", k)}, tr{k} AS (SELECT DISTINCT q.set_ix AS i, w.c FROM a{k} q JOIN a{k} w ON w.t = q.t + 1), m{k} AS (SELECT i, avg(c) AS mid FROM tr{k} GROUP BY i),
fc{k} AS (SELECT 'chen-{n}-1' AS model, a{k}.t + 1 AS target_t, coalesce(m{k}.mid, a{k}.c) AS y FROM a{k} LEFT JOIN m{k} ON m{k}.i = a{k}.set_ix)"""


_ENS = f"WITH {S}, " + ", ".join(_member(n) for n in (5, 10, 15)) + ", al AS (SELECT * FROM fc_5 UNION ALL SELECT * FROM fc_10 UNION ALL SELECT * FROM fc_15)"


def _members(spark, d):
    s = series(spark, d)
    return ensemble.union(ensemble.simple_members(s, (5, 10, 15)))


for _how, _e in {"mean": "avg(y)", "median": "quantile_cont(y, 0.5)", "quantile": "quantile_cont(y, 0.25)"}.items():
    query(_ENS + f" SELECT target_t, round({_e}, 6) AS yhat FROM al GROUP BY target_t", f"ensemble_{_how}")(
        lambda spark, d, how=_how: rounded(ensemble.point(_members(spark, d), how, 0.25), "yhat"))


@query(_ENS + ", k AS (SELECT *, exp(-(row_number() OVER (PARTITION BY target_t ORDER BY model DESC) - 1)::DOUBLE) AS w FROM al) SELECT target_t, round(sum(w * y) / sum(w), 6) AS yhat FROM k GROUP BY target_t")
def ensemble_exponential(spark, d):
    return rounded(ensemble.point(_members(spark, d), "exponential"), "yhat")


for _how, _lo, _up in (
    ("extremum", "min(y)", "max(y)"), ("quantile", "quantile_cont(y, 0.1)", "quantile_cont(y, 0.9)"),
    ("normal", "avg(y) - 1.2815515655446008::DOUBLE * stddev_pop(y)", "avg(y) + 1.2815515655446008::DOUBLE * stddev_pop(y)"),
):
    query(_ENS + f" SELECT target_t, round({_lo}, 6) AS lower, round({_up}, 6) AS upper FROM al GROUP BY target_t", f"ensemble_interval_{_how}")(
        lambda spark, d, how=_how: rounded(ensemble.interval(_members(spark, d), how, 0.1), "lower", "upper"))


@query(_ENS + ", b AS (SELECT target_t, CAST(least(greatest(ceil(y / (500.0::DOUBLE / 49)), 0), 49) AS INTEGER) AS bin_ix FROM al) SELECT target_t, bin_ix, round(count(*) / 3.0::DOUBLE, 6) AS density FROM b GROUP BY target_t, bin_ix")
def ensemble_distribution(spark, d):
    return rounded(ensemble.distribution(_members(spark, d), 0.0, 500.0, 50), "density")


@query(_ENS + ", q AS (SELECT target_t, list(y ORDER BY y) AS l FROM al GROUP BY target_t), k AS (SELECT CAST(i AS DOUBLE) / 10 AS q FROM range(1, 10) r(i)) SELECT target_t, round(k.q, 1) AS q, round(l[CAST(floor(k.q * 2) AS INTEGER) + 1] + (k.q * 2 - floor(k.q * 2)) * (l[least(CAST(floor(k.q * 2) AS INTEGER) + 2, 3)] - l[CAST(floor(k.q * 2) AS INTEGER) + 1]), 6) AS value FROM q, k")
def ensemble_sampler(spark, d):
    return rounded(ensemble.sampler(_members(spark, d)), "value")


@query()
def all_method_ensemble(spark, d):
    s = series(spark, d)
    return rounded(ensemble.point(ensemble.union(ensemble.all_method_members(s, P.grid(s, "x", 6)))), "yhat")


# Time-variant.
_INC = f"""WITH {S}, w AS (SELECT s.*, k AS window_id FROM s, LATERAL (SELECT unnest(range(t // 100 + 1, (t + 300) // 100 + 1)) AS k) WHERE k * 100 >= 300),
gr AS (SELECT window_id, CASE WHEN min(x) < 0 THEN min(x) * 1.1::DOUBLE ELSE min(x) * 0.9::DOUBLE END AS lo, CASE WHEN max(x) > 0 THEN max(x) * 1.1::DOUBLE ELSE max(x) * 0.9::DOUBLE END AS hi FROM w GROUP BY window_id),
g AS (SELECT gr.window_id, CAST(i AS INTEGER) AS set_ix, lo + i * ((hi - lo) / 9) AS c, (hi - lo) / 9 AS p FROM gr, range(0, 10) r(i)),
a AS (SELECT window_id, t, set_ix, c FROM (SELECT w.window_id, w.t, g.set_ix, g.c, row_number() OVER (PARTITION BY w.window_id, w.t ORDER BY 1 - abs(w.x - g.c) / g.p DESC, g.set_ix) AS rn FROM w JOIN g ON g.window_id = w.window_id) WHERE rn = 1),
m AS (SELECT window_id, i, avg(c) AS mid FROM (SELECT DISTINCT q.window_id, q.set_ix AS i, z.c FROM a q JOIN a z ON z.window_id = q.window_id AND z.t = q.t + 1) GROUP BY window_id, i),
k AS (SELECT s.t, s.x, s.t // 100 - mo AS window_id, mo FROM s, range(0, {{models}}) r(mo)),
b AS (SELECT t, mo, window_id, set_ix, c FROM (SELECT k.t, k.mo, k.window_id, g.set_ix, g.c, row_number() OVER (PARTITION BY k.t, k.mo ORDER BY 1 - abs(k.x - g.c) / g.p DESC, g.set_ix) AS rn FROM k JOIN g ON g.window_id = k.window_id) WHERE rn = 1),
o AS (SELECT b.t + 1 AS target_t, b.mo, coalesce(m.mid, b.c) AS y FROM b LEFT JOIN m ON m.window_id = b.window_id AND m.i = b.set_ix)"""


@query(_INC.format(models=1) + " SELECT target_t, round(y, 6) AS yhat FROM o")
def incremental_windows(spark, d):
    s = series(spark, d)
    return rounded(incremental.predict(s, *incremental.train(s, 300, 100), 100).select("target_t", "yhat"), "yhat")


@query(_INC.format(models=3) + " SELECT target_t, round(sum(exp(-mo::DOUBLE) * y) / sum(exp(-mo::DOUBLE)), 6) AS yhat FROM o GROUP BY target_t")
def incremental_ensemble(spark, d):
    return rounded(incremental.incremental_ensemble(series(spark, d), 300, 100), "yhat")


# Cognitive maps: fixed weights against SQL, trained ones by rows.
_W = np.round(np.sin(np.arange(25).reshape(1, 5, 5) + 1), 3)
_B = np.round(np.cos(np.arange(5).reshape(1, 5)), 3)


def _fcm_sql():
    act = [f"1 / (1 + exp(-({_B[0, j]}::DOUBLE + " + " + ".join(f"m{i} * ({_W[0, i, j]}::DOUBLE)" for i in range(5)) + ")))" for j in range(5)]
    return (
        f"WITH {S}, {sets_sql(5)}, v AS (SELECT t, " + ", ".join(f"max(CASE WHEN set_ix = {i} THEN greatest(0, 1 - abs(x - c) / p) END) AS m{i}, max(CASE WHEN set_ix = {i} THEN c END) AS c{i}" for i in range(5))
        + " FROM s, g GROUP BY t), a AS (SELECT *, " + ", ".join(f"{e} AS a{j}" for j, e in enumerate(act)) + " FROM v) SELECT t + 1 AS target_t, round(("
        + " + ".join(f"a{j} * c{j}" for j in range(5)) + ") / greatest(1, " + " + ".join(f"a{j}" for j in range(5)) + "), 6) AS yhat FROM a"
    )


@query(_fcm_sql())
def cognitive_map_forecast(spark, d):
    s = series(spark, d)
    return rounded(cognitive_map.CognitiveMap(P.grid(s, "x", 5), _W, _B).forecast(s), "yhat")


@query()
def cognitive_map_gradient(spark, d):
    s = series(spark, d)
    return rounded(cognitive_map.train_gradient(s, P.grid(s, "x", 5), 2, epochs=5).forecast(s), "yhat")


@query()
def cognitive_map_genetic(spark, d):
    s = series(spark, d)
    return rounded(cognitive_map.train_genetic(s, P.grid(s, "x", 5), 1, generations=3, population=8).forecast(s), "yhat")


# Baselines.
@query(f"WITH {S}, o AS (SELECT s.t, s.x, q.x AS x1 FROM s JOIN s q ON q.t = s.t - 1), m AS (SELECT regr_slope(x, x1) AS b, regr_intercept(x, x1) AS a FROM o) SELECT t AS target_t, round(a + b * x1, 6) AS yhat FROM o, m")
def ar1(spark, d):
    s = series(spark, d)
    return rounded(baselines.fit_ar(s, 1).forecast(s).select("target_t", "yhat"), "yhat")


@query()
def arma21(spark, d):
    s = series(spark, d)
    fc = baselines.fit_ar(s, 2, 1).forecast(s)
    return fc.select("target_t", *(F.round(c, 4).alias(c) for c in ("yhat", "lower", "upper")))


@query()
def quantile_autoregression(spark, d):
    return rounded(baselines.quantile_forecast(series(spark, d)), "q05", "q50", "q95")


@query(f"WITH {S}, o AS (SELECT s.t, s.x, q.x AS x1 FROM s JOIN s q ON q.t = s.t - 1), n AS (SELECT q.t, o.x, row_number() OVER (PARTITION BY q.t ORDER BY abs(q.x1 - o.x1), o.t) AS rn FROM o q JOIN o ON o.t <> q.t) SELECT t AS target_t, round(avg(x), 6) AS yhat FROM n WHERE rn <= 30 GROUP BY t")
def knn_lag(spark, d):
    return rounded(baselines.knn(series(spark, d)), "yhat")


@query()
def gaussian_process(spark, d):
    return baselines.gaussian_process(series(spark, d), 200)

