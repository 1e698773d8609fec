"""Queries of transformations, distributions and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sfumato.functions.scalars import KERNELS
from sfumato.operators import distribution as D
from sfumato.operators import measures as M
from sfumato.operators import partition as P
from sfumato.operators import transform as T
from sfumato.plans import first_order as fo
from sfumato.plans import high_order as ho
from sfumato.queries.base import S, rounded, series
from sfumato.queries.univariate import _FREQ, _RULE_SQL, TRANS, _paths_sql
from sfumato.queries.univariate import SQL as UNI
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


L = "(PARTITION BY 0 ORDER BY t)"
_SRC = f"WITH {S}"


def _tx(name, sql, f):
    query(f"{_SRC} {sql}", name)(lambda spark, d: rounded(f(series(spark, d)).select("t", F.col("y").cast("double").alias("y")), "y"))


_tx("difference", f"SELECT t, round(coalesce(x - lag(x) OVER {L}, 0), 6) AS y FROM s", lambda s: T.difference(s))
_tx("difference_inverse", "SELECT t, round(x, 6) AS y FROM s", lambda s: T.undifference(T.difference(s), "y").withColumn("y", F.col("x_back")))
_tx("scale", ", m AS (SELECT min(x) AS a, max(x) AS b FROM s) SELECT t, round((x - a) / (b - a), 6) AS y FROM s, m", lambda s: T.scale(s))
_tx("scale_inverse", "SELECT t, round(x, 6) AS y FROM s", lambda s: T.scale(s).withColumn("y", T.unscale(F.col("y"), F.col("x_min"), F.col("x_max"))))
_tx("normalize", ", m AS (SELECT avg(x) AS a, stddev_pop(x) AS b FROM s) SELECT t, round((x - a) / b, 6) AS y FROM s, m", lambda s: T.normalize(s))
_tx("boxcox", "SELECT t, round((pow(x, 0.5::DOUBLE) - 1) / 0.5::DOUBLE, 6) AS y FROM s", lambda s: s.withColumn("y", T.boxcox(F.col("x"), 0.5)))
_tx("boxcox_log", "SELECT t, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS y FROM s", lambda s: s.withColumn("y", T.boxcox(F.col("x"), 0)))
_tx("boxcox_inverse", "SELECT t, round(x, 6) AS y FROM s", lambda s: s.withColumn("y", T.unboxcox(T.boxcox(F.col("x"), 0.5), 0.5)))
_tx("roi", f"SELECT t, round(CASE WHEN lag(x) OVER {L} IS NULL THEN 0 WHEN lag(x) OVER {L} <> 0 THEN (x - lag(x) OVER {L}) / lag(x) OVER {L} END, 6) AS y FROM s", lambda s: T.roi(s))
_tx("roi_inverse", "SELECT t, round(x, 6) AS y FROM s", lambda s: T.unroi(T.roi(s), "y").withColumn("y", F.col("x_back")))
_tx("moving_average", f"SELECT t, round(CASE WHEN t < 2 THEN x ELSE (lag(x, 2) OVER {L} + lag(x) OVER {L}) / 2 END, 6) AS y FROM s", lambda s: T.moving_average(s, 2))
_tx("exponential_smoothing", "SELECT t, round(" + " + ".join([f"x * {1 / 3}::DOUBLE"] + [f"coalesce(lag(x, {k}) OVER {L}, 0) * {1 / 3 * (1 - 1 / 3)**k}::DOUBLE" for k in range(1, 5)]) + ", 6) AS y FROM s", lambda s: T.exponential_smoothing(s, 5, 1 / 3))
_tx("average_pooling", "SELECT t, round(coalesce(avg(x) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), x), 6) AS y FROM s", lambda s: T.pooling(s, "avg", 5))
_tx("max_pooling", "SELECT t, y FROM (SELECT t, round(coalesce(max(x) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), x), 6) AS y FROM s) WHERE t % 3 = 0", lambda s: T.pooling(s, "max", 5, 3))
_tx("linear_trend", ", m AS (SELECT regr_slope(x, t) AS a, regr_intercept(x, t) AS b FROM s) SELECT t, round(x - (t * a + b), 6) AS y FROM s, m", lambda s: T.linear_trend(s))
_tx("linear_trend_inverse", "SELECT t, round(x, 6) AS y FROM s", lambda s: T.linear_trend(s).withColumn("y", T.retrend(F.col("y"), F.col("t"), F.col("slope"), F.col("intercept"))))
_tx("adaptive_expectation", f"SELECT t, round(coalesce(lag(x) OVER {L}, x) + 0.5::DOUBLE * (x - coalesce(lag(x) OVER {L}, x)), 6) AS y FROM s",
    lambda s: T.undifference(T.difference(s), "y").withColumn("y", T.adaptive_expectation(F.col("x") - F.col("y"), F.col("x"))))
_tx("running_sum", f"SELECT t, round(sum(x) OVER {L}, 4) AS y FROM s", lambda s: T.running_sum(s, "x", "y", block=1000).withColumn("y", F.round("y", 4)))


@query()
def pca_projection(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return T.pca(s, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2).select("l_orderkey", "l_linenumber", "pc1", "pc2")


# Measures of the first-order model.
def _chen(spark, d):
    s = series(spark, d)
    return M.actuals(s, fo.fit(s, P.grid(s, "x", 10), "chen").predict(s))


_Y = TRANS + ", " + _RULE_SQL["chen"] + ", fc AS (SELECT a.t + 1 AS target_t, coalesce(m.mid, a.c) AS f FROM a LEFT JOIN m ON m.i = a.set_ix), yy AS (SELECT target_t, f, s.x AS y FROM fc JOIN s ON s.t = fc.target_t) "
_POINT = {
    "rmse": "sqrt(avg((y - f) * (y - f)))", "nrmse": "sqrt(avg((y - f) * (y - f))) / (max(y) - min(y))", "mae": "avg(abs(y - f))", "mape": "avg(abs((y - f) / nullif(y, 0))) * 100",
    "smape1": "avg(abs(y - f) / nullif((abs(y) + abs(f)) / 2, 0))", "smape2": "avg(abs(y - f) / nullif(abs(y) + abs(f), 0)) * 100", "smape3": "sum(abs(y - f)) / sum(y + f)",
    "theil_inequality": "sqrt(sum((y - f) * (y - f))) / (sqrt(sum(y * y)) + sqrt(sum(f * f)))",
}


@query(_Y + "SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _POINT.items()) + " FROM yy")
def point_measures(spark, d):
    return rounded(M.point(_chen(spark, d)), *_POINT)


@query(_Y + ", z AS (SELECT *, lead(y) OVER (ORDER BY target_t) AS ny FROM yy) SELECT round(sqrt(sum(pow(f - y, 2)) / sum(pow(ny - y, 2))), 6) AS u FROM z WHERE ny IS NOT NULL")
def theil_u(spark, d):
    return rounded(M.theil_u(_chen(spark, d)), "u")


@query(UNI["chen_ahead"].split("SELECT a.t + st.horizon")[0] + ", fc AS (SELECT a.t + st.horizon AS target_t, CAST(st.horizon AS INTEGER) AS horizon, y1.y AS f FROM a JOIN st ON st.set_ix = a.set_ix JOIN y1 ON y1.set_ix = st.at), yy AS (SELECT fc.*, s.x AS y FROM fc JOIN s ON s.t = fc.target_t) SELECT horizon, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse FROM yy GROUP BY horizon")
def ahead_measures(spark, d):
    s = series(spark, d)
    fc = fo.ahead(fo.fit(s, P.grid(s, "x", 10), "chen"), s, 3)
    return rounded(M.point(M.actuals(s, fc), ["horizon"]).select("horizon", "rmse"), "rmse")


_IV = _paths_sql((1, 2)) + _FREQ + """, fc AS (SELECT pa.t, sum(mu_min * coalesce(m.lower, pa.nl)) / sum(mu_min) AS lo, sum(mu_min * coalesce(m.upper, pa.nu)) / sum(mu_min) AS up FROM pa LEFT JOIN m ON m.path = pa.path GROUP BY pa.t),
yy AS (SELECT fc.*, s.x AS y FROM fc JOIN s ON s.t = fc.t), sh AS (SELECT avg(up - lo) AS w FROM yy) """


def _pin(tau):
    f = "lo" if tau <= 0.5 else "up"
    return f"avg(CASE WHEN y >= {f} THEN {tau}::DOUBLE * (y - {f}) ELSE (1 - {tau}::DOUBLE) * ({f} - y) END)"


def _wink(tau):
    return f"avg(up - lo + CASE WHEN y < lo THEN 2 * (lo - y) / {tau}::DOUBLE WHEN y > up THEN 2 * (y - up) / {tau}::DOUBLE ELSE 0 END)"


_INT = {"sharpness": "avg(up - lo)", "resolution": "avg(abs(up - lo - w))", "coverage": "avg(CASE WHEN y BETWEEN lo AND up THEN 1.0::DOUBLE ELSE 0 END)"}
_INT |= {f"pinball{round(t * 100):02d}": _pin(t) for t in (0.05, 0.25, 0.75, 0.95)} | {f"winkler{round(t * 100):02d}": _wink(t) for t in (0.05, 0.25)}


@query(_IV + "SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _INT.items()) + " FROM yy, sh")
def interval_measures(spark, d):
    s = series(spark, d)
    p = P.grid(s, "x", 6)
    fc = ho.forecast(s, p, ho.rules(s, p, (1, 2), True), (1, 2))
    return rounded(M.interval(M.actuals(s, fc)), *_INT)


_DISTQ = UNI["pwfts_distribution"].split(" SELECT target_t, bin_ix, round(bin, 6)")[0]


@query(_DISTQ + """, ac AS (SELECT s.t AS target_t, s.x AS y, CAST(least(greatest(ceil((s.x - lo) / ((hi - lo) / 19)), 0), 19) AS INTEGER) AS tb FROM s, uo WHERE s.t IN (SELECT target_t FROM di)),
fu AS (SELECT ac.target_t, ac.tb, bi.bin_ix, coalesce(di.density, 0) AS density FROM ac CROSS JOIN bi LEFT JOIN di ON di.target_t = ac.target_t AND di.bin_ix = bi.bin_ix),
cd AS (SELECT *, sum(density) OVER (PARTITION BY target_t ORDER BY bin_ix) AS cdf FROM fu),
ea AS (SELECT target_t, sum(pow(cdf - CASE WHEN bin_ix >= tb THEN 1 ELSE 0 END, 2)) AS crps, sum(CASE WHEN bin_ix = tb THEN pow(density - 1, 2) ELSE pow(density, 2) END) AS brier, sum(CASE WHEN bin_ix = tb THEN density END) AS hit FROM cd GROUP BY target_t)
SELECT round(avg(crps), 6) AS crps, round(avg(brier), 6) AS brier, round(avg(CASE WHEN hit > 0 THEN -ln(hit) END), 6) AS log_score FROM ea""")
def distribution_measures(spark, d):
    s = series(spark, d)
    p = P.grid(s, "x", 6)
    dist = ho.pwfts_distribution(s, p, ho.pwfts_rules(s, p, (1,)), (1,), 20)
    return rounded(M.distribution(s.select(F.col("t").alias("target_t"), F.col("x").alias("y")), dist, 20, p.lo, p.hi), "crps", "brier", "log_score")


_ACF = f"WITH {S}, m AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM s), r AS (SELECT CAST(k AS INTEGER) AS lag, sum((a.x - m) * (b.x - m)) / ((any_value(n) - k) * any_value(v)) AS r, any_value(n) AS n FROM range(1, 6) q(k), m, s a JOIN s b ON b.t = a.t + k GROUP BY k) "


@query(_ACF + "SELECT lag, round(r, 6) AS r FROM r")
def acf(spark, d):
    return rounded(M.acf(series(spark, d), range(1, 6)), "r")


@query(_ACF + "SELECT round(any_value(n) * sum(r * r), 4) AS box_pierce, round(any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)), 4) AS ljung_box, round(any_value(n) * (any_value(n) - 2) * sum(r * r / (n - lag)), 4) AS as_coded FROM r")
def portmanteau(spark, d):
    s = series(spark, d)
    n, r = s.count(), [x["r"] for x in M.acf(s, range(1, 6)).orderBy("lag").collect()]
    a, b = M.portmanteau(r, n), M.portmanteau(r, n, as_coded=True)
    return rounded(spark.createDataFrame([(a["box_pierce"], a["ljung_box"], b["ljung_box"])], "box_pierce double, ljung_box double, as_coded double"), ).select(
        *(F.round(c, 4).alias(c) for c in ("box_pierce", "ljung_box", "as_coded")))


@query()
def residual_analysis(spark, d):
    r = M.residuals(_chen(spark, d))
    one = spark.createDataFrame([(r["mean"], r["std"], r["q"], r["p"], r["h0"])], "mean double, std double, q double, p double, h0 string")
    return rounded(one, "mean", "std", "p").withColumn("q", F.round("q", 4))


_HIST = f"WITH {S}, hb AS (SELECT CAST(least(greatest(ceil(x / (500.0::DOUBLE / 49)), 0), 49) AS INTEGER) AS bin_ix, count(*) AS n FROM s GROUP BY 1), hd AS (SELECT bin_ix, bin_ix * (500.0::DOUBLE / 49) AS bin, n / sum(n) OVER () AS density FROM hb)"


def _hist(spark, d):
    return D.histogram(series(spark, d), "x", 0.0, 500.0, 50)


@query(_HIST + " SELECT bin_ix, round(bin, 6) AS bin, round(density, 6) AS density FROM hd")
def hist_density(spark, d):
    return rounded(_hist(spark, d), "bin", "density")


@query(_HIST + " SELECT round(sum(bin * density), 6) AS expected, round(sum(-density * ln(density)), 6) AS entropy FROM hd")
def hist_functionals(spark, d):
    return rounded(D.functionals(_hist(spark, d)), "expected", "entropy")


@query(_HIST + " SELECT bin_ix, round(sum(density) OVER (ORDER BY bin_ix), 6) AS cdf FROM hd")
def hist_cdf(spark, d):
    return rounded(D.cdf(_hist(spark, d)).select("bin_ix", "cdf"), "cdf")


@query(_HIST + ", c AS (SELECT *, sum(density) OVER (ORDER BY bin_ix) AS cdf FROM hd) SELECT round(min(CASE WHEN cdf >= 0.1 THEN bin END), 6) AS q10, round(min(CASE WHEN cdf >= 0.9 THEN bin END), 6) AS q90 FROM c")
def hist_quantile(spark, d):
    return rounded(D.quantile(_hist(spark, d), (0.1, 0.9)), "q10", "q90")


@query(_HIST + ", o AS (SELECT CAST(least(greatest(ceil(o_totalprice / 1000 / (500.0::DOUBLE / 49)), 0), 49) AS INTEGER) AS bin_ix, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT bin_ix, n / sum(n) OVER () AS q FROM o) SELECT round(sum(-density * ln(q)), 6) AS cross_entropy, round(sum(density * ln(density / q)), 6) AS kl FROM hd JOIN q ON q.bin_ix = hd.bin_ix")
def entropy_kl(spark, d):
    q = D.histogram(table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("x")), "x", 0.0, 500.0, 50)
    return rounded(D.divergence(_hist(spark, d), q), "cross_entropy", "kl")


@query(_HIST + ", c AS (SELECT hb.n, ln(hd.density) AS l FROM hb JOIN hd ON hd.bin_ix = hb.bin_ix) SELECT round(sum(n * l) / sum(n), 6) AS empirical, round(sum(l), 4) AS pseudo, CAST(sum(n) AS BIGINT) AS n FROM c")
def log_likelihood(spark, d):
    o = D.log_likelihood(series(spark, d), "x", _hist(spark, d), 0.0, 500.0, 50)
    return o.select(F.round("empirical", 6).alias("empirical"), F.round("pseudo", 4).alias("pseudo"), "n")


_K = {
    "epanechnikov": "CASE WHEN abs(u) <= 1 THEN 0.75::DOUBLE * (1 - u * u) ELSE 0 END", "gaussian": "exp(-u * u / 2.0) / sqrt(2 * pi())",
    "uniform": "CASE WHEN abs(u) <= 1 THEN 0.5::DOUBLE ELSE 0 END", "triangular": "CASE WHEN abs(u) <= 1 THEN 1 - abs(u) ELSE 0 END", "logistic": "1 / (exp(u) + 2 + exp(-u))",
    "cosine": "CASE WHEN abs(u) <= 1 THEN pi() / 4 * cos(pi() / 2 * u) ELSE 0 END", "sigmoid": "2 / pi() / (exp(u) + exp(-u))", "tophat": "CASE WHEN abs(u) < 0.5 THEN 1.0::DOUBLE ELSE 0 END",
    "exponential": "0.5::DOUBLE * exp(-abs(u))",
}
for _k, _e in _K.items():
    query(f"WITH {S}, k AS (SELECT CAST(i AS INTEGER) AS bin_ix, i * (500.0::DOUBLE / 19) AS bin FROM range(0, 20) r(i)), e AS (SELECT bin_ix, bin, (bin - x) / 20 AS u FROM k, s) SELECT bin_ix, round(sum({_e}) / (count(*) * 20), 9) AS density FROM e GROUP BY bin_ix", f"kde_{_k}")(
        lambda spark, d, k=_k: D.kde(series(spark, d), "x", 20.0, 0.0, 500.0, 20, k).select("bin_ix", F.round("density", 9).alias("density")))
assert set(_K) == set(KERNELS)


@query("WITH k AS (SELECT CAST(i AS INTEGER) AS bin_ix, i * (500.0::DOUBLE / 49) AS bin FROM range(0, 50) r(i)), e AS (SELECT value - 20 AS lo, value + 20 AS up FROM events), c AS (SELECT bin_ix, count(lo) AS n FROM k LEFT JOIN e ON k.bin >= e.lo AND k.bin <= e.up GROUP BY bin_ix) SELECT bin_ix, round(n / sum(n) OVER (), 6) AS density FROM c")
def interval_mass(spark, d):
    s = series(spark, d).select((F.col("x") - 20).alias("lo"), (F.col("x") + 20).alias("up"))
    return rounded(D.interval_mass(s, "lo", "up", 0.0, 500.0, 50).select("bin_ix", "density"), "density")


@query(_HIST + ", k AS (SELECT CAST(i AS INTEGER) AS bin_ix FROM range(0, 50) r(i)) SELECT k.bin_ix, round(coalesce(hd.density, 0) * 0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN k.bin_ix = 10 THEN 1 ELSE 0 END, 6) AS density FROM k LEFT JOIN hd ON hd.bin_ix = k.bin_ix WHERE hd.bin_ix IS NOT NULL OR k.bin_ix = 10")
def mixture(spark, d):
    return rounded(D.mixture([(0.7, _hist(spark, d)), (0.3, D.from_point(spark, 100.0, 0.0, 500.0, 50))]).select("bin_ix", "density"), "density")


_BM = "b AS (SELECT DISTINCT id, dataset, model, value FROM benchmarks WHERE lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) = 'rmse' AND isfinite(value) AND dataset IS NOT NULL), m AS (SELECT dataset, model, min(value) AS v FROM b GROUP BY dataset, model)"


@query(f"WITH {_BM}, e AS (SELECT dataset, model, round(v - avg(v) OVER (PARTITION BY dataset), 6) AS e FROM m), r AS (SELECT model, (rank() OVER (ORDER BY e) + rank() OVER (ORDER BY e) + count(*) OVER (PARTITION BY e) - 1) / 2.0::DOUBLE AS r FROM e) SELECT model, round(avg(r), 1) AS mean_rank FROM r GROUP BY model")
def friedman_aligned(spark, d):
    from sfumato.operators.entries import entries, measure_key, valid

    b = table(spark, d, "benchmarks").where((measure_key("measure") == "rmse") & valid("value") & F.col("dataset").isNotNull())
    m = entries(b, "dataset", "model", "value").groupBy("dataset", "model").agg(F.min("value").alias("value"))
    return M.friedman_aligned(m).select("model", F.round("mean_rank", 1).alias("mean_rank"))


