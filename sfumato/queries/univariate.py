"""Queries of membership, partition, fuzzification, rules and univariate models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.functions.membership import membership
from sfumato.operators import partition as P
from sfumato.operators.fuzzify import clip, clip_universe, defuzzify, fired, fuzzify
from sfumato.operators.rules import nonrecurrent, transitions
from sfumato.operators.series import with_lags
from sfumato.plans import first_order as fo
from sfumato.plans import high_order as ho
from sfumato.queries.base import FUZZY, S, TRANS, rounded, series, sets_sql
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


def _grid(s: DataFrame, n: int = 10) -> P.Partition:
    return P.grid(s, "x", n)


@query(f"WITH {S}, {sets_sql()} SELECT set_ix, round(c - p, 6) AS lower, round(c, 6) AS centroid, round(c + p, 6) AS upper FROM g")
def grid_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grid(series(spark, d)).as_df(spark).select("set_ix", "lower", "centroid", "upper"), "lower", "centroid", "upper")


_MF = {
    "trimf": ((50.0, 100.0, 200.0), "CASE WHEN x < 50 OR x > 200 THEN 0 WHEN x < 100 THEN (x - 50) / 50 ELSE (200 - x) / 100 END"),
    "trapmf": ((50.0, 100.0, 150.0, 200.0), "CASE WHEN x < 50 OR x > 200 THEN 0 WHEN x < 100 THEN (x - 50) / 50 WHEN x <= 150 THEN 1 ELSE (200 - x) / 50 END"),
    "gaussmf": ((100.0, 25.0), "exp(-((x - 100) * (x - 100)) / (2.0 * 25 * 25))"),
    "bellmf": ((25.0, 2.0, 100.0), "1 / (1 + pow(abs((x - 100) / 25), 4))"),
    "sigmf": ((0.05, 100.0), "1 / (1 + exp(-0.05::DOUBLE * (x - 100)))"),
    "singleton": ((5.0,), "CASE WHEN x = 5 THEN 1 ELSE 0 END"),
}
for _mf, (_p, _sql) in _MF.items():

    def _membership(spark: SparkSession, d: str, mf=_mf, p=_p) -> DataFrame:
        src = series(spark, d) if mf != "singleton" else table(spark, d, "part").select(F.col("p_partkey").alias("t"), F.col("p_size").cast("double").alias("x"))
        return rounded(src.select("t", membership(mf, F.col("x"), p).alias("mu")), "mu")

    _src = S if _mf != "singleton" else "s AS (SELECT p_partkey AS t, CAST(p_size AS DOUBLE) AS x FROM part)"
    query(f"WITH {_src} SELECT t, round(CAST({_sql} AS DOUBLE), 6) AS mu FROM s", f"membership_{_mf}")(_membership)


@query(FUZZY + "SELECT t, set_ix, round(mu, 6) AS mu FROM f")
def fuzzify_sets(spark, d):
    s = series(spark, d)
    return rounded(fuzzify(s, _grid(s)).select("t", "set_ix", "mu"), "mu")


@query(FUZZY + "SELECT t, set_ix FROM a")
def fuzzify_max(spark, d):
    s = series(spark, d)
    return fuzzify(s, _grid(s), mode="maximum").select("t", "set_ix")


@query(FUZZY + "SELECT t, set_ix, round(mu, 6) AS mu FROM f WHERE mu >= 0.3")
def fuzzify_alpha(spark, d):
    s = series(spark, d)
    return rounded(fuzzify(s, _grid(s), alpha=0.3).select("t", "set_ix", "mu"), "mu")


@query(f"WITH {S}, {sets_sql()} SELECT t, set_ix, round(exp(-((x - c) * (x - c)) / (2 * (p / 3) * (p / 3))), 6) AS mu FROM s, g WHERE exp(-((x - c) * (x - c)) / (2 * (p / 3) * (p / 3))) >= 0.05")
def fuzzify_gauss(spark, d):
    s = series(spark, d)
    return rounded(fuzzify(s, P.grid(s, "x", 10, "gaussmf"), alpha=0.05).select("t", "set_ix", "mu"), "mu")


@query(f"WITH {S}, {sets_sql()}, v AS (SELECT t, set_ix, greatest(0, 1 - abs(x - c) / p) AS mu FROM s, g) SELECT t, round(max(mu), 6) AS top, round(sum(mu), 6) AS total FROM v GROUP BY t")
def fuzzify_vector(spark, d):
    s = series(spark, d)
    v = fuzzify(s, _grid(s), mode="vector")
    return rounded(v.select("t", F.array_max("mu").alias("top"), F.aggregate("mu", F.lit(0.0), lambda a, b: a + b).alias("total")), "top", "total")


@query(FUZZY + "SELECT t, round(sum(c * mu) / sum(mu), 6) AS y, round(avg(c), 6) AS y_sets FROM f GROUP BY t")
def defuzzify_values(spark, d):
    s = series(spark, d)
    p = _grid(s)
    f = fired(p, F.col("x"))
    return rounded(s.select("t", defuzzify(p, f).alias("y"), defuzzify(p, f, weighted=False).alias("y_sets")), "y", "y_sets")


@query(f"WITH {S}, {sets_sql()}, e AS (SELECT min(c - p) AS l, max(c + p) AS u, min(c) - min(p) AS lo, max(hi) AS hi FROM g) SELECT t, round(greatest(least(x * 3 - 400, u), l), 6) AS sets_clip, round(greatest(least(x * 3 - 400, hi), lo), 6) AS uod_clip FROM s, e")
def clip_values(spark, d):
    s = series(spark, d)
    p = _grid(s)
    x = F.col("x") * 3 - 400
    return rounded(s.select("t", clip(p, x).alias("sets_clip"), clip_universe(p, x).alias("uod_clip")), "sets_clip", "uod_clip")


@query(f"WITH {S}, {sets_sql()}, k AS (SELECT lo - p + i * ((hi - (lo - p)) / 99) AS bin FROM (SELECT min(lo) AS lo, min(p) AS p, min(hi) AS hi FROM g), range(0, 100) r(i)) SELECT set_ix, round(sum(greatest(0, 1 - abs(bin - c) / p)), 4) AS z FROM g, k GROUP BY set_ix")
def set_mass(spark, d):
    p = _grid(series(spark, d))
    return spark.createDataFrame(list(enumerate(p.mass())), "set_ix int, z double").withColumn("z", F.round("z", 4))


@query(TRANS + "SELECT t, i AS lhs, j AS rhs FROM tr")
def flr_recurrent(spark, d):
    s = series(spark, d)
    return transitions(s, _grid(s))


@query(TRANS + "SELECT i AS lhs, j AS rhs, min(t) AS first_t FROM tr GROUP BY i, j")
def flr_nonrecurrent(spark, d):
    s = series(spark, d)
    return nonrecurrent(transitions(s, _grid(s)))


@query("SELECT event_id + 1 AS target_t, value AS yhat FROM events")
def naive(spark, d):
    return series(spark, d).select((F.col("t") + 1).alias("target_t"), F.col("x").alias("yhat"))


_OUT = " SELECT a.t + 1 AS target_t, round(coalesce(m.mid, a.c), 6) AS yhat FROM a LEFT JOIN m ON m.i = a.set_ix"
_RULE_SQL = {
    "chen": "m AS (SELECT i, avg(c) AS mid FROM (SELECT DISTINCT i, j, c FROM tr) GROUP BY i)",
    "ismail_efendi": "m AS (SELECT i, avg(c) AS mid FROM tr GROUP BY i)",
    "tsaur": "m AS (SELECT i, avg(c) AS mid FROM tr GROUP BY i)",
    "yu": "k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS k FROM tr), m AS (SELECT i, sum(k * c) / sum(k) AS mid FROM k GROUP BY i)",
    "cheng": "k AS (SELECT *, row_number() OVER (PARTITION BY i, sign(j - i) ORDER BY t) AS k FROM tr), m AS (SELECT i, sum(k * c) / sum(k) AS mid FROM k GROUP BY i)",
    "sadaei": "k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t DESC) - 1 AS k FROM tr), m AS (SELECT i, sum(pow(1.1::DOUBLE, -k) * c) / sum(pow(1.1::DOUBLE, -k)) AS mid FROM k GROUP BY i)",
}
for _name, _sql in _RULE_SQL.items():

    def _first(spark: SparkSession, d: str, method=_name) -> DataFrame:
        s = series(spark, d)
        return rounded(fo.fit(s, _grid(s), method).predict(s), "yhat")

    query(TRANS + ", " + _sql + _OUT, _name)(_first)


@query(FUZZY + ", tr AS (SELECT q.t, q.set_ix AS i, w.set_ix AS j, w.c FROM a q JOIN a w ON w.t = q.t + 3), " + _RULE_SQL["chen"] + _OUT.replace("+ 1", "+ 3"))
def chen_h3(spark, d):
    s = series(spark, d)
    return rounded(fo.fit(s, _grid(s), "chen", h=3).predict(s), "yhat")


@query(TRANS + ", " + _RULE_SQL["chen"] + """,
y1 AS (SELECT g.set_ix, coalesce(m.mid, g.c) AS y FROM g LEFT JOIN m ON m.i = g.set_ix),
nx AS (SELECT set_ix, nxt FROM (SELECT y1.set_ix, g.set_ix AS nxt, row_number() OVER (PARTITION BY y1.set_ix ORDER BY round(greatest(0, 1 - abs(y1.y - g.c) / g.p), 9) DESC, g.set_ix) AS rn FROM y1, g) WHERE rn = 1),
st AS (SELECT set_ix, 1 AS horizon, set_ix AS at FROM g UNION ALL SELECT n1.set_ix, 2, n1.nxt FROM nx n1 UNION ALL SELECT n1.set_ix, 3, n2.nxt FROM nx n1 JOIN nx n2 ON n2.set_ix = n1.nxt)
SELECT a.t + st.horizon AS target_t, CAST(st.horizon AS INTEGER) AS horizon, round(y1.y, 6) AS yhat FROM a JOIN st ON st.set_ix = a.set_ix JOIN y1 ON y1.set_ix = st.at""")
def chen_ahead(spark, d):
    s = series(spark, d)
    return rounded(fo.ahead(fo.fit(s, _grid(s), "chen"), s, 3), "yhat")


@query(TRANS + """, mm AS (SELECT q.set_ix AS s, w.set_ix AS i, 1 - abs(w.c - q.c) / q.p AS mu FROM g q, g w WHERE abs(q.set_ix - w.set_ix) < 1),
r AS (SELECT ml.i, mr.i AS j, max(least(ml.mu, mr.mu)) AS r FROM (SELECT DISTINCT i, j FROM tr) d JOIN mm ml ON ml.s = d.i JOIN mm mr ON mr.s = d.j GROUP BY 1, 2),
y AS (SELECT f.t, r.j, max(least(f.mu, r.r)) AS y FROM f JOIN r ON r.i = f.set_ix GROUP BY f.t, r.j),
z AS (SELECT *, max(y) OVER (PARTITION BY t) AS best FROM y), o AS (SELECT z.t, avg(g.c) AS yhat FROM z JOIN g ON g.set_ix = z.j WHERE y = best AND y > 0 GROUP BY z.t)
SELECT a.t + 1 AS target_t, round(coalesce(o.yhat, a.c), 6) AS yhat FROM a LEFT JOIN o ON o.t = a.t""")
def song(spark, d):
    s = series(spark, d)
    p = _grid(s)
    return rounded(fo.song_predict(s, fo.song_rules(transitions(s, p), p), p), "yhat")


# High order: paths of fired sets, oldest first.
def _paths_sql(lags, n=6) -> str:
    o = sorted(lags, reverse=True)
    key = " || '-' || ".join(f"f{k}.set_ix" for k in o)
    mn = f"least({', '.join(f'f{k}.mu' for k in o)})" if len(o) > 1 else f"f{o[0]}.mu"
    frm = f"(SELECT t FROM s UNION ALL SELECT max(t) + 1 FROM s) tt " + " ".join(f"JOIN f f{k} ON f{k}.t = tt.t - {k}" for k in o)
    new = o[-1]
    return (
        f"WITH {S}, {sets_sql(n)}, {_FUZZY_ONLY}, pa AS (SELECT tt.t, {key} AS path, {mn} AS mu_min, {' * '.join(f'f{k}.mu' for k in o)} AS mu_prod, "
        f"f{new}.c AS nc, f{new}.l AS nl, f{new}.u AS nu, ({' + '.join(f'f{k}.c' for k in o)}) / {len(o)} AS mc FROM {frm}), "
        "pr AS (SELECT pa.*, f.set_ix AS j, f.mu AS rmu, f.c, f.l, f.u FROM pa JOIN f ON f.t = pa.t)"
    )


_FUZZY_ONLY = "f AS (SELECT t, x, set_ix, c, c - p AS l, c + p AS u, 1 - abs(x - c) / p AS mu FROM s, g WHERE 1 - abs(x - c) / p > 0)"
_PLAIN = ", m AS (SELECT path, avg(c) AS mid, min(l) AS lower, max(u) AS upper FROM (SELECT DISTINCT path, j, c, l, u FROM pr) GROUP BY path)"
_FREQ = ", m AS (SELECT path, avg(c) AS mid, avg(l) AS lower, avg(u) AS upper FROM pr GROUP BY path)"


def _high(weighted: bool, lags: tuple[int, ...], cols: tuple[str, ...], mode: str = "mean"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = series(spark, d)
        p = _grid(s, 6)
        return rounded(ho.forecast(s, p, ho.rules(s, p, lags, weighted), lags, mode).select("target_t", *cols), *cols)

    y = {
        "yhat": "round(avg(coalesce(m.mid, pa.nc)), 6) AS yhat" if mode == "mean" else "round(sum(mu_min * coalesce(m.mid, pa.nc)) / sum(mu_min), 6) AS yhat",
        "lower": "round(sum(mu_min * coalesce(m.lower, pa.nl)) / sum(mu_min), 6) AS lower",
        "upper": "round(sum(mu_min * coalesce(m.upper, pa.nu)) / sum(mu_min), 6) AS upper",
    }
    sql = _paths_sql(lags) + (_FREQ if weighted else _PLAIN) + f" SELECT pa.t AS target_t, {', '.join(y[c] for c in cols)} FROM pa LEFT JOIN m ON m.path = pa.path GROUP BY pa.t"
    return run, sql


for _name, _args in {
    "hofts2": (False, (1, 2), ("yhat",)), "hofts2_weighted_mean": (False, (1, 2), ("yhat",), "weighted"), "whofts2": (True, (1, 2), ("yhat",)),
    "whofts_lags_1_3": (True, (1, 3), ("yhat",)), "ifts": (False, (1, 2), ("lower", "upper")), "wifts": (True, (1, 2), ("lower", "upper")),
}.items():
    _f, _sql = _high(*_args)
    query(_sql, _name)(_f)


@query(FUZZY.replace("range(0, 10)", "range(0, 6)").replace("/ 9", "/ 5") + """, h AS (SELECT s.t, g.set_ix, g.c, greatest(0, 1 - abs(s.x - g.c) / g.p) AS mu FROM s, g),
r AS (SELECT q.t, q.c, q.mu * greatest(q.mu, w.mu) AS r FROM h q JOIN h w ON w.t = q.t - 1 AND w.set_ix = q.set_ix), b AS (SELECT *, max(r) OVER (PARTITION BY t) AS best FROM r)
SELECT t + 1 AS target_t, round(avg(c), 6) AS yhat FROM b WHERE r = best GROUP BY t""".replace("b AS (SELECT *", "bb AS (SELECT *").replace("FROM b WHERE", "FROM bb WHERE"))
def hwang3(spark, d):
    s = series(spark, d)
    return rounded(ho.hwang(s, _grid(s, 6), 3), "yhat")


_MASS = _paths_sql((1,)) + ", ma AS (SELECT path, j, c, l, u, sum(mu_prod * rmu) AS mass FROM pr GROUP BY path, j, c, l, u)"
_GROUPS = _MASS + """, gr AS (SELECT path, sum(mass) AS f, sum(mass * c) / sum(mass) AS mid, sum(mass * l) / sum(mass) AS lower, sum(mass * u) / sum(mass) AS upper FROM ma GROUP BY path),
gp AS (SELECT *, f / sum(f) OVER () AS p FROM gr)"""


@query(_MASS + " SELECT CAST(path AS INTEGER) AS lhs, j AS rhs, round(mass, 4) AS mass FROM ma")
def pwfts_rules(spark, d):
    s = series(spark, d)
    m = ho.pwfts_rules(s, _grid(s, 6), (1,))
    return m.select(F.col("path")[0].alias("lhs"), F.col("rhs_ix").alias("rhs"), F.round("mass", 4).alias("mass"))


def _pwfts(lags, cols):
    def run(spark, d):
        s = series(spark, d)
        p = _grid(s, 6)
        return rounded(ho.pwfts_point(s, p, ho.pwfts_groups(ho.pwfts_rules(s, p, lags), p), lags).select("target_t", *cols), *cols)

    norm = "CASE WHEN mu_prod * coalesce(gp.p, 1) > 0 THEN mu_prod * coalesce(gp.p, 1) ELSE coalesce(gp.p, 1) END"
    head = _GROUPS.replace(_paths_sql((1,)), _paths_sql(lags))
    of = {"yhat": "coalesce(gp.mid, pa.mc)", "lower": "gp.lower", "upper": "gp.upper"}
    sql = head + " SELECT pa.t AS target_t, " + ", ".join(f"round(sum({norm} * {of[c]}) / sum({norm}), 6) AS {c}" for c in cols) + " FROM pa LEFT JOIN gp ON gp.path = pa.path GROUP BY pa.t"
    return run, sql


for _name, _args in {"pwfts_point": ((1,), ("yhat",)), "pwfts_interval": ((1,), ("lower", "upper")), "pwfts2_point": ((1, 2), ("yhat",))}.items():
    _f, _sql = _pwfts(*_args)
    query(_sql, _name)(_f)

_DIST = _GROUPS + """, uo AS (SELECT min(lo) - min(p) AS lo, min(hi) AS hi FROM g), bi AS (SELECT CAST(i AS INTEGER) AS bin_ix, lo + i * ((hi - lo) / 19) AS bin FROM uo, range(0, 20) r(i)),
sb AS (SELECT set_ix, bin_ix, bin, greatest(0, 1 - abs(bin - c) / p) AS d FROM g, bi), z AS (SELECT set_ix, sum(d) AS z FROM sb GROUP BY set_ix),
rb AS (SELECT ma.path, sb.bin_ix, sb.bin, sum(ma.mass / gp.f * sb.d / z.z) AS w FROM ma JOIN gp ON gp.path = ma.path JOIN sb ON sb.set_ix = ma.j AND sb.d > 0 JOIN z ON z.set_ix = ma.j GROUP BY 1, 2, 3),
hi AS (SELECT pa.t, pa.path, pa.mu_prod * gp.p / z.z AS m FROM pa JOIN gp ON gp.path = pa.path JOIN z ON z.set_ix = CAST(pa.path AS INTEGER)),
ha AS (SELECT *, sum(m) OVER (PARTITION BY t) AS al FROM hi),
di AS (SELECT ha.t AS target_t, rb.bin_ix, rb.bin, sum(ha.m * rb.w / ha.al) AS density FROM ha JOIN rb ON rb.path = ha.path GROUP BY 1, 2, 3)"""


@query(_DIST + " SELECT target_t, bin_ix, round(bin, 6) AS bin, round(density, 6) AS density FROM di")
def pwfts_distribution(spark, d):
    s = series(spark, d)
    p = _grid(s, 6)
    return rounded(ho.pwfts_distribution(s, p, ho.pwfts_rules(s, p, (1,)), (1,), 20), "bin", "density")


@query(_DIST + """, cd AS (SELECT *, sum(density) OVER (PARTITION BY target_t ORDER BY bin_ix) AS cdf FROM di)
SELECT target_t, round(min(CASE WHEN cdf >= 0.05 - 1e-12 THEN bin END), 6) AS q05, round(min(CASE WHEN cdf >= 0.95 - 1e-12 THEN bin END), 6) AS q95 FROM cd GROUP BY target_t""")
def pwfts_quantile(spark, d):
    s = series(spark, d)
    p = _grid(s, 6)
    return rounded(ho.quantiles(ho.pwfts_distribution(s, p, ho.pwfts_rules(s, p, (1,)), (1,), 20), (0.05, 0.95)), "q05", "q95")


@query(_DIST + " SELECT target_t, round(sum(bin * density), 6) AS yhat FROM di GROUP BY target_t")
def pwfts_expected(spark, d):
    s = series(spark, d)
    p = _grid(s, 6)
    dist = ho.pwfts_distribution(s, p, ho.pwfts_rules(s, p, (1,)), (1,), 20)
    return rounded(dist.groupBy("target_t").agg(F.sum(F.col("bin") * F.col("density")).alias("yhat")), "yhat")


@query(_GROUPS + " SELECT CAST(gp.path AS INTEGER) AS lhs, round(gp.p, 6) AS p, " + ", ".join(f"round(coalesce(sum(CASE WHEN ma.j = {i} THEN ma.mass / gp.f END), 0), 6) AS to_{i}" for i in range(6)) + " FROM gp JOIN ma ON ma.path = gp.path GROUP BY gp.path, gp.p")
def markov_matrix(spark, d):
    s = series(spark, d)
    p = _grid(s, 6)
    m = ho.markov_matrix(ho.pwfts_rules(s, p, (1,)), p)
    return rounded(m, "p", *(f"to_{i}" for i in range(6)))


# Other partitioners.
@query(f"""WITH {S}, {sets_sql()}, d AS (SELECT abs(sum(coalesce(x - px, 0)) / count(*) / 2) AS d FROM (SELECT x, lag(x) OVER (ORDER BY t) AS px FROM s)),
h AS (SELECT CASE WHEN d <= 1 THEN 0.1::DOUBLE WHEN d <= 10 THEN 1 WHEN d <= 100 THEN 10 ELSE 100 END AS base FROM d)
SELECT CAST(k AS INTEGER) AS set_ix, round(ceil(b.lo) + k * base, 6) AS centroid FROM b, h, LATERAL (SELECT unnest(range(0, CAST(ceil((b.hi - b.lo) / base) AS BIGINT))) AS k)""")
def huarng_sets(spark, d):
    return rounded(P.huarng(series(spark, d), "x", "t").as_df(spark).select("set_ix", "centroid"), "centroid")


@query("SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS set_ix, CAST(x AS DOUBLE) AS centroid FROM (SELECT DISTINCT p_size AS x FROM part)")
def singleton_sets(spark, d):
    return P.singletons(table(spark, d, "part"), "p_size").as_df(spark).select("set_ix", "centroid")


@query("SELECT CAST(i AS INTEGER) AS set_ix, n AS name, CAST(i AS DOUBLE) AS centroid FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R')) v(i, n)")
def class_sets(spark, d):
    return P.classes({"A": 0, "N": 1, "R": 2}).as_df(spark).select("set_ix", "name", "centroid")


def _sets(build):
    return lambda spark, d: build(series(spark, d)).as_df(spark).select("set_ix", "name", "lower", "centroid", "upper")


for _name, _build in {
    "entropy_sets": lambda s: P.entropy(s, "x", 10), "fcm_sets": lambda s: P.fcm(s, "x", 10), "cmeans_sets": lambda s: P.cmeans(s, "x", 10),
    "subclust_sets": lambda s: P.subclust(s, "x"),
}.items():
    query(None, _name)(_sets(_build))


@query()
def explore_partitioners(spark, d):
    s = series(spark, d)
    b = {f"grid_{m}": (lambda df, x, m=m: P.grid(df, x, 10, m)) for m in ("trimf", "trapmf", "gaussmf")} | {"entropy": P.entropy, "cmeans": P.cmeans}
    return rounded(P.explore(s, "x", b).select("partitioner", "set_ix", "name", "mf", "lower", "centroid", "upper"), "lower", "centroid", "upper")


@query("SELECT e.event_id AS t, round(e.value - coalesce(q.value, e.value), 6) AS d1 FROM events e LEFT JOIN events q ON q.event_id = e.event_id - 1", "lag_blocks")
def _lag_blocks(spark, d):
    """The blocked lag against a join."""
    s = with_lags(series(spark, d), ["x"], [1], block=1000)
    return s.select("t", F.round(F.col("x") - F.coalesce("x_1", "x"), 6).alias("d1"))


