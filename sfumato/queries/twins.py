"""SQL twins of recursive forecasts, ensembles over all methods, clustered models and streams, whose steps are written out one by one."""

from __future__ import annotations

from sfumato.queries.base import FUZZY, TRANS, S, sets_sql
from sfumato.queries.models import _MV
from sfumato.queries.univariate import _DIST, _FREQ, _GROUPS, _OUT, _RULE_SQL, _paths_sql
from sfumato.queries.univariate import SQL as UNI

SQL: dict[str, str] = {}


# All methods over six sets.
def _six(sql: str) -> str:
    return sql.replace("range(0, 10)", "range(0, 6)").replace("/ 9", "/ 5")


_first = [f"({_six(TRANS)}, {sql}{_OUT.replace('round(coalesce(m.mid, a.c), 6)', 'coalesce(m.mid, a.c)')})" for sql in _RULE_SQL.values()]
_hofts = "(" + UNI["hofts2"].replace("round(avg(coalesce(m.mid, pa.nc)), 6) AS yhat", "avg(coalesce(m.mid, pa.nc)) AS yhat") + ")"
_hwang = (
    f"({_six(FUZZY)}, h AS (SELECT s.t, g.c, pow(greatest(0, 1 - abs(s.x - g.c) / g.p), 2) AS r FROM s, g), bb AS (SELECT *, max(r) OVER (PARTITION BY t) AS best FROM h) "
    "SELECT t + 1 AS target_t, avg(c) AS yhat FROM bb WHERE r = best GROUP BY t)"
)
SQL["all_method_ensemble"] = "SELECT target_t, round(avg(yhat), 6) AS yhat FROM (" + " UNION ALL ".join(f"SELECT target_t, yhat FROM {q}" for q in (*_first, _hofts, _hwang)) + ") GROUP BY target_t"

# The end of each event type's series; its times are dense.
_ENDS = """, pn AS (SELECT event_type AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS t FROM events), te AS (SELECT id, max(t) AS t FROM pn GROUP BY id),
e0 AS (SELECT te.id, te.t, max(CASE WHEN pn.t = te.t THEN pn.x END) AS b, max(CASE WHEN pn.t = te.t - 1 THEN pn.x END) AS a FROM te JOIN pn ON pn.id = te.id AND pn.t >= te.t - 1 GROUP BY te.id, te.t)"""


def _fired(x: str, as_: str) -> str:
    return f"JOIN g {as_} ON 1 - abs({x} - {as_}.c) / {as_}.p > 0"


def _mu(x: str, as_: str) -> str:
    return f"(1 - abs({x} - {as_}.c) / {as_}.p)"


def _unrolled(head: str, steps: int, step, columns: str, out: str) -> str:
    """head, CTEs e1, e2, ... each made by step(k) from the one before, and the steps' rows."""
    ctes = ", ".join(f"e{k} AS ({step(k)})" for k in range(1, steps + 1))
    return f"{head}, {ctes} " + " UNION ALL ".join(f"SELECT id AS series_id, t + {k} AS target_t, CAST({k} AS INTEGER) AS horizon, {columns} FROM e{k}" for k in range(1, steps + 1)) + out


# Points of the frequency-weighted model of lags 1 and 2: state a (older), b (newer).
SQL["hofts_ahead"] = _unrolled(
    _paths_sql((1, 2)) + _FREQ + _ENDS, 5,
    lambda k: f"SELECT e.id, any_value(e.t) AS t, any_value(e.b) AS a, avg(coalesce(m.mid, gb.c)) AS b FROM e{k - 1} e {_fired('e.a', 'ga')} {_fired('e.b', 'gb')} LEFT JOIN m ON m.path = ga.set_ix || '-' || gb.set_ix GROUP BY e.id",
    "round(b, 6) AS yhat", "")


# Intervals: a lower and an upper history, each clipped to the sets' reach.
def _interval_step(k: int) -> str:
    src = f"(SELECT e.*, greatest(least(la, r.u), r.l) AS cla, greatest(least(lb, r.u), r.l) AS clb, greatest(least(ua, r.u), r.l) AS cua, greatest(least(ub, r.u), r.l) AS cub, r.l AS rl, r.u AS ru FROM e{k - 1} e, re r)"
    side = []
    for a, b, name in (("e.cla", "e.clb", "d"), ("e.cua", "e.cub", "h")):
        w = f"least({_mu(a, 'ga')}, {_mu(b, 'gb')})"
        side.append(
            f"{name} AS (SELECT e.id, sum({w} * coalesce(m.lower, gb.c - gb.p)) / sum({w}) AS lo, sum({w} * coalesce(m.upper, gb.c + gb.p)) / sum({w}) AS up "
            f"FROM z e {_fired(a, 'ga')} {_fired(b, 'gb')} LEFT JOIN m ON m.path = ga.set_ix || '-' || gb.set_ix GROUP BY e.id)"
        )
    return (
        f"WITH z AS {src}, {side[0]}, {side[1]} SELECT z.id, z.t, z.lb AS la, CASE WHEN z.lb <= z.rl THEN z.rl ELSE coalesce(least(d.lo, h.lo), z.rl) END AS lb, "
        "z.ub AS ua, CASE WHEN z.ub >= z.ru THEN z.ru ELSE coalesce(greatest(d.up, h.up), z.ru) END AS ub FROM z LEFT JOIN d ON d.id = z.id LEFT JOIN h ON h.id = z.id"
    )


SQL["ifts_ahead"] = _unrolled(
    _paths_sql((1, 2)) + _FREQ + _ENDS.replace("e0 AS (", "ee AS (") + ", re AS (SELECT min(c - p) AS l, max(c + p) AS u FROM g), e0 AS (SELECT id, t, a AS la, b AS lb, a AS ua, b AS ub FROM ee)",
    5, _interval_step, "round(lb, 6) AS lower, round(ub, 6) AS upper", "")

# The probabilistic model of lag 1.
_W = f"CASE WHEN {_mu('e.b', 'ga')} * coalesce(gp.p, 1) > 0 THEN {_mu('e.b', 'ga')} * coalesce(gp.p, 1) ELSE coalesce(gp.p, 1) END"
SQL["pwfts_ahead"] = _unrolled(
    _GROUPS + _ENDS, 5,
    lambda k: f"SELECT e.id, any_value(e.t) AS t, sum({_W} * coalesce(gp.mid, ga.c)) / sum({_W}) AS b FROM e{k - 1} e {_fired('e.b', 'ga')} LEFT JOIN gp ON gp.path = CAST(ga.set_ix AS VARCHAR) GROUP BY e.id",
    "round(b, 6) AS yhat", "")


def _pwfts_interval_step(k: int) -> str:
    src = f"(SELECT e.*, greatest(least(lb, r.u), r.l) AS clb, greatest(least(ub, r.u), r.l) AS cub, r.l AS rl, r.u AS ru FROM e{k - 1} e, re r)"
    side = []
    for b, name in (("e.clb", "d"), ("e.cub", "h")):
        w = f"({_mu(b, 'ga')} * coalesce(gp.p, 1))"
        side.append(
            f"{name} AS (SELECT e.id, sum({w} * coalesce(gp.lower, ga.c - ga.p)) / sum({w}) AS lo, sum({w} * coalesce(gp.upper, ga.c + ga.p)) / sum({w}) AS up "
            f"FROM z e {_fired(b, 'ga')} LEFT JOIN gp ON gp.path = CAST(ga.set_ix AS VARCHAR) GROUP BY e.id)"
        )
    return (
        f"WITH z AS {src}, {side[0]}, {side[1]} SELECT z.id, z.t, CASE WHEN z.lb <= z.rl THEN z.rl ELSE coalesce(least(d.lo, h.lo), z.rl) END AS lb, "
        "CASE WHEN z.ub >= z.ru THEN z.ru ELSE coalesce(greatest(d.up, h.up), z.ru) END AS ub FROM z LEFT JOIN d ON d.id = z.id LEFT JOIN h ON h.id = z.id"
    )


SQL["pwfts_ahead_interval"] = _unrolled(
    _GROUPS + _ENDS.replace("e0 AS (", "ee AS (") + ", re AS (SELECT min(c - p) AS l, max(c + p) AS u FROM g), e0 AS (SELECT id, t, b AS lb, b AS ub FROM ee)",
    5, _pwfts_interval_step, "round(lb, 6) AS lower, round(ub, 6) AS upper", "")

# Distributions: y1 from the last value, then mixtures of the distributions given each bin.
_DENSITY = """, uo AS (SELECT min(lo) - min(p) AS lo, min(hi) AS hi FROM g), bi AS (SELECT CAST(i AS INTEGER) AS bin_ix, lo + i * ((hi - lo) / 29) AS bin FROM uo, range(0, 30) r(i)),
sb AS (SELECT set_ix, bin_ix, greatest(0, 1 - abs(bin - c) / p) AS d FROM g, bi), z AS (SELECT set_ix, sum(d) AS z FROM sb GROUP BY set_ix),
rb AS (SELECT ma.path, sb.bin_ix, sum(ma.mass / gp.f * sb.d / z.z) AS w FROM ma JOIN gp ON gp.path = ma.path JOIN sb ON sb.set_ix = ma.j AND sb.d > 0 JOIN z ON z.set_ix = ma.j GROUP BY 1, 2),
ps AS (SELECT gp.path, gp.p / z.z AS ps FROM gp JOIN z ON CAST(z.set_ix AS VARCHAR) = gp.path)"""


def _given(src: str, key: str) -> str:
    """Distribution of the value after x for each key of src."""
    hit = (
        f"SELECT q.{key}, CAST(ga.set_ix AS VARCHAR) AS path, {_mu('q.x', 'ga')} AS mu FROM {src} q {_fired('q.x', 'ga')} "
        f"UNION ALL SELECT q.{key}, CAST(CASE WHEN q.x < (SELECT min(c) FROM g) THEN 0 ELSE 5 END AS VARCHAR), 1.0::DOUBLE FROM {src} q WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_mu('q.x', 'g')} > 0)"
    )
    return f"SELECT {key}, bin_ix, sum(mu * ps * w) / any_value(al) AS d FROM (SELECT h.*, ps.ps, sum(mu * ps.ps) OVER (PARTITION BY {key}) AS al FROM ({hit}) h JOIN ps ON ps.path = h.path) h JOIN rb ON rb.path = h.path GROUP BY {key}, bin_ix"


def _mix(k: int) -> str:
    raw = f"SELECT e.id, any_value(e.t) AS t, db.bin_ix, sum(e.d * db.d) AS d FROM e{k - 1} e JOIN db ON db.b = e.bin_ix WHERE e.d > 1e-6 GROUP BY e.id, db.bin_ix"
    return f"SELECT id, t, bin_ix, d / sum(d) OVER (PARTITION BY id) AS d FROM ({raw})"


SQL["pwfts_ahead_distribution"] = (
    _GROUPS + _ENDS + _DENSITY + f", s1 AS (SELECT id, b AS x FROM e0), d1 AS ({_given('s1', 'id')}), sbin AS (SELECT bin_ix AS b, bin AS x FROM bi), db AS ({_given('sbin', 'b')}), "
    f"e1 AS (SELECT d1.id, e0.t, d1.bin_ix, d1.d FROM d1 JOIN e0 ON e0.id = d1.id), e2 AS ({_mix(2)}), e3 AS ({_mix(3)}) "
    + " UNION ALL ".join(
        f"SELECT id AS series_id, t + {k} AS target_t, CAST({k} AS INTEGER) AS horizon, e{k}.bin_ix, bin, round(d, 6) AS density FROM e{k} JOIN bi ON bi.bin_ix = e{k}.bin_ix WHERE d > 0" for k in (1, 2, 3))
)

# Multivariate: the hour of the rows to come is given.
_W2 = "least(1 - abs(e.x - a.c) / a.p, 1 - abs(e.h - b.c) / b.p)"
SQL["mvfts_ahead"] = (
    _MV + ", m AS (SELECT path, avg(c) AS mid FROM pr GROUP BY path), e0 AS (SELECT t, x, h FROM s WHERE t = (SELECT max(t) FROM s)), "
    + ", ".join(
        f"e{k} AS (SELECT any_value(e.t) + 1 AS t, sum({_W2} * coalesce(m.mid, a.c)) / sum({_W2}) AS x, {k % 24}.0::DOUBLE AS h FROM e{k - 1} e JOIN g a ON 1 - abs(e.x - a.c) / a.p > 0 "
        "JOIN gh b ON 1 - abs(e.h - b.c) / b.p > 0 LEFT JOIN m ON m.path = a.set_ix || '-' || b.set_ix)" for k in range(1, 6))
    + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS horizon, t, round(x, 6) AS yhat FROM e{k}" for k in range(1, 6))
)

# Order 2 over the combinations whose sets are all of greatest degree somewhere.
SQL["granular_mvfts"] = _MV + """, sy AS (SELECT DISTINCT a.set_ix || '-' || ah.set_ix AS path FROM a JOIN ah ON ah.t = a.t),
ra AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mu DESC, own DESC, path DESC) AS rn FROM co WHERE path IN (SELECT path FROM sy)), cl AS (SELECT t, path, own, oc FROM ra WHERE rn <= 2),
ru AS (SELECT q.path || '|' || r.path AS key, avg(w.oc) AS mid FROM cl w JOIN cl r ON r.t = w.t - 1 JOIN cl q ON q.t = w.t - 2 GROUP BY 1)
SELECT r.t + 1 AS target_t, round(avg(coalesce(ru.mid, r.oc)), 6) AS yhat FROM cl r JOIN cl q ON q.t = r.t - 1 LEFT JOIN ru ON ru.key = q.path || '|' || r.path GROUP BY r.t"""

# Probabilistic models over the two combinations of greatest degree; ties go to the greater number.
_CLUSTERED = _MV.replace("co AS (SELECT f.t, f.set_ix || '-' || fh.set_ix AS path,", "co AS (SELECT f.t, f.set_ix * 6 + fh.set_ix AS path,") + """,
cl AS (SELECT t, path, mu, own AS j, oc AS c, ol AS l, ou AS u FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mu DESC, path DESC) AS rn FROM co) WHERE rn <= 2),
ma AS (SELECT q.path, w.j, w.c, w.l, w.u, sum(q.mu * w.mu) AS mass FROM cl q JOIN cl w ON w.t = q.t + 1 GROUP BY ALL),
gr AS (SELECT path, sum(mass) AS f, sum(mass * c) / sum(mass) AS mid, sum(mass * l) / sum(mass) AS lower, sum(mass * u) / sum(mass) AS upper FROM ma GROUP BY path),
gp AS (SELECT *, f / sum(f) OVER () AS p FROM gr)"""
_CW = "CASE WHEN cl.mu * coalesce(gp.p, 1) > 0 THEN cl.mu * coalesce(gp.p, 1) ELSE coalesce(gp.p, 1) END"
SQL["clustered_point"] = _CLUSTERED + " SELECT cl.t + 1 AS target_t, " + ", ".join(
    f"round(sum({_CW} * coalesce(gp.{c}, cl.{own})) / sum({_CW}), 6) AS {out}" for c, own, out in (("mid", "c", "yhat"), ("lower", "l", "lower"), ("upper", "u", "upper"))
) + " FROM cl LEFT JOIN gp ON gp.path = cl.path GROUP BY cl.t"
_tail = _DIST[_DIST.index(", uo AS"):]
SQL["clustered_distribution"] = _CLUSTERED + (
    _tail.replace("FROM pa JOIN gp ON gp.path = pa.path JOIN z ON z.set_ix = CAST(pa.path AS INTEGER)", "FROM cl pa JOIN gp ON gp.path = pa.path JOIN z ON z.set_ix = pa.j").replace("pa.mu_prod", "pa.mu").replace("ha.t AS target_t", "ha.t + 1 AS target_t")
) + " SELECT target_t, bin_ix, round(bin, 6) AS bin, round(density, 6) AS density FROM di WHERE round(density, 6) > 0"

SQL["mackey_glass"] = """WITH RECURSIVE m(k, y) AS (SELECT 0::BIGINT, [0.5::DOUBLE + i / 17.0::DOUBLE FOR i IN range(0, 18)]
UNION ALL SELECT k + 1, list_append(y[2:], y[18] - 0.1::DOUBLE * y[18] + 0.2::DOUBLE * y[1] / (1 + pow(y[1], 10))) FROM m WHERE k < 1099) SELECT k - 100 AS t, round(y[1], 6) AS x FROM m WHERE k >= 100"""

SQL["residual_analysis"] = TRANS + ", " + _RULE_SQL["chen"] + """, fc AS (SELECT a.t + 1 AS t, coalesce(m.mid, a.c) AS y FROM a LEFT JOIN m ON m.i = a.set_ix), e AS (SELECT s.t, s.x - fc.y AS e FROM s JOIN fc ON fc.t = s.t),
st AS (SELECT avg(e) AS m, var_pop(e) AS v, count(*) AS n FROM e),
ac AS (SELECT k, (SELECT sum((p.e - st.m) * (q.e - st.m)) FROM e p JOIN e q ON q.t = p.t + k) / ((st.n - k) * st.v) AS r, st.n FROM st, range(1, 11) r(k)),
lb AS (SELECT max(n) * (max(n) + 2) * sum(r * r / (n - k)) AS q FROM ac),
pv AS (SELECT q, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS p FROM lb)
SELECT round(m, 6) AS mean, round(sqrt(v), 6) AS std, round(q, 4) AS q, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'rejected' ELSE 'accepted' END AS h0 FROM st, pv"""

SQL["stream_drift"] = """WITH d AS (SELECT event_type AS series_id, event_id AS t, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT series_id, t, round(coalesce(avg(d) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0), 6) AS drift FROM d"""

SQL["stream_sessions"] = """WITH e AS (SELECT event_type AS series_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
k AS (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT series_id, min(ts) AS began, count(*) AS n FROM k GROUP BY series_id, s"""


# Experiments in sliding windows: each window has its own grid from its training rows.
def _windows(size: int, configs: list[tuple[str, int, int]]) -> str:
    """CTEs up to bm (window_id, config, rmse, size) of (method, sets, order) configurations, over windows that move by a fifth."""
    step, cut = round(size * 0.2), round(size * 0.8)
    out = [
        f"WITH {S}, w AS (SELECT CAST(k AS BIGINT) AS window_id, s.t, s.x, s.t - k * {step} AS o FROM s, range(0, (SELECT CAST(max(t) // {step} + 1 AS BIGINT) FROM s)) r(k) WHERE t >= k * {step} AND t < k * {step} + {size})",
        f"nn AS (SELECT window_id, count(*) FILTER (o < {cut}) AS n_train, count(*) FILTER (o >= {cut}) AS n_test FROM w GROUP BY window_id)",
        f"ul AS (SELECT window_id, min(x) AS a, max(x) AS z FROM w WHERE o < {cut} GROUP BY window_id)",
        "lh AS (SELECT window_id, CASE WHEN a < 0 THEN a * 1.1::DOUBLE ELSE a * 0.9::DOUBLE END AS lo, CASE WHEN z > 0 THEN z * 1.1::DOUBLE ELSE z * 0.9::DOUBLE END AS hi FROM ul)",
        f"wc AS (SELECT w.window_id, t, x, o, CASE WHEN o < {cut} THEN x ELSE greatest(least(x, hi), lo) END AS cx FROM w JOIN lh ON lh.window_id = w.window_id)",
    ]
    for n in sorted({n for _, n, _ in configs}):
        out += [
            f"g{n} AS (SELECT window_id, CAST(i AS INTEGER) AS set_ix, CASE WHEN hi > lo THEN (hi - lo) / {n - 1} ELSE 1.0::DOUBLE END AS p, lo + i * CASE WHEN hi > lo THEN (hi - lo) / {n - 1} ELSE 1.0::DOUBLE END AS c FROM lh, range(0, {n}) r(i))",
            f"d{n} AS (SELECT wc.window_id, t, x, o, set_ix, c, 1 - abs(cx - c) / p AS mu FROM wc JOIN g{n} g ON g.window_id = wc.window_id)",
            f"a{n} AS (SELECT window_id, t, x, o, set_ix, c FROM (SELECT *, row_number() OVER (PARTITION BY window_id, t ORDER BY greatest(0, mu) DESC, set_ix) AS rn FROM d{n}) WHERE rn = 1)",
            f"tr{n} AS (SELECT q.window_id, q.t, q.set_ix AS i, v.set_ix AS j, v.c FROM a{n} q JOIN a{n} v ON v.window_id = q.window_id AND v.t = q.t + 1 WHERE v.o < {cut})",
        ]
        if any(m == "whofts" and n == k for m, k, _ in configs):
            out.append(f"f{n} AS (SELECT window_id, t, x, o, set_ix, c FROM d{n} WHERE mu > 0)")
    results = []
    for at, (method, n, order) in enumerate(configs):
        name = f"_{at}"
        if method == "whofts":
            lags = range(order, 0, -1)
            key = " || '-' || ".join(f"f{k}.set_ix" for k in lags)
            joins = " ".join(f"JOIN f{n} f{k} ON f{k}.window_id = v.window_id AND f{k}.t = v.t - {k}" for k in lags)
            out += [
                f"m{name} AS (SELECT v.window_id, {key} AS path, avg(v.c) AS mid FROM f{n} v {joins} WHERE v.o < {cut} GROUP BY 1, 2)",
                f"pa{name} AS (SELECT v.window_id, v.t, v.x, {key} AS path, f1.c AS own FROM wc v {joins} WHERE v.o >= {cut + order} AND f{order}.o >= {cut})",
                f"fc{name} AS (SELECT q.window_id, q.t, any_value(q.x) AS x, avg(coalesce(m.mid, q.own)) AS y FROM pa{name} q LEFT JOIN m{name} m ON m.window_id = q.window_id AND m.path = q.path GROUP BY q.window_id, q.t)",
            ]
        else:
            rule = {
                "chen": f"SELECT window_id, i, avg(c) AS mid FROM (SELECT DISTINCT window_id, i, j, c FROM tr{n}) GROUP BY 1, 2", "ismail_efendi": f"SELECT window_id, i, avg(c) AS mid FROM tr{n} GROUP BY 1, 2",
                "yu": f"SELECT window_id, i, sum(k * c) / sum(k) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY window_id, i ORDER BY t) AS k FROM tr{n}) GROUP BY 1, 2",
            }[method]
            out += [
                f"m{name} AS ({rule})",
                f"fc{name} AS (SELECT v.window_id, v.t, v.x, coalesce(m.mid, q.c) AS y FROM a{n} q JOIN wc v ON v.window_id = q.window_id AND v.t = q.t + 1 LEFT JOIN m{name} m ON m.window_id = q.window_id AND m.i = q.set_ix WHERE q.o >= {cut})",
            ]
        out.append(
            f"bm{name} AS (SELECT nn.window_id, {at} AS config, CASE WHEN n_test > {order} AND n_train > {order + 1} THEN e.rmse END AS rmse, CASE WHEN n_test > {order} AND n_train > {order + 1} THEN r.size ELSE 0 END AS size FROM nn "
            f"LEFT JOIN (SELECT window_id, sqrt(avg((x - y) * (x - y))) AS rmse FROM fc{name} GROUP BY 1) e ON e.window_id = nn.window_id LEFT JOIN (SELECT window_id, count(*) AS size FROM m{name} GROUP BY 1) r ON r.window_id = nn.window_id)"
        )
        results.append(f"SELECT * FROM bm{name}")
    return ", ".join(out) + f", bm AS ({' UNION ALL '.join(results)})"


_configs = [(m, n, 1) for m in ("chen", "yu", "ismail_efendi") for n in (10, 20)] + [("whofts", 10, 2)]
SQL["windowed_benchmarks"] = _windows(1000, _configs) + (
    f", k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {m!r}, {n}, {o})' for i, (m, n, o) in enumerate(_configs))}) v(config, model, partitions, fts_order)) "
    "SELECT window_id, bm.config, model, partitions, fts_order, round(rmse, 6) AS rmse, CAST(size AS INTEGER) AS size FROM bm JOIN k ON k.config = bm.config"
)
SQL["best_config"] = _windows(500, [(m, n, 1) for m in ("chen", "yu") for n in (5, 10, 20)]) + " SELECT config, round(avg(rmse), 6) AS rmse FROM bm WHERE rmse IS NOT NULL GROUP BY config ORDER BY avg(rmse), config LIMIT 1"
_grid = [(n, o) for n in (5, 10) for o in (1, 2)]
SQL["grid_search"] = _windows(800, [("whofts", n, o) for n, o in _grid]) + (
    f", k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n}, {o})' for i, (n, o) in enumerate(_grid))}) v(config, partitions, o)), "
    "r AS (SELECT config, avg(rmse) AS m, stddev_pop(rmse) AS s, avg(size) AS n FROM bm GROUP BY config) "
    "SELECT 'whofts' AS method, partitions, CASE WHEN o = 1 THEN '1' ELSE '1,2' END AS lags, 0.0::DOUBLE AS alpha, round(0.6::DOUBLE * m + 0.4::DOUBLE * s, 6) AS f1, "
    "round(0.4::DOUBLE * n + 60 * CASE WHEN o = 1 THEN 1 ELSE 3 END, 6) AS f2, round(m, 6) AS rmse, round(n, 6) AS size FROM r JOIN k ON k.config = r.config"
)


def _solved(k: int, of: str, into: str) -> str:
    """CTEs that solve a symmetric system of k equations, columns a<i>_<j> (i <= j) and b<i> of one row, by elimination; the last has x0, x1, ..."""
    at = {(i, j): f"a{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)} | {(i, k): f"b{i}" for i in range(k)}
    out = [f"{into}_0 AS (SELECT " + ", ".join(f"{c} AS r{i}_{j}" for (i, j), c in at.items()) + f" FROM {of})"]
    for p in range(k):
        cells = [f"r{i}_{j}" + ("" if i == p else f" - r{i}_{p} / r{p}_{p} * r{p}_{j}") + f" AS r{i}_{j}" for i, j in at]
        out.append(f"{into}_{p + 1} AS (SELECT {', '.join(cells)} FROM {into}_{p})")
    return ", ".join(out) + f", {into} AS (SELECT " + ", ".join(f"r{i}_{k} / r{i}_{i} AS x{i}" for i in range(k)) + f" FROM {into}_{k})"


def _normal(z: list[str], y: str, frm: str) -> str:
    """The sums of a least-squares fit."""
    k = len(z)
    sums = [f"sum(({z[i]}) * ({z[j]})) AS a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(({z[i]}) * {y}) AS b{i}" for i in range(k)]
    return f"SELECT {', '.join(sums)}, sum({y} * {y}) AS yy, count(*)::DOUBLE AS n FROM {frm}"


# Autoregression of two lags with one moving-average term, from the errors of an autoregression of six lags.
_one = "1.0::DOUBLE"
_long = [_one, *(f"x{j}" for j in range(1, 7))]
_error = "x1 - (l.x0 + " + " + ".join(f"l.x{j} * o.x{j + 1}" for j in range(1, 7)) + ")"
_fit = " + ".join(f"f.x{i} * {z}" for i, z in enumerate(["1", "v.x1", "v.x2", "v.e1"]))
SQL["arma21"] = f"""WITH {S}, o AS (SELECT t, x, {', '.join(f'lag(x, {j}) OVER (ORDER BY t) AS x{j}' for j in range(1, 8))} FROM s),
n1 AS ({_normal(_long, 'x', '(SELECT * FROM o WHERE x6 IS NOT NULL)')}), {_solved(7, 'n1', 'l')},
v AS (SELECT o.t, o.x, o.x1, o.x2, {_error.replace('x1 -', 'o.x1 -')} AS e1 FROM o, l WHERE o.x7 IS NOT NULL), n2 AS ({_normal([_one, 'x1', 'x2', 'e1'], 'x', 'v')}), {_solved(4, 'n2', 'f')},
y AS (SELECT v.t, v.x, {_fit} AS y FROM v, f), sg AS (SELECT sqrt(avg((x - y) * (x - y))) AS s FROM y)
SELECT t AS target_t, round(y, 4) AS yhat, round(y - 1.6448536269514722::DOUBLE * s, 4) AS lower, round(y + 1.6448536269514722::DOUBLE * s, 4) AS upper FROM y, sg"""

# Sets that drift along polynomials through the extremes of windows of 1,000 rows.
_u = "(w - mid) / half"
_powers = [_one, "one * u", "two * u * u"]  # with fewer windows than powers the highest are left out


def _used(sums: str) -> str:
    """Coefficients of powers left out come out as 0."""
    return f"SELECT * REPLACE (CASE WHEN a1_1 = 0 THEN 1 ELSE a1_1 END AS a1_1, CASE WHEN a2_2 = 0 THEN 1 ELSE a2_2 END AS a2_2) FROM ({sums})"


_poly = lambda x, w: f"({x}.x0 + {x}.x1 * (({w}) - k.mid) / k.half + {x}.x2 * pow((({w}) - k.mid) / k.half, 2))"
SQL["high_order_nsfts"] = f"""WITH {S}, {sets_sql(6)}, we AS (SELECT CAST(t // 1000 * 1000 AS DOUBLE) AS w, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1),
k AS (SELECT min(w) AS first, (min(w) + max(w)) / 2 AS mid, CASE WHEN max(w) > min(w) THEN (max(w) - min(w)) / 2 ELSE 1 END AS half FROM we), wu AS (SELECT {_u} AS u, lo, hi, (count(*) OVER () >= 2)::INTEGER AS one, (count(*) OVER () >= 3)::INTEGER AS two FROM we, k),
nl AS ({_used(_normal(_powers, 'lo', 'wu'))}), {_solved(3, 'nl', 'pl')}, nh AS ({_used(_normal(_powers, 'hi', 'wu'))}), {_solved(3, 'nh', 'ph')},
m AS (SELECT t, x, {_poly('pl', 't // 1000 * 1000')} - {_poly('pl', 'k.first')} AS dl, {_poly('ph', 't // 1000 * 1000')} - {_poly('ph', 'k.first')} AS dh FROM s, k, pl, ph),
mv AS (SELECT m.*, set_ix, c, p, (1 - set_ix / 5.0::DOUBLE) * dl + set_ix / 5.0::DOUBLE * dh AS loc, (dh - dl) / 6 AS wid FROM m, g),
e AS (SELECT *, c - p + loc - wid / 2 AS ea, c + loc AS eb, c + p + loc + wid / 2 AS ec FROM mv),
d AS (SELECT *, CASE WHEN x < ea OR x > ec THEN 0 WHEN x < eb THEN (x - ea) / (eb - ea) WHEN x = eb THEN 1 ELSE (ec - x) / (ec - eb) END AS mu FROM e),
f AS (SELECT t, set_ix, c, p, mu FROM d WHERE mu > 0 UNION ALL SELECT t, set_ix, c, p, 1.0::DOUBLE FROM d WHERE t NOT IN (SELECT t FROM d WHERE mu > 0) AND set_ix = (CASE WHEN x < (SELECT min(c) FROM g) + dl THEN 0 ELSE 5 END)),
pa AS (SELECT b.t + 1 AS t, a.set_ix || '-' || b.set_ix AS path, a.mu * b.mu AS mu, b.set_ix AS own, b.c AS oc, b.p FROM f b JOIN f a ON a.t = b.t - 1),
ru AS (SELECT pa.path, avg(f.c) AS mid, avg(f.set_ix / 5.0::DOUBLE) AS kb FROM pa JOIN f ON f.t = pa.t GROUP BY pa.path),
j AS (SELECT pa.*, coalesce(ru.mid, pa.oc) AS mid, (1 - coalesce(ru.kb, pa.own / 5.0::DOUBLE)) * m.dl + coalesce(ru.kb, pa.own / 5.0::DOUBLE) * m.dh AS sh FROM pa JOIN m ON m.t = pa.t - 1 LEFT JOIN ru ON ru.path = pa.path)
SELECT t AS target_t, round(sum(mu * (mid + sh)) / sum(mu), 4) AS yhat, round(sum(mu * (mid - p + sh)) / sum(mu), 4) AS lower, round(sum(mu * (mid + p + sh)) / sum(mu), 4) AS upper FROM j GROUP BY t"""


# The conditional model: residual memories are carried along each series, whose times are dense.
_N = 8


def _value(x: str, loc: list[str], wid: list[str]) -> str:
    """Forecast of the value after x by sets displaced by loc and widened by wid, from columns c<i>, m<i> (centroids, midpoints) and p."""
    num, den = [], []
    for i in range(_N):
        a, b, c = f"(c{i} - p + {loc[i]} - {wid[i]} / 2)", f"(c{i} + {loc[i]})", f"(c{i} + p + {loc[i]} + {wid[i]} / 2)"
        mu = f"CASE WHEN {a} < {x} AND {x} < {c} THEN CASE WHEN {x} = {b} THEN 1.0::DOUBLE WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a}) ELSE ({c} - {x}) / ({c} - {b}) END ELSE 0.0::DOUBLE END"
        num.append(f"({mu}) * (m{i} + {loc[i]})")
        den.append(f"({mu})")
    edge = f"CASE WHEN {x} < c0 + {loc[0]} THEN m0 + {loc[0]} ELSE m{_N - 1} + {loc[_N - 1]} END"
    return f"CASE WHEN {' + '.join(den)} > 0 THEN ({' + '.join(num)}) / ({' + '.join(den)}) ELSE {edge} END"


_loc = [f"(base + a + {k} * step)" for k in range(_N)]
_every = [*_loc, f"(base + a + 2 * sd / {_N - 1})", f"(base + a + 2 * sd / {_N - 1} + step)"]
_wid = [f"abs({_every[0]} - {_every[2]})", *(f"abs({_every[k - 1]} - {_every[k + 1]})" for k in range(1, _N))]
_state = (
    "SELECT *, CASE WHEN len(rs) > 0 THEN list_avg(rs) ELSE 0 END AS bias, CASE WHEN len(rs) = 0 OR list_var_pop(rs) < 1 THEN 0 ELSE sqrt(list_var_pop(rs)) END AS sd, (b - a) / 7 AS step FROM (__FROM__)"
)
_next = f"SELECT id, t, rs, {_value('x', _loc, _wid)} AS y FROM (SELECT *, (b - a) / 2 + mean + bias - sd AS base FROM ({_state})), k"
SQL["nsfts_conditional"] = SQL["cvfts"] = f"""WITH RECURSIVE s AS (SELECT event_type AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS t FROM events),
uu AS (SELECT min(x) AS a, max(x) AS z FROM s), bb AS (SELECT CASE WHEN a < 0 THEN a * (1 + -0.05::DOUBLE) ELSE a * (1 - -0.05::DOUBLE) END AS lo, CASE WHEN z > 0 THEN z * (1 + -0.05::DOUBLE) ELSE z * (1 - -0.05::DOUBLE) END AS hi FROM uu),
g AS (SELECT CAST(i AS INTEGER) AS set_ix, lo + i * ((hi - lo) / {_N - 1}) AS c, (hi - lo) / {_N - 1} AS p, lo - (hi - lo) / {_N - 1} AS ulo, hi AS uhi FROM bb, range(0, {_N}) r(i)),
ax AS (SELECT id, t, CAST(least(greatest(ceil((x - lo) / ((hi - lo) / {_N - 1}) - 0.5::DOUBLE), 0), {_N - 1}) AS INTEGER) AS i FROM s, bb),
ru AS (SELECT i, avg(c) AS mid FROM (SELECT DISTINCT q.i, w.i AS j FROM ax q JOIN ax w ON w.id = q.id AND w.t = q.t + 1) d JOIN g ON g.set_ix = d.j GROUP BY i),
k AS (SELECT any_value(p) AS p, any_value(ulo) AS ulo, any_value(uhi) AS uhi, {', '.join(f'max(CASE WHEN set_ix = {i} THEN c END) AS c{i}, max(CASE WHEN set_ix = {i} THEN coalesce(mid, c) END) AS m{i}' for i in range(_N))} FROM g LEFT JOIN ru ON ru.i = g.set_ix),
pl AS (SELECT id, t, x, {_value('x', ['0.0::DOUBLE'] * _N, ['1.0::DOUBLE'] * _N)} AS y FROM s, k), er AS (SELECT id, t, x - lag(y) OVER (PARTITION BY id ORDER BY t) AS e FROM pl),
tn AS (SELECT id, avg(e) AS mean, list(e ORDER BY t)[-5:] AS kept FROM er WHERE e IS NOT NULL GROUP BY id),
ab AS (SELECT s.*, least(0, min(x - ulo) OVER w) AS a, greatest(0, max(x - uhi) OVER w) AS b FROM s, k WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
st AS (SELECT ab.*, mean, kept FROM ab JOIN tn ON tn.id = ab.id),
m(id, t, rs, y) AS ({_next.replace('__FROM__', 'SELECT st.*, kept AS rs FROM st WHERE t = 0')}
UNION ALL {_next.replace('__FROM__', 'SELECT st.*, list_append(m.rs, st.x - m.y)[-5:] AS rs FROM m JOIN st ON st.id = m.id AND st.t = m.t + 1')})
SELECT id AS series_id, t + 1 AS target_t, round(y, 4) AS yhat FROM m"""


# Partitioners: interior points of a sorted list, with their neighbours; the universe's ends are points too.
def _between(points: str) -> str:
    """CTE body of (set_ix, name, lower, centroid, upper) from a query of points v."""
    every = f"SELECT v FROM ({points}) UNION SELECT lo FROM b UNION SELECT hi FROM b"
    return (
        "SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS set_ix, 'A' || (row_number() OVER (ORDER BY v) - 1) AS name, a AS lower, v AS centroid, z AS upper "
        f"FROM (SELECT v, lag(v) OVER (ORDER BY v) AS a, lead(v) OVER (ORDER BY v) AS z FROM ({every})) WHERE a IS NOT NULL AND z IS NOT NULL"
    )


_HIST = f"{sets_sql()}, hg AS (SELECT x AS v, count(*) AS n FROM s GROUP BY x)"


def _split(name: str, where: str) -> str:
    """CTE of one threshold: the value at which the two-part entropy first falls, else the last."""
    q = f"SELECT v, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM hg WHERE {where}"
    h = f"SELECT v, CASE WHEN q = 1 THEN 1 ELSE -(q * ln(q) + (1 - q) * ln(1 - q)) END AS h FROM (SELECT v, least(q, 1) AS q FROM ({q})) WHERE q < 1 UNION ALL SELECT v, 1.0 FROM ({q}) WHERE q >= 1"
    return f"{name} AS (SELECT coalesce(min(CASE WHEN h < before THEN v END), max(v)) AS v, count(*) AS n FROM (SELECT v, h, lag(h) OVER (ORDER BY v) AS before FROM ({h})))"


def _low(at: str) -> str:
    return f"v <= (SELECT v FROM {at})"


def _high(at: str) -> str:
    return f"v > (SELECT v FROM {at})"


_ENTROPY = ", ".join([
    _split("t0", "true"), _split("t1", _low("t0")), _split("t2", _high("t0")), _split("t11", f"{_low('t0')} AND {_low('t1')}"), _split("t12", f"{_low('t0')} AND {_high('t1')}"),
    _split("t21", f"{_high('t0')} AND {_low('t2')}"), _split("t22", f"{_high('t0')} AND {_high('t2')}")]) + (
    ", et AS (SELECT v FROM t0 UNION " + " UNION ".join(f"SELECT v FROM {t} WHERE n > 1" for t in ("t1", "t2", "t11", "t12", "t21", "t22")) + f"), en AS ({_between('SELECT v FROM et')})")
_START = "rk AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS r, sum(n) OVER () AS al FROM hg), st AS (SELECT list(v ORDER BY v) AS c FROM (SELECT DISTINCT (SELECT min(v) FROM rk WHERE r >= al * (j + 0.5::DOUBLE) / 10) AS v FROM range(0, 10) z(j)))"
# A step assigns each value to the centre whose range between midpoints holds it.
_MEANS = """km(i, c, done) AS (SELECT 0, c, false FROM st UNION ALL
SELECT i + 1, nc, coalesce(list_max([abs(p.a - p.b) / abs(p.a) FOR p IN [{'a': nc[q], 'b': c[q]} FOR q IN range(1, len(c) + 1)]]), 0) <= 1e-12 FROM (
  SELECT any_value(i) AS i, any_value(c) AS c, list(y ORDER BY k) AS nc FROM (
    SELECT any_value(i) AS i, any_value(c) AS c, k, sum(v * n) / sum(n) AS y FROM (
      SELECT km.i, km.c, hg.v, hg.n, len([m FOR m IN [(km.c[q] + km.c[q + 1]) / 2 FOR q IN range(1, len(km.c))] IF m <= hg.v]) AS k FROM km, hg WHERE NOT km.done AND km.i < 1000) GROUP BY k)) WHERE i IS NOT NULL)"""
_CMEANS = f"{_START}, {_MEANS}, kc AS (SELECT DISTINCT round(unnest(c), 3) AS v FROM (SELECT c FROM km ORDER BY i DESC LIMIT 1)), cm AS ({_between('SELECT v FROM kc')})"
_FUZZY_MEANS = """fm(i, c, done) AS (SELECT 0, c, false FROM st UNION ALL
SELECT i + 1, nc, list_max([abs(nc[q] - c[q]) FOR q IN range(1, len(c) + 1)]) < 1e-3 FROM (
  SELECT any_value(i) AS i, any_value(c) AS c, list(y ORDER BY q) AS nc FROM (
    SELECT any_value(i) AS i, any_value(c) AS c, q, sum(m * m * n * v) / sum(m * m * n) AS y FROM (
      SELECT i, c, v, n, q, ds[q] / list_sum(ds) AS m FROM (
        SELECT fm.i, fm.c, hg.v, hg.n, [1 / greatest((hg.v - e) * (hg.v - e), 1e-18) FOR e IN fm.c] AS ds FROM fm, hg WHERE NOT fm.done AND fm.i < 100), LATERAL (SELECT unnest(range(1, len(c) + 1)) AS q)) GROUP BY q)) WHERE i IS NOT NULL)"""
_SETS = " SELECT set_ix, name, lower, centroid, upper FROM "
SQL["entropy_sets"] = f"WITH {S}, {_HIST}, {_ENTROPY}{_SETS}en"
SQL["cmeans_sets"] = f"WITH RECURSIVE {S}, {_HIST}, {_CMEANS}{_SETS}cm"
SQL["fcm_sets"] = f"WITH RECURSIVE {S}, {_HIST}, {_START}, {_FUZZY_MEANS}, fc AS (SELECT DISTINCT round(unnest(c), 3) AS v FROM (SELECT c FROM fm ORDER BY i DESC LIMIT 1)), fs AS ({_between('SELECT v FROM fc')}){_SETS}fs"
SQL["explore_partitioners"] = f"WITH RECURSIVE {S}, {_HIST}, {_ENTROPY}, {_CMEANS} SELECT partitioner, set_ix, name, mf, round(lower, 6) AS lower, round(centroid, 6) AS centroid, round(upper, 6) AS upper FROM (" + " UNION ALL ".join([
    *(f"SELECT 'grid_{m}' AS partitioner, set_ix, 'A' || set_ix AS name, '{m}' AS mf, c - p AS lower, c AS centroid, c + p AS upper FROM g" for m in ("trimf", "trapmf", "gaussmf")),
    *(f"SELECT '{k}', set_ix, name, 'trimf', lower, centroid, upper FROM {t}" for k, t in (("entropy", "en"), ("cmeans", "cm")))]) + ")"
