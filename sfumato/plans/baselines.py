"""Forecasters to compare with: autoregression, moving-average terms, quantile regression, nearest neighbours, Gaussian process.

Regressions add up their normal equations in one JVM pass over all rows; only those sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sfumato.operators.series import with_lags
from sfumato.session import cut


def least_squares(df: DataFrame, features: Sequence[Column], y: Column, weight: Column | None = None) -> tuple[np.ndarray, float, int]:
    """(coefficients with the intercept first, residual deviation, rows) of a weighted linear regression."""
    z = [F.lit(1.0), *features]
    w = weight if weight is not None else F.lit(1.0)
    k = len(z)
    sums = [F.sum(w * z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(w * z[i] * y).alias(f"b{i}") for i in range(k)] + [F.sum(w * y * y).alias("yy"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")]
    r = df.agg(*sums).head()
    if not r["n"]:
        return np.zeros(k), 0.0, 0
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([r[f"b{i}"] for i in range(k)])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    sse = max(0.0, r["yy"] - 2 * beta @ b + beta @ a @ beta)
    return beta, float(np.sqrt(sse / max(r["w"], 1e-300))), r["n"]


def _linear(beta: np.ndarray, features: Sequence[Column]) -> Column:
    out = F.lit(float(beta[0]))
    for b, f in zip(beta[1:], features, strict=True):
        out = out + f * float(b)
    return out


@dataclass
class Autoregression:
    """x_t from its last p values; with q moving-average terms from a long autoregression's errors."""

    beta: np.ndarray
    sigma: float
    p: int
    q: int = 0
    long: np.ndarray | None = None

    def _features(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        far = len(self.long) - 1 if self.q else 0
        o = with_lags(df.select("t", "x"), ["x"], range(1, max(self.p, self.q + far) + 1))
        cols = [F.col(f"x_{k}") for k in range(1, self.p + 1)]
        for j in range(1, self.q + 1):
            cols.append(F.col(f"x_{j}") - _linear(self.long, [F.col(f"x_{j + k}") for k in range(1, far + 1)]))
        return o.where(F.col(f"x_{max(self.p, self.q + far)}").isNotNull()), cols

    def forecast(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """target_t, yhat and the normal interval lower, upper."""
        o, cols = self._features(df)
        z = NormalDist().inv_cdf(1 - alpha) * self.sigma
        y = _linear(self.beta, cols)
        return o.select(F.col("t").alias("target_t"), y.alias("yhat"), (y - z).alias("lower"), (y + z).alias("upper"))

    def ahead(self, last: Sequence[float], steps: int) -> list[tuple[float, float]]:
        """(forecast, deviation) of each step after the last p values (newest last); pure autoregressions only."""
        x, psi = list(last), [1.0]
        out, var = [], 0.0
        for h in range(steps):
            out.append(float(self.beta[0] + sum(self.beta[k] * x[-k] for k in range(1, self.p + 1))))
            x.append(out[-1])
            var += psi[h] ** 2
            psi.append(sum(self.beta[k] * psi[h + 1 - k] for k in range(1, min(self.p, h + 1) + 1)))
            out[-1] = (out[-1], self.sigma * var**0.5)
        return out


def fit_ar(df: DataFrame, p: int = 1, q: int = 0) -> Autoregression:
    m = Autoregression(np.zeros(p + q + 1), 0.0, p, q)
    if q:
        m.long = fit_ar(df, p + q + 3).beta
    o, cols = m._features(df)
    m.beta, m.sigma, _ = least_squares(o, cols, F.col("x"))
    return m


def quantile_ar(df: DataFrame, tau: float, p: int = 1, steps: int = 14) -> np.ndarray:
    """Coefficients of the tau-quantile autoregression: Newton steps on a logistic smoothing of the quantile loss.

    The smoothing narrows from the residual deviation to a twentieth of it; each step is one pass that adds up the gradient
    and the Hessian over all rows.
    """
    o = with_lags(df.select("t", "x"), ["x"], range(1, p + 1)).where(F.col(f"x_{p}").isNotNull())
    cols = [F.col(f"x_{k}") for k in range(1, p + 1)]
    o = o.select("x", *cols).persist()
    try:
        return _quantile_newton(o, cols, tau, steps)
    finally:
        o.unpersist()


def _quantile_newton(o: DataFrame, cols: Sequence[Column], tau: float, steps: int) -> np.ndarray:
    beta, sigma, n = least_squares(o, cols, F.col("x"))
    if not n or sigma == 0:
        return beta
    beta[0] += NormalDist().inv_cdf(tau) * sigma
    z = [F.lit(1.0), *cols]
    k = len(z)
    for i in range(steps):
        h = sigma * max(0.05, 0.7**i)
        e = F.col("x") - _linear(beta, cols)
        s = 1.0 / (1.0 + F.exp(F.greatest(F.least(e / h, F.lit(50.0)), F.lit(-50.0))))  # share below, smoothed
        sums = [F.sum((s - tau) * z[j]).alias(f"g{j}") for j in range(k)]
        sums += [F.sum(s * (1 - s) / h * z[a] * z[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
        r = o.agg(*sums).head()
        grad = np.array([r[f"g{j}"] for j in range(k)])
        hess = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
        step = np.linalg.lstsq(hess + 1e-9 * np.trace(hess) * np.eye(k), grad, rcond=None)[0]
        beta = beta - step
        if h <= 0.05 * sigma and np.abs(step).max() < 1e-8 * (1 + np.abs(beta).max()):
            break
    return beta


def quantile_forecast(df: DataFrame, taus: Sequence[float] = (0.05, 0.5, 0.95), p: int = 1) -> DataFrame:
    """target_t and q<percent> for each tau."""
    cols = [F.col(f"x_{k}") for k in range(1, p + 1)]
    o = with_lags(df.select("t", "x"), ["x"], range(1, p + 1)).where(F.col(f"x_{p}").isNotNull())
    return o.select(F.col("t").alias("target_t"), *(_linear(quantile_ar(df, tau, p), cols).alias(f"q{round(tau * 100):02d}") for tau in taus))


#: Queries of one block of the neighbour search; a block is what each task holds beside its rows.
QUERY_BLOCK = 20_000

#: Rows of one range of values in the search by order, and values whose candidates a task compares at a time.
RANGE_ROWS, RANGE_STEP = 250_000, 1024


def knn(df: DataFrame, k: int = 30, order: int = 1, every: int = 1) -> DataFrame:
    """target_t, yhat: mean successor of the k nearest lag vectors, for every row, or for those whose t is divisible by `every`.

    Exact, over all rows.  A row is no neighbour of itself; ties go to the earlier row.  One lag is searched in the order of its
    values; longer vectors are compared with all rows.
    """
    lags = range(1, order + 1)
    o = with_lags(df.select("t", "x"), ["x"], lags).where(F.col(f"x_{order}").isNotNull())
    if order == 1:
        return _knn_by_order(o.select("t", "x", F.col("x_1").cast("double").alias("v")), k, every, df.count())
    rows = o.select("t", "x", F.array(*(F.col(f"x_{j}") for j in lags)).alias("v"))
    return _knn_by_scan(rows, rows.where(F.pmod("t", F.lit(every)) == 0).select("t", "v"), k, order)


def _knn_by_scan(rows: DataFrame, queries: DataFrame, k: int, order: int) -> DataFrame:
    """Each task meets one block of queries at a time and keeps the k nearest of its own rows a query, and these are merged."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = "q bigint, t bigint, d double, x double"
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).toPandas()
        if not len(own):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((own["t"].to_numpy(), np.stack(own["v"].to_numpy())))

        def run(batches, shared=shared):
            qt, qv = shared.value
            best_d, best_t, best_x = np.full((len(qt), k), np.inf), np.full((len(qt), k), -1), np.zeros((len(qt), k))
            for batch in batches:
                t, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                v = np.reshape(batch.column(2).flatten().to_numpy(zero_copy_only=False), (-1, order)) if len(t) else np.zeros((0, order))
                for at in range(0, len(qt), 500):
                    s = slice(at, at + 500)
                    d = qv[s, None, :] - v[None, :, :]
                    d = np.abs(d[:, :, 0]) if order == 1 else np.sqrt((d**2).sum(axis=2))
                    d[qt[s, None] == t[None, :]] = np.inf
                    d = np.concatenate([best_d[s], d], axis=1)
                    tt = np.concatenate([best_t[s], np.broadcast_to(t, (len(qt[s]), len(t)))], axis=1)
                    xx = np.concatenate([best_x[s], np.broadcast_to(x, (len(qt[s]), len(x)))], axis=1)
                    # Only what isn't farther than the k-th is put in order, by distance and then time.
                    near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    near &= np.isfinite(d)
                    row = np.nonzero(near)[0]
                    order_ = np.lexsort((tt[near], d[near], row))
                    row, dd, tt, xx = row[order_], d[near][order_], tt[near][order_], xx[near][order_]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = place < k
                    best_d[s] = np.inf
                    best_d[at + row[keep], place[keep]] = dd[keep]
                    best_t[at + row[keep], place[keep]] = tt[keep]
                    best_x[at + row[keep], place[keep]] = xx[keep]
            found = np.isfinite(best_d)
            q = np.broadcast_to(qt[:, None], best_d.shape)[found]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best_t[found], pa.int64()), pa.array(best_d[found]), pa.array(best_x[found])], names=["q", "t", "d", "x"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "target_t bigint, yhat double")
    near = out.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))).where(F.col("_r") <= k)
    return near.groupBy(F.col("q").alias("target_t")).agg(F.avg("x").alias("yhat"))


def _knn_by_order(rows: DataFrame, k: int, every: int, n: int) -> DataFrame:
    """The search for one lag: the k nearest of a value are among the first k + 1 rows of it and the k + 1 next on either side.

    Of one value only its first k + 1 rows can be anyone's neighbours, so these are put in ranges of values, of which each task
    gets one and the edges of the ranges beside it.  A later row of the same value has the value's first k as neighbours.  Where
    different values are equally far after rounding and the time of rows outside of these lists would decide, all rows are looked at.
    """
    top = k + 1
    rows = rows.select("t", F.col("x").cast("double").alias("x"), (F.col("v") + F.lit(0.0)).alias("v")).where(F.abs("v") < float("inf"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("t"))).where(F.col("_r") <= top)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    held = cut(first.repartitionByRange(parts, "v").sortWithinPartitions("v", "t").select("t", "x", F.col("x").isNotNull().alias("has"), "v", "_r", F.spark_partition_id().alias("p")))
    edge = 3 * top  # whole values of more than 2 * top rows, as none has more than top

    def ends(batches):
        whole = pa.Table.from_batches(batches)
        if len(whole):
            for side, part in enumerate((whole.slice(0, edge), whole.slice(max(0, len(whole) - edge)))):
                yield from part.append_column("side", pa.array([side] * len(part), pa.int32())).to_batches()

    e = held.select("p", "v", "t", "x", "has").mapInArrow(_some(ends), "p int, v double, t bigint, x double, has boolean, side int").toPandas().sort_values(["p", "v", "t"])
    before, after = ({c: part[c].to_numpy() for c in ("p", "v", "t", "x", "has")} for part in (e[e["side"] == 1], e[e["side"] == 0]))
    shared = rows.sparkSession.sparkContext.broadcast((before, after))

    def run(batches):
        whole = pa.Table.from_batches(batches)
        if not len(whole):
            return
        before, after = shared.value
        p = whole.column("p")[0].as_py()
        lo, hi = np.searchsorted(before["p"], p), np.searchsorted(after["p"], p, side="right")
        v, t, x, has = (np.concatenate([before[c][max(0, lo - edge) : lo], whole.column(c).to_numpy(), after[c][hi : hi + edge]]) for c in ("v", "t", "x", "has"))
        a = min(lo, edge)
        for at, yhat, known, open_ in _nearest(v, t, np.where(has, x, 0.0), has, a, a + len(whole), k):
            yield pa.RecordBatch.from_arrays([pa.array(t[at], pa.int64()), pa.array(yhat, mask=~known), pa.array(open_)], names=["target_t", "yhat", "open"])

    found = cut(held.mapInArrow(_some(run), "target_t bigint, yhat double, open boolean").where(F.pmod("target_t", F.lit(every)) == 0))
    same = held.groupBy("v").agg(F.max("t").alias("last"), F.avg(F.when(F.col("_r") <= k, F.col("x"))).alias("yhat"), F.count(F.lit(1)).alias("n")).where(F.col("n") == top)
    later = rows.where(F.pmod("t", F.lit(every)) == 0).join(same, "v").where(F.col("t") > F.col("last")).select(F.col("t").alias("target_t"), "yhat")
    out = found.where(~F.col("open")).drop("open").unionByName(later)
    if not found.where("open").isEmpty():
        vec = rows.select("t", "x", F.array("v").alias("v"))
        out = out.unionByName(_knn_by_scan(vec, vec.join(found.where("open").select(F.col("target_t").alias("t")), "t").select("t", "v"), k, 1))
    return out


def _some(f):
    """f over a task's batches, where there are any."""

    def run(batches):
        if got := list(batches):
            yield from f(got)

    return run


def _nearest(v: np.ndarray, t: np.ndarray, x: np.ndarray, has: np.ndarray, a: int, b: int, k: int):
    """Of rows in the order of (v, t): positions within [a, b), mean x of the k nearest others, whether there is one, and whether it's undecided."""
    n, top = len(v), k + 1
    back = np.lexsort((t, -v))  # greater values first, of one value the earlier row first
    start = np.flatnonzero(np.concatenate([[True], v[a + 1 : b] != v[a : b - 1]])) + a
    end = np.append(start[1:], b)
    step = np.arange(top)
    for c in range(0, len(start), RANGE_STEP):
        s, e = start[c : c + RANGE_STEP], end[c : c + RANGE_STEP]
        q = v[s]
        left, right, same = n - s[:, None] + step, e[:, None] + step, s[:, None] + step
        there = np.concatenate([same < e[:, None], left < n, right < n], axis=1)
        ix = np.concatenate([same, back[np.minimum(left, n - 1)], right], axis=1)
        ix[~there] = 0
        d = np.where(there, np.abs(v[ix] - q[:, None]), np.inf)
        by = np.lexsort((t[ix], d), axis=1)[:, :top]
        near, dist = np.take_along_axis(ix, by, 1), np.take_along_axis(d, by, 1)
        # A list that ends at the last distance chosen: rows beyond its end count if another value is as far.
        undecided = np.zeros(len(s), bool)
        for end_of in (2 * top - 1, 3 * top - 1):
            tied = np.flatnonzero(there[:, end_of] & (d[:, end_of] <= dist[:, -1]))
            w = v[ix[tied, end_of]]
            for beside in (np.searchsorted(v, w) - 1, np.searchsorted(v, w, side="right")):
                inside = (beside >= 0) & (beside < n)
                other = np.abs(v[np.clip(beside, 0, n - 1)] - q[tied])
                undecided[tied] |= inside & (other == dist[tied, -1])
        g = np.repeat(np.arange(len(s)), e - s)
        at = np.arange(s[0], e[-1])
        use = np.isfinite(dist)[g] & (near[g] != at[:, None])
        counted = use & has[near[g]]
        m = counted.sum(axis=1)
        yhat = np.where(counted, x[near[g]], 0.0).sum(axis=1) / np.maximum(m, 1)
        some = use.any(axis=1)
        yield at[some], yhat[some], m[some] > 0, undecided[g][some]


def gaussian_process(df: DataFrame, window: int = 500, lags: int = 1, length: float | None = None, noise: float = 0.1) -> DataFrame:
    """target_t, yhat, sd: one-step forecasts of a Gaussian process on lag vectors.

    Each block of `window` rows is forecast from the block before it, as in a sliding experiment, so every row is forecast and the
    matrix to invert has a fixed size; blocks are independent tasks.
    """
    o = with_lags(df.select("t", "x"), ["x"], range(1, lags + 1)).where(F.col(f"x_{lags}").isNotNull())
    block = F.floor(F.col("t") / window).cast("long")
    rows = o.select(F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("test")), F.struct((block + 1).alias("b"), F.lit(False).alias("test")))).alias("h"), "*")
    rows = rows.select("h.b", "h.test", "t", "x", *(f"x_{k}" for k in range(1, lags + 1)))
    schema = T.StructType([T.StructField("target_t", T.LongType()), T.StructField("yhat", T.DoubleType()), T.StructField("sd", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[~pdf["test"]].sort_values("t"), pdf[pdf["test"]].sort_values("t")
        if not len(train) or not len(test):
            return pd.DataFrame({"target_t": [], "yhat": [], "sd": []}).astype({"target_t": "int64", "yhat": float, "sd": float})
        cols = [f"x_{k}" for k in range(1, lags + 1)]
        a, b, y = train[cols].to_numpy(), test[cols].to_numpy(), train["x"].to_numpy()
        m, s = y.mean(), y.std() or 1.0
        ell = length or (a.std() or 1.0)
        kern = lambda p, q: np.exp(-((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2) / (2 * ell**2))
        chol = np.linalg.cholesky(kern(a, a) + (noise + 1e-9) * np.eye(len(a)))
        alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, (y - m) / s))
        kab = kern(a, b)
        v = np.linalg.solve(chol, kab)
        var = np.maximum(1 - (v**2).sum(axis=0), 0) + noise
        return pd.DataFrame({"target_t": test["t"].to_numpy(), "yhat": kab.T @ alpha * s + m, "sd": np.sqrt(var) * s})

    return rows.groupBy("b").applyInPandas(run, schema)
