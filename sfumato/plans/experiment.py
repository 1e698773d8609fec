"""Experiments: windows x configurations, their measures as attribute-value rows, and reports of such rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sfumato.session import cut

#: Methods a window cell can be evaluated with.
METHODS = ("naive", "chen", "yu", "ismail_efendi", "whofts")


def _degrees(x: np.ndarray, lo: float, p: float, n: int) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x[:, None] - (lo + np.arange(n) * p)[None, :]) / p)


def evaluate_window(train: np.ndarray, test: np.ndarray, method: str, n: int, lags: Sequence[int] = (1,), alpha: float = 0.0) -> tuple[float, int]:
    """(rmse, number of rules) of one model in one window, whose size is fixed; arrays only."""
    top = max(lags)
    if len(test) <= top or len(train) <= top + 1:
        return float("nan"), 0
    lo = train.min() * (1.1 if train.min() < 0 else 0.9)
    hi = train.max() * (1.1 if train.max() > 0 else 0.9)
    p = (hi - lo) / (n - 1) if hi > lo else 1.0
    c = lo + np.arange(n) * p
    if method == "naive":
        e = test[top:] - test[top - 1 : -1]
        return float(np.sqrt(np.mean(e * e))), 0
    a = _degrees(train, lo, p, n).argmax(axis=1)
    if method != "whofts":
        rules: dict[int, list[int]] = {}
        for i, j in zip(a[:-1], a[1:], strict=True):
            rules.setdefault(int(i), []).append(int(j))
        mid = {}
        for i, js in rules.items():
            w = np.arange(1, len(js) + 1) if method == "yu" else np.ones(len(js))
            js = sorted(set(js)) if method == "chen" else js
            w = np.ones(len(js)) if method == "chen" else w
            mid[i] = float((c[js] * w).sum() / w.sum())
        b = _degrees(np.clip(test, lo, hi), lo, p, n).argmax(axis=1)
        y = np.array([mid.get(int(i), c[i]) for i in b])[top - 1 : -1]
        return float(np.sqrt(np.mean((test[top:] - y) ** 2))), len(mid)

    rmse, rules = evaluate_whofts(train[None, :], test[None, :], n, lags, alpha)
    return float(rmse[0]), int(rules[0])


#: Sums of a few times this are exact in doubles.
EXACT = 1 << 50

#: Degrees nearer than this to a bound are computed as their definition has it, whose rounding decides.
CLOSE = 1e-9


def _near(x: np.ndarray, lo: np.ndarray, p: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """As _fired, by the degrees of the three sets around each value, seldom all of which fire."""
    near = (x - lo) / p
    near = np.clip(np.where(np.isfinite(near), np.rint(near), 0.0).astype(np.int64), 0, n - 1)
    d = [_degree(x, near + o, lo, p, n) for o in (-1, 0, 1)]
    on = [(q > 0) & (q >= alpha) for q in d]
    none = ~(on[0] | on[1] | on[2])
    if none.any():  # the set of the greatest degree
        greatest = np.stack(d).argmax(axis=0)
        on = [q | (none & (greatest == i)) for i, q in enumerate(on)]
    return near, list(zip((-1, 0, 1), on))


def _degree(x: np.ndarray, i: np.ndarray, lo: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Degree in set i; -1 where there is none."""
    return np.where((i < 0) | (i >= n), -1.0, np.maximum(0.0, 1 - np.abs(x - (lo + i * p)) / p))


def _fired(x: np.ndarray, lo: np.ndarray, p: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(base, pairs (offset, whether the set base + offset fired)): of the values, which lie in the grid, only sets around them fire."""
    if n < 2 or alpha > 0.5 or not np.isfinite(x.sum()):
        return _near(x, lo, p, n, alpha)
    u = x - lo
    u /= p
    base = np.trunc(u)
    np.minimum(base, n - 2, out=base)
    u -= base
    base = base.astype(np.int64)
    left, right = u <= 1 - alpha, u >= alpha
    close = np.abs(np.abs(u - 0.5) - (0.5 - alpha)) <= CLOSE
    if close.any():
        at = np.nonzero(close)
        i, v, a, w = base[at], x[at], *(np.broadcast_to(c, x.shape)[at] for c in (lo, p))
        before, here, after, beyond = ((q > 0) & (q >= alpha) for q in (_degree(v, i + o, a, w, n) for o in (-1, 0, 1, 2)))
        if (before | beyond | ~(here | after)).any():
            return _near(x, lo, p, n, alpha)
        left[at], right[at] = here, after
    return base, [(0, left), (1, right)]


def _paths(base: np.ndarray, fired: list[tuple[int, np.ndarray]], lags: Sequence[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of sets around the values, from the greatest lag's row on; lags are falling.

    (number of the bases' path, windows x rows; what each path adds to it; whether all its sets fired, windows x paths x rows)
    """
    top, m = lags[0], base.shape[1]
    key, ways = 0, [(0, None)]
    for o in lags:
        row = slice(top - o, m - o)
        key = key * n + base[:, row]
        ways = [(a * n + i, q[:, row] if ok is None else ok & q[:, row]) for a, ok in ways for i, q in fired]
    return key, np.array([a for a, _ in ways]), np.stack([ok for _, ok in ways], axis=1)


def evaluate_whofts(train: np.ndarray, test: np.ndarray, n: int, lags: Sequence[int], alpha: float, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rmse, number of rules) of every window, a row of train and of test, longer than the lags.

    places: room for a number by path, which needn't be cleared, since what it names is compared; paths beyond it are sorted.
    """
    lags = sorted(lags, reverse=True)
    top, cut_at, wide = lags[0], train.shape[1], n ** len(lags)
    lo, hi = train.min(axis=1, keepdims=True), train.max(axis=1, keepdims=True)
    lo, hi = lo * np.where(lo < 0, 1.1, 0.9), hi * np.where(hi > 0, 1.1, 0.9)
    p = np.where(hi > lo, (hi - lo) / (n - 1), 1.0)
    x = np.concatenate([train, np.clip(test, lo, hi)], axis=1)
    base, fired = _fired(x, lo, p, n, alpha)
    key, add, ok = _paths(base, fired, lags, n)
    own, asked = key[:, None, : cut_at - top] + add[:, None], key[:, None, cut_at:] + add[:, None]
    if add[0]:  # a set before the first doesn't fire, but is a path's
        own, asked = np.clip(own, 0, wide - 1), np.clip(asked, 0, wide - 1)
    ok, real = ok[:, :, : cut_at - top], ok[:, :, cut_at:]
    by = _by_path if wide <= DENSE * own[0].size else _by_place
    sets = [(base[:, None, top:cut_at] + float(o), q[:, None, top:cut_at]) for o, q in fired]
    unit = 1 << (3 * n * cut_at).bit_length()
    if unit * cut_at < EXACT:  # the rows' sets, as steps from lo, and how many they are: whole numbers, summed as one
        total, rules = by(own, ok, sum(q * (i + unit) for i, q in sets), asked, wide, places)
        times = np.floor(total / unit)
        total -= times * unit
    else:
        total, times = (by(own, ok, v, asked, wide, places) for v in (sum(q * i for i, q in sets), sum(q * 1.0 for _, q in sets)))
        (total, _), (times, rules) = total, times
    last = base[:, None, cut_at + top - lags[-1] : x.shape[1] - lags[-1]] + np.resize([o for o, _ in fired], len(add))[:, None]
    y = np.where(times > 0, total / np.maximum(times, 1.0), last)
    y = (y * real).sum(axis=1) / real.sum(axis=1)
    return np.sqrt(np.mean((test[:, top:] - (lo + y * p)) ** 2, axis=1)), rules


def _by_path(own: np.ndarray, ok: np.ndarray, fires: np.ndarray, asked: np.ndarray, wide: int, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of fires over the rows of each asked path, number of paths) of every window, by a table of all paths."""
    first = (np.arange(len(own)) * wide)[:, None, None]
    table = np.bincount((own + first).ravel(), (fires * ok).ravel(), len(own) * wide)
    return table.take(asked + first), np.count_nonzero(table.reshape(-1, wide), axis=1)


def _by_place(own: np.ndarray, ok: np.ndarray, fires: np.ndarray, asked: np.ndarray, wide: int, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """As _by_path, by the paths that occur."""
    some = np.flatnonzero(ok)
    own, fires = own.ravel().take(some), np.broadcast_to(fires, ok.shape).ravel().take(some)
    ends = np.cumsum(np.count_nonzero(ok, axis=(1, 2)))
    number, rule, at = np.arange(len(own)), np.empty_like(own), np.empty_like(asked)
    begins = ends - np.diff(ends, prepend=0)
    for w, (a, b) in enumerate(zip(begins, ends)):
        k = own[a:b]
        if places is None or wide > len(places):
            each, first, back = np.unique(k, return_index=True, return_inverse=True)
            rule[a:b], at[w] = a + first[back], a + first[np.minimum(np.searchsorted(each, asked[w]), len(each) - 1)]
        else:
            places[k] = number[a:b]
            rule[a:b], at[w] = places[k], places[asked[w]]
    begins, ends = begins[:, None, None], ends[:, None, None]
    known = (at >= begins) & (at < ends)
    np.minimum(at, len(own) - 1, out=at)
    known &= own.take(at) == asked
    rules = np.add.reduceat(rule == number, begins.ravel(), dtype=np.int64)
    return np.bincount(rule, fires, len(own)).take(at) * known, rules


def evaluate_windows(train: np.ndarray, test: np.ndarray, method: str, n: int, lags: Sequence[int], alpha: float, places: np.ndarray) -> tuple[Sequence[float], Sequence[int]]:
    """(rmse, number of rules) of every window, a row of train and of test."""
    if method == "whofts" and test.shape[1] > max(lags) and train.shape[1] > max(lags) + 1:
        return evaluate_whofts(train, test, n, lags, alpha, places)
    return tuple(zip(*(evaluate_window(a, b, method, n, lags, alpha) for a, b in zip(train, test))))


#: The sums of all paths are kept in a table if it has at most so many times the number of a window's rows and paths.
DENSE = 4

#: Paths that get a place in a task's table, rather than being sorted in each window: three lags over 100 sets.
PLACES = 1 << 20

#: Rows of the windows evaluated at a time: enough that a step over their arrays outweighs its call.
TOGETHER = 1 << 15


def window_blocks(df: DataFrame, size: int, inc: float = 0.2) -> DataFrame:
    """block, n, rows: the rows of each run of n windows, so that most rows are in one run and not in every window.

    They are pieces in no order, each the bytes of pairs of doubles, the time since the block's begin and the value.
    """
    step = max(1, round(size * inc))
    n = 4 * max(1, -(-size // step))
    width = n * step

    def pieces(batches):
        for batch in batches:
            t, x = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            last, first = ((v // width).astype(np.int64) for v in (t, t + (step - size)))
            blocks, parts = [], []
            for block, member in ((last, first <= last), (last - 1, first < last)):  # a row's windows begin in two blocks at most
                at = np.flatnonzero(member & (block >= 0))
                at = at[np.argsort(block[at], kind="stable")]
                own = block[at]
                ends = np.flatnonzero(np.diff(own, append=-1))
                pairs = np.column_stack([t[at] - own * width, x[at]]).astype(float)
                blocks += own[ends].tolist()
                parts += [p.tobytes() for p in np.split(pairs, ends[:-1] + 1)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], names=["block", "piece"])

    whole = isinstance(df.schema["t"].dataType, IntegralType)
    rows = df.select(F.col("t").cast("long" if whole else "double"), F.col("x").cast("double")).where("t IS NOT NULL")
    rows = rows.mapInArrow(pieces, "block bigint, piece binary").groupBy("block").agg(F.collect_list("piece").alias("rows"))
    return rows.select("block", F.lit(n).alias("n"), "rows")


@dataclass(frozen=True)
class Windowed:
    """A series whose windows are evaluated again and again: its blocks, spread evenly and written once."""

    blocks: DataFrame
    size: int
    inc: float

    @classmethod
    def of(cls, df: DataFrame, size: int, inc: float) -> Windowed:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
        return cls(cut(window_blocks(df, size, inc).repartition(parts)), size, inc)


def windowed_benchmarks(df: DataFrame | Windowed, size: int, configs: Sequence[dict], train: float = 0.8, inc: float = 0.2) -> DataFrame:
    """window_id, config, model, partitions, fts_order, rmse, size, seconds: every configuration in every window.

    A task meets a block of windows at a time, whose size is fixed, so its memory doesn't depend on the series' length;
    configurations run inside of it, since their data are the same.
    """
    if isinstance(df, Windowed) and (df.size, df.inc) != (size, inc):
        raise ValueError("the series was cut into other windows")
    blocks = df.blocks if isinstance(df, Windowed) else window_blocks(df, size, inc)
    step, cut_at = max(1, round(size * inc)), round(size * train)
    models = [(c, tuple(c.get("lags", range(1, c.get("order", 1) + 1)))) for c in configs]
    schema = "window_id bigint, config int, model string, partitions int, fts_order int, rmse double, size int, seconds double"

    labels = [pa.array(v, kind) for v, kind in zip(zip(*((c["method"], c.get("partitions", 10), len(lags)) for c, lags in models)), (pa.string(), pa.int32(), pa.int32()))]
    names = ["window_id", "config", "model", "partitions", "fts_order", "rmse", "size", "seconds"]

    def table(ks, results):
        """A batch of some windows' results: by model the lists of their rmse and rules, and the seconds of each."""
        config = pa.array(np.repeat(np.arange(len(models), dtype=np.int32), len(ks)))
        rmse, rules, seconds = (np.concatenate([np.asarray(v) for v in part]) for part in zip(*((*r, [took] * len(ks)) for *r, took in results)))
        cols = [pa.array(np.tile(np.array(ks, np.int64), len(models))), config, *(v.take(config) for v in labels)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(rmse, pa.float64()), pa.array(rules.astype(np.int32)), pa.array(seconds)], names=names)

    def evaluated(windows, places):
        ks, xs = zip(*windows)
        whole, results = np.stack(xs), []
        for c, lags in models:
            began = time.perf_counter()
            got = evaluate_windows(whole[:, :cut_at], whole[:, cut_at:], c["method"], c.get("partitions", 10), lags, c.get("alpha", 0.0), places)
            results.append((*got, (time.perf_counter() - began) / len(ks)))
        return table(ks, results)

    def run(batches):
        places, full, together = np.zeros(PLACES, np.int32), [], max(1, TOGETHER // size)
        np.empty(1 << 24, np.int8)  # freed at once: glibc then keeps blocks up to this size for reuse, where each array's pages were mapped anew
        for batch in batches if models else ():
            for i in range(len(batch)):
                block, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                t, x = (v.copy() for v in np.frombuffer(b"".join(batch.column(2)[i].values.to_pylist())).reshape(-1, 2).T)
                if (t[1:] < t[:-1]).any():
                    order = np.argsort(t, kind="stable")
                    t, x = t[order], x[order]
                ends = np.searchsorted(t, step * np.arange(n)[:, None] + (0, min(cut_at, size), size)).tolist()
                for k, (a, m, b) in enumerate(ends):
                    if (m - a, b - m) == (cut_at, size - cut_at):
                        full.append((block * n + k, x[a:b]))
                    elif a < b:
                        results = []
                        for c, lags in models:
                            began = time.perf_counter()
                            got = evaluate_window(x[a:m], x[m:b], c["method"], c.get("partitions", 10), lags, c.get("alpha", 0.0))
                            results.append((*([v] for v in got), time.perf_counter() - began))
                        yield table([block * n + k], results)
                while len(full) >= together:
                    yield evaluated(full[:together], places)
                    full = full[together:]
        if full:
            yield evaluated(full, places)

    return blocks.mapInArrow(run, schema)


def to_measures(wide: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row a measure: keys, measure, value."""
    return wide.unpivot(list(keys), list(measures), "measure", "value")


def synthetic(results: DataFrame, keys: Sequence[str] = ("dataset", "model", "measure")) -> DataFrame:
    """Mean, deviation and number of a measure's values; NULL and NaN don't count."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return results.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def analytic(results: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide layout: one row by keys, a column for the mean of each measure."""
    return results.groupBy(*keys).agg(*(F.avg(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures))


def scaled(results: DataFrame, by: Sequence[str] = ("dataset", "measure")) -> DataFrame:
    """Adds the value scaled to [0, 1] within its group; 0 where all are equal.  The extremes are aggregated before they're joined."""
    ends = results.groupBy(*by).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return results.join(ends, list(by)).withColumn("scaled", F.coalesce(F.try_divide(F.col("value") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))).drop("_a", "_b")


def experiment_table(results: DataFrame, measure: str, models: Sequence[str]) -> DataFrame:
    """datasets x models of mean values."""
    src = results.where(F.col("measure") == measure)
    return src.groupBy("dataset").pivot("model", list(models)).agg(F.avg("value"))


def ignore(results: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose column holds none of the parts."""
    keep: Column = F.lit(True)
    for p in parts:
        keep = keep & ~F.coalesce(F.col(column).contains(p), F.lit(False))
    return results.where(keep)


def rename(results: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Replaces a name by another wherever the old one occurs in it."""
    c = F.col(column)
    out = c
    for old, new in reversed(list(names.items())):
        out = F.when(c.contains(old), F.lit(new)).otherwise(out)
    return results.withColumn(column, out)


def best_config(benchmarks: DataFrame) -> DataFrame:
    """config, mean rmse: the configuration of least mean error, of these the first."""
    m = benchmarks.groupBy("config").agg(F.avg("rmse").alias("rmse"))
    return m.orderBy(F.col("rmse").asc_nulls_last(), "config").limit(1)


def timed(f: Callable[[], DataFrame], name: str) -> DataFrame:
    """name, rows, seconds of running a plan to its end."""
    began = time.perf_counter()
    df = f()
    rows = df.count()
    return df.sparkSession.createDataFrame([(name, rows, time.perf_counter() - began)], "name string, rows bigint, seconds double")


def rank_models(results: DataFrame) -> DataFrame:
    """dataset, measure, model, rank of mean values, equal ones share the least rank."""
    m = results.groupBy("dataset", "measure", "model").agg(F.avg("value").alias("value"))
    return m.withColumn("rank", F.rank().over(Window.partitionBy("dataset", "measure").orderBy("value")))
