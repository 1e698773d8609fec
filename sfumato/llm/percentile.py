"""Percentiles with a proven rank bound by deterministic collapsing of weighted sorted buffers.

A summary of one group holds sorted buffers of k values; a value in a buffer of level l stands for 2**l values.  Two
buffers of one level collapse into one of the next: of their 2k merged values every second is kept, by turns from the
first and from the second place.  The tree of collapses leaves at most one buffer a level.  Keeping even places
overcounts ranks by at most 2**l, keeping odd places undercounts them by at most that, so the sums ``over`` and
``under`` of these bound the error of any estimated rank r: the true rank lies in [r - over, r + under].  With n values
they sum to less than n * log2(n / k) / (2 * k) + k.  Summaries of partitions, files or days merge by the same rule.

Defined results: NULL, NaN and infinite values don't count; a NULL key is a key like any other; groups without a
valid value have no row; equal values and repeated rows count as often as they occur; the q-th percentile is the
smallest value with at least q % of the group's values at or below it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sfumato.operators.entries import valid

_STATE = [
    T.StructField("n", T.LongType()), T.StructField("vmin", T.DoubleType()), T.StructField("vmax", T.DoubleType()),
    T.StructField("over", T.LongType()), T.StructField("under", T.LongType()),
    T.StructField("rest", T.ArrayType(T.DoubleType(), False)),
    T.StructField("levels", T.ArrayType(T.IntegerType(), False)),
    T.StructField("buffers", T.ArrayType(T.DoubleType(), False)),
]


#: Groups whose bounds are broadcast; a row has the keys and a few numbers.
BROADCAST = 200_000


class Summary:
    """The summary of one group; see the module's docstring."""

    def __init__(self, k: int):
        self.k, self.n, self.over, self.under = k, 0, 0, 0
        self.vmin, self.vmax = np.inf, -np.inf
        self.rest = np.zeros(0)
        self.full: dict[int, list[np.ndarray]] = {}
        self.turn = 0

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.vmin, self.vmax = min(self.vmin, float(values.min())), max(self.vmax, float(values.max()))
        self._put(np.concatenate((self.rest, values)))
        self._collapse()

    def merge(self, n, vmin, vmax, over, under, rest, levels, buffers) -> None:
        self.n, self.over, self.under = self.n + n, self.over + over, self.under + under
        self.vmin, self.vmax = min(self.vmin, vmin), max(self.vmax, vmax)
        for level, buffer in zip(levels, np.reshape(buffers, (-1, self.k)), strict=True):
            self.full.setdefault(int(level), []).append(buffer)
        self._put(np.concatenate((self.rest, rest)))
        self._collapse()

    def _put(self, values: np.ndarray) -> None:
        values = np.sort(values)
        whole = len(values) // self.k * self.k
        if whole:
            self.full.setdefault(0, []).extend(values[:whole].reshape(-1, self.k))
        self.rest = values[whole:]

    def _collapse(self) -> None:
        level = 0
        while level <= max(self.full, default=-1):
            have = self.full.get(level, [])
            pairs = len(have) // 2
            if pairs:
                both = np.sort(np.stack(have[: 2 * pairs]).reshape(pairs, 2 * self.k), axis=1)
                first = (np.arange(pairs) + self.turn) % 2
                kept = np.where(first[:, None] == 0, both[:, 0::2], both[:, 1::2])
                odd = int(first.sum())
                self.over += (pairs - odd) << level
                self.under += odd << level
                self.turn = (self.turn + pairs) % 2
                self.full[level] = have[2 * pairs :]
                self.full.setdefault(level + 1, []).extend(kept)
            level += 1

    def state(self) -> tuple:
        flat = [(lv, b) for lv in sorted(self.full) for b in self.full[lv]]
        return (
            self.n, self.vmin, self.vmax, self.over, self.under, self.rest,
            [lv for lv, _ in flat], np.concatenate([b for _, b in flat]) if flat else np.zeros(0),
        )

    def percentile(self, num: int, den: int = 100) -> tuple[float, float, float]:
        """(estimate, low, high) of the num/den quantile: the true value v has low < v <= high, or is vmin if low is -inf.

        When nothing was collapsed low is the value itself, as is high.
        """
        values = [self.rest, *(b for lv in self.full for b in self.full[lv])]
        weights = np.concatenate([np.full(len(b), w) for b, w in zip(
            values, [1, *(1 << lv for lv in self.full for _ in self.full[lv])], strict=True)])
        values = np.concatenate(values)
        order = np.argsort(values, kind="stable")
        values, rank = values[order], np.cumsum(weights[order])
        # Of equal values only the last has the rank of all of them.
        last = np.append(values[1:] != values[:-1], True)
        values, rank = values[last], rank[last]
        target = -(-self.n * num // den) or 1
        at = min(int(np.searchsorted(rank, target)), len(values) - 1)
        if self.over == self.under == 0:
            return float(values[at]), float(values[at]), float(values[at])
        low = int(np.searchsorted(rank, target - self.under)) - 1
        high = int(np.searchsorted(rank, target + self.over))
        return (
            float(values[at]),
            float(values[low]) if low >= 0 else -np.inf,
            float(values[high]) if high < len(values) else self.vmax,
        )


def _row_batch(keys: list[tuple], states: list[tuple], schema: T.StructType, arrow: pa.Schema) -> pa.RecordBatch:
    cols = [*zip(*keys, strict=True), *zip(*states, strict=True)] if keys else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, arrow, strict=True)],
        schema=arrow,
    )


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of runs of equal keys; the batch is sorted by its first n_keys columns."""
    rows = batch.num_rows
    if not rows:
        return
    edge = np.zeros(rows, bool)
    edge[0] = True
    for i in range(n_keys):
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        edge[1:] |= codes[1:] != codes[:-1]
    starts = np.append(np.flatnonzero(edge), rows)
    heads = [batch.column(i).take(pa.array(starts[:-1])).to_pylist() for i in range(n_keys)]
    yield from zip(zip(*heads, strict=True), starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def _stream(n_keys: int, k: int, schema: T.StructType, arrow: pa.Schema, merging: bool):
    """mapInArrow body over rows sorted by key: one summary is open at a time, whatever the group's size."""

    def run(batches):
        open_key, open_summary, keys, states = None, None, [], []
        for batch in batches:
            for key, a, b in _runs(batch, n_keys):
                if open_summary is None or key != open_key:
                    if open_summary is not None:
                        keys.append(open_key)
                        states.append(open_summary.state())
                    open_key, open_summary = key, Summary(k)
                part = batch.slice(a, b - a)
                if merging:
                    for row in zip(*(part.column(n_keys + j).to_pylist() for j in range(len(_STATE))), strict=True):
                        open_summary.merge(*row[:5], np.array(row[5], float), row[6], np.array(row[7], float))
                else:
                    open_summary.add(part.column(n_keys).to_numpy(zero_copy_only=False))
                if len(keys) >= 256:
                    yield _row_batch(keys, states, schema, arrow)
                    keys, states = [], []
        if open_summary is not None:
            keys.append(open_key)
            states.append(open_summary.state())
        if keys:
            yield _row_batch(keys, states, schema, arrow)

    return run


def _summary_schema(df: DataFrame, keys: Sequence[str]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + _STATE)
    return schema, to_arrow_schema(schema)


def summarize(df: DataFrame, keys: Sequence[str], value: str, k: int = 1024) -> DataFrame:
    """One summary a group and map partition: nothing is shuffled, so it pre-aggregates hot groups where they lie."""
    src = df.where(valid(value)).select(*keys, F.col(value).cast("double").alias("_value"))
    schema, arrow = _summary_schema(src, keys)
    src = src.sortWithinPartitions(*keys, "_value")
    return src.mapInArrow(_stream(len(keys), k, schema, arrow, merging=False), schema)


def merge(summaries: DataFrame, keys: Sequence[str], k: int = 1024, fan_in: int = 32) -> DataFrame:
    """One summary a group from any number of them, made apart in partitions, files or days.

    Two rounds: the summaries of a group are first merged in up to fan_in salted parts, then those parts.
    """
    cols = [f.name for f in _STATE]
    schema, arrow = _summary_schema(summaries, keys)
    salted = summaries.select(*keys, *cols, F.pmod(F.xxhash64("n", "vmin", "vmax", F.get("rest", F.lit(0))), F.lit(fan_in)).alias("_salt"))
    part = (
        salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "n", "vmin", "vmax").select(*keys, *cols)
        .mapInArrow(_stream(len(keys), k, schema, arrow, merging=True), schema)
    )
    return (
        part.repartition(*keys).sortWithinPartitions(*keys, "n", "vmin", "vmax")
        .mapInArrow(_stream(len(keys), k, schema, arrow, merging=True), schema)
    )


def percentiles(summaries: DataFrame, keys: Sequence[str], qs: Sequence[int], k: int = 1024) -> DataFrame:
    """Per group: n, rank_error and for each percentile q its estimate p<q>, bounds p<q>_low (exclusive, or equal to
    p<q>_high when exact) and p<q>_high, from summaries with one row a group."""
    names = [f"p{q}{s}" for q in qs for s in ("", "_low", "_high")]
    schema = T.StructType(
        [T.StructField(c, summaries.schema[c].dataType) for c in keys]
        + [T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in names]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, n_keys = to_arrow_schema(schema), len(keys)

    def run(batches):
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Summary(k)
                s.merge(*row[n_keys : n_keys + 5], np.array(row[n_keys + 5], float), row[n_keys + 6], np.array(row[n_keys + 7], float))
                rows.append((*row[:n_keys], s.n, max(s.over, s.under), *(x for q in qs for x in s.percentile(q))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return summaries.select(*keys, *(f.name for f in _STATE)).mapInArrow(run, schema)


def exact_percentiles(df: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str, qs: Sequence[int]) -> DataFrame:
    """Exact percentiles of the groups in bounds (a result of percentiles), by looking only between the bounds.

    Values at or below a lower bound are only counted; those between the bounds are counted by value and searched by a
    running sum.  Both counts combine on the map side.  bounds should be a written table: its rows are counted, and up to
    BROADCAST of them are broadcast, so that rows of hot groups stay where they lie; beyond that a shuffle join is used.
    """
    on = None
    few = bounds.limit(BROADCAST + 1).count() <= BROADCAST
    b = bounds.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "n", *(f"p{q}_{s}" for q in qs for s in ("low", "high")))
    for i, c in enumerate(keys):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    rows = df.where(valid(value)).select(*keys, F.col(value).cast("double").alias("_v")).join(F.broadcast(b) if few else b, on)
    ranges = F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"p{q}_low").alias("low"), F.col(f"p{q}_high").alias("high")) for q in qs))
    rows = rows.select(*keys, "n", "_v", F.explode(ranges).alias("r")).where(F.col("_v") <= F.col("r.high"))
    inside = F.when((F.col("_v") > F.col("r.low")) | (F.col("r.low") == F.col("r.high")), F.col("_v"))
    counts = rows.groupBy(*keys, F.col("n"), F.col("r.q").alias("q"), inside.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window

    upto = Window.partitionBy(*keys, "q").orderBy(F.col("_v").asc_nulls_first())
    return (
        counts.withColumn("rank", F.sum("c").over(upto))
        .where(F.col("_v").isNotNull() & (F.col("rank") * 100 >= F.col("n") * F.col("q")))
        .groupBy(*keys).agg(*(F.min(F.when(F.col("q") == q, F.col("_v"))).alias(f"p{q}") for q in qs))
    )
