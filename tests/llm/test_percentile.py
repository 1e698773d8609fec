import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sfumato.llm import percentile as pc


def exact(values, q):
    v = sorted(values)
    return v[max(0, -(-len(v) * q // 100) - 1)]


def check(s: pc.Summary, values, qs=(1, 10, 50, 90, 99)):
    assert s.n == len(values)
    for q in qs:
        est, low, high = s.percentile(q)
        v = exact(values, q)
        assert (low < v <= high) or low == v == high or (low == -math.inf and v <= high)
        rank = np.searchsorted(np.sort(values), est, "right")
        left = np.searchsorted(np.sort(values), est, "left")
        target = -(-len(values) * q // 100)
        assert left - s.over - s.under <= target <= rank + s.over + s.under


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=200), min_size=1, max_size=8), st.sampled_from([2, 8, 16]))
def test_bounds_hold_whatever_the_parts(parts, k):
    values = [float(x) for p in parts for x in p]
    if not values:
        return
    merged = pc.Summary(k)
    for p in parts:
        s = pc.Summary(k)
        s.add(np.array(p, float))
        if s.n:
            merged.merge(*s.state())
    check(merged, values)


def test_bound_is_as_promised():
    rng = np.random.default_rng(1)
    n, k = 200_000, 256
    s = pc.Summary(k)
    x = rng.lognormal(0, 3, n)
    for part in np.array_split(x, 37):
        s.add(part)
    assert max(s.over, s.under) <= n * math.log2(n / k) / (2 * k) + k
    assert sum(map(len, s.full.values())) <= math.log2(n / k) + 2
    check(s, x)


def test_groups_nulls_and_empty(spark):
    rows = [("a", 1, 5.0), ("a", 1, None), ("a", 1, math.nan), ("a", 1, math.inf), (None, 1, 2.0), (None, 1, 2.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, n int, v double").withColumn("vmin", F.lit(1)).withColumn("_value", F.lit("x"))
    got = {r["k"]: (r["n"], r["p50"], r["p90_high"]) for r in pc.percentiles(pc.merge(pc.summarize(df, ["k"], "v"), ["k"]), ["k"], (50, 90)).collect()}
    assert got == {"a": (1, 5.0, 5.0), None: (2, 2.0, 2.0)}
    empty = df.limit(0)
    assert pc.percentiles(pc.merge(pc.summarize(empty, ["k"], "v"), ["k"]), ["k"], (50,)).collect() == []


@pytest.mark.parametrize("k", [16, 64])
def test_exact_search_between_bounds(spark, k):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double").alias("v")).repartition(7)
    p = pc.percentiles(pc.merge(pc.summarize(df, ["g"], "v", k), ["g"], k), ["g"], (50, 90), k)
    want = {g: tuple(exact([r["v"] for r in df.where(F.col("g") == g).collect()], q) for q in (50, 90)) for g in range(3)}
    assert {r["g"]: (r["p50"], r["p90"]) for r in pc.exact_percentiles(df, p, ["g"], "v", (50, 90)).collect()} == want
    for r in p.collect():
        assert r["p50_low"] <= want[r["g"]][0] <= r["p50_high"]
        assert r["rank_error"] > 0


def test_days_apart_equal_days_together(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 3000).alias("day"), (F.hash("id") % 1000).cast("double").alias("v"))
    days = pc.summarize(df.where("day = 0"), ["g"], "v", 128)
    for day in (1, 2):
        days = days.unionByName(pc.summarize(df.where(f"day = {day}"), ["g"], "v", 128))
    for r in pc.percentiles(pc.merge(days, ["g"], 128), ["g"], (50,), 128).collect():
        v = exact([x["v"] for x in df.where(F.col("g") == r["g"]).collect()], 50)
        assert r["n"] == 4500 and r["p50_low"] <= v <= r["p50_high"]
