import math

import numpy as np
from pyspark.sql import functions as F

from sfumato.llm import ranking, topn

S = ("a", "b")


def _rank(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, m string, a double, b double, closeness double, rnk int")
    return {(r["g"], r["m"]): r for r in ranking.ideal_point_ranking(df, "g", "m", S, **kw).collect()}


def _row(g, m, a, b):
    return (g, m, a, b, 9.9, 9)


def test_ideal_point_by_hand(spark):
    r = _rank(spark, [_row("x", "p", 1.0, 1000.0), _row("x", "q", 2.0, 3000.0), _row("x", "r", 3.0, 2000.0)], winsor=(0.0, 1.0))
    v = np.array([[1, 1000], [2, 3000], [3, 2000]], float)
    v /= np.sqrt((v**2).sum(axis=0))
    di, da = (np.sqrt(((v - f(v, axis=0)) ** 2).sum(axis=1)) for f in (np.min, np.max))
    closeness = dict(zip("pqr", da / (di + da), strict=True))
    for m, c in closeness.items():
        assert math.isclose(r["x", m]["closeness"], c, rel_tol=1e-12)
    assert sorted("pqr", key=lambda m: r["x", m]["rnk"]) == sorted("pqr", key=lambda m: -closeness[m])


def test_scale_does_not_matter_and_direction_does(spark):
    rows = [_row("x", m, a, b) for m, a, b in (("p", 1.0, 9.0), ("q", 2.0, 4.0), ("r", 5.0, 5.0))]
    big = [_row("x", m, a * 1e6, b * 1e-6) for _, m, a, b, *_ in rows]
    a, b = _rank(spark, rows), _rank(spark, big)
    assert [x["rnk"] for x in a.values()] == [x["rnk"] for x in b.values()]
    up = _rank(spark, [_row("x", "p", 1.0, 1.0), _row("x", "q", 1.0, 2.0)], higher_is_better=("b",))
    assert up["x", "q"]["rnk"] == 1


def test_nulls_ties_single_and_empty(spark):
    r = _rank(spark, [_row("x", "p", 1.0, None), _row("x", "q", math.nan, 1.0), _row("x", "s", 2.0, 2.0), _row(None, "z", 1.0, 1.0), _row(None, "y", 1.0, 1.0), _row("o", "o", 0.0, 0.0)])
    assert set(r) == {("x", "s"), (None, "z"), (None, "y"), ("o", "o")}
    assert r[None, "y"]["rnk"] == 1 and r[None, "z"]["closeness"] == 1.0 and r["o", "o"]["closeness"] == 1.0
    assert _rank(spark, []) == {}


def test_dominant(spark):
    rows = [_row("x", "p", 1.0, 1.0), _row("x", "q", 2.0, 2.0), _row("x", "r", 3.0, 1.5), _row("y", "p", 1.0, 2.0), _row("y", "q", 2.0, 1.0), _row("y", "r", 3.0, 3.0), _row("z", "p", 1.0, 1.0), _row("z", "q", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, m string, a double, b double, c double, d int")
    got = ranking.dominant(ranking.ideal_point_ranking(df, "g", "m", S), "g", "m", S).collect()
    assert [tuple(r) for r in got] == [("x", "p")]


def test_score_matrix(spark):
    rows = [("x", "p", "a", 1.0), ("x", "p", "a", 3.0), ("x", "p", "b", math.nan), ("x", "p", "c", 5.0)]
    r = ranking.score_matrix(spark.createDataFrame(rows, "g string, m string, k string, v double"), "g", "m", "k", "v", S).collect()
    assert [tuple(x) for x in r] == [("x", "p", 2.0, None)]


def _brute(df, group, order, n):
    rows = [r.asDict() for r in df.collect()]
    out = {}
    for r in rows:
        out.setdefault(tuple(r[g] for g in group), []).append(r)
    key = lambda r: tuple((r[o] is None, r[o] if r[o] is not None else 0) for o in order)
    return {(g, i + 1, r["id"]) for g, rs in out.items() for i, r in enumerate(sorted(rs, key=key)[:n])}


def test_top_n_hot_and_cold(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), (F.col("id") % 100).cast("string"))).alias("g"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 37 % 5).alias("v"), F.lit("x").alias("rows"), F.lit(1).alias("heavy"), F.lit(2).alias("cuts"), F.lit(9).alias("rnk"), F.lit(0).alias("o0"))
    got = topn.top_n(df, ["g"], ["v", "id"], 3, heavy_rows=200, ranges=4, salts=3)
    assert got.columns == ["id", "g", "v", "rows", "heavy", "cuts", "o0", "rnk"]
    assert {((r["g"],), r["rnk"], r["id"]) for r in got.collect()} == _brute(df, ["g"], ["v", "id"], 3)


def test_top_n_all_equal_strings_and_empty(spark):
    df = spark.range(500).select("id", F.lit("g").alias("g"), F.lit("same").alias("v"))
    assert sorted(r["id"] for r in topn.top_n(df, ["g"], ["v", "id"], 4, heavy_rows=10).collect()) == [0, 1, 2, 3]
    assert topn.top_n(df.limit(0), ["g"], ["v", "id"], 4).collect() == []
    assert topn.top_n(df, ["g"], ["v", "id"], 1000, heavy_rows=10).count() == 500
