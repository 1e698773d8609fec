"""Fixtures and SQL fragments shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.session import table


def series(spark: SparkSession, d: str) -> DataFrame:
    """One long series: t (dense) and x."""
    return table(spark, d, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def steady(df: DataFrame, *cols: str) -> DataFrame:
    """Four decimals, cut where means of a few decimals don't lie, so that ties don't depend on an engine's rounding."""
    return df.withColumns({c: F.floor(F.col(c) * 1e4 + 0.123457) / 1e4 for c in cols})


def steady_sql(e: str) -> str:
    return f"floor({e} * 1e4::DOUBLE + 0.123457::DOUBLE) / 1e4::DOUBLE"


S = "s AS (SELECT event_id AS t, value AS x FROM events)"


def sets_sql(n: int = 10, src: str = "s", x: str = "x", name: str = "") -> str:
    """CTEs u, b and g: the sets of a uniform grid over a column."""
    return f"""
u{name} AS (SELECT min({x}) AS a, max({x}) AS z FROM {src}),
b{name} AS (SELECT CASE WHEN a < 0 THEN a * 1.1::DOUBLE ELSE a * 0.9::DOUBLE END AS lo,
             CASE WHEN z > 0 THEN z * 1.1::DOUBLE ELSE z * 0.9::DOUBLE END AS hi FROM u{name}),
g{name} AS (SELECT CAST(i AS INTEGER) AS set_ix, lo + i * ((hi - lo) / {n - 1}) AS c, (hi - lo) / {n - 1} AS p, lo, hi
      FROM b{name}, range(0, {n}) r(i))"""


def fuzzy_sql(src: str = "s", x: str = "x", name: str = "") -> str:
    """CTEs f (fired sets) and a (the set of greatest degree)."""
    return f"""
f{name} AS (SELECT t, {x} AS x, set_ix, c, c - p AS l, c + p AS u, 1 - abs({x} - c) / p AS mu FROM {src}, g{name} WHERE 1 - abs({x} - c) / p > 0),
a{name} AS (SELECT t, set_ix, c, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mu DESC, set_ix) AS rn, u - c AS p FROM f{name}) WHERE rn = 1)"""


FUZZY = f"WITH {S}, {sets_sql()}, {fuzzy_sql()}"
TRANS = FUZZY + ", tr AS (SELECT q.t, q.set_ix AS i, w.set_ix AS j, w.c, q.c AS ci FROM a q JOIN a w ON w.t = q.t + 1)"
