"""Seasonal models: seasons are columns, rules are grouped by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sfumato.functions.scalars import SEASONS, date_part
from sfumato.operators.fuzzify import maximum, with_fired
from sfumato.operators.partition import Partition
from sfumato.operators.rules import small
from sfumato.operators.series import with_lags


def linear_index(t: Column, unit: int, season: int) -> Column:
    """Season of a position: (t // unit) mod season."""
    return F.pmod(F.floor(t / unit), F.lit(season)).cast("int")


def field_index(c: Column, season: int) -> Column:
    """Season of a field: its whole part over the season's length."""
    return F.floor(c / season).cast("int")


def time_index(ts: Column, part: str, season: int = 1) -> Column:
    """Season of a date part."""
    return F.floor(date_part(part, ts) / season).cast("int")


def bound(parts: Sequence[str]) -> int:
    """Rows a table with one row a season can have."""
    n = 1
    for p in parts:
        n *= SEASONS[p]
    return n


def seasonal_rules(df: DataFrame, part: Partition, seasons: Sequence[str], how: str = "median") -> DataFrame:
    """seasons, yhat: median or mean of the centroids of each season's rows; combined on the map side by set first."""
    c = part.centroid(maximum(part, F.col("x")))
    counts = df.groupBy(*seasons, c.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    y = F.percentile("c", 0.5, F.col("n")) if how == "median" else F.sum(F.col("c") * F.col("n")) / F.sum("n")
    return counts.groupBy(*seasons).agg(y.alias("yhat"))


def seasonal_forecast(df: DataFrame, rules: DataFrame, seasons: Sequence[str], rows: int = 100_000) -> DataFrame:
    """Forecast of each row's own season; unseen seasons give NULL."""
    return df.join(small(rules, rows), list(seasons), "left")


def contextual_rules(df: DataFrame, part: Partition, season: str, alpha: float = 0.0) -> DataFrame:
    """season, lhs, total, n: sum and number of the distinct successors' centroids, by the successor's season."""
    f = with_fired(df.select("t", F.col(season).alias("season"), "x"), part, "x", "f").drop("x")
    if alpha > 0:
        f = f.withColumn("f", F.filter("f", lambda s: s["mu"] > alpha))
    o = with_lags(f, ["f", "season"], [-1]).where(F.col("f_-1").isNotNull())
    pairs = o.select(F.col("season_-1").alias("season"), F.explode("f.set_ix").alias("lhs"), F.col("f_-1").alias("g")).select("season", "lhs", F.explode("g.set_ix").alias("rhs"))
    return pairs.distinct().groupBy("season", "lhs").agg(F.sum(part.centroid(F.col("rhs"))).alias("total"), F.count(F.lit(1)).alias("n"))


def contextual_forecast(df: DataFrame, part: Partition, rules: DataFrame, season: str, alpha: float = 0.0, rows: int = 1_000_000) -> DataFrame:
    """target_t, yhat: mean over the successors of all fired sets in the row's season; a set without rule gives its own
    centroid, a season without any rule NULL."""
    f = with_fired(df.select("t", F.col(season).alias("season"), "x"), part, "x", "f")
    f = f.select("t", "season", F.explode("f").alias("s")).where(F.col("s.mu") > alpha).select("t", "season", F.col("s.set_ix").alias("lhs"))
    known = rules.select("season").distinct().withColumn("known", F.lit(True))
    j = f.join(small(rules, rows), ["season", "lhs"], "left").join(small(known, rows), "season", "left")
    total = F.sum(F.coalesce("total", part.centroid(F.col("lhs"))))
    y = F.when(F.max("known").isNotNull(), total / F.sum(F.coalesce("n", F.lit(1))))
    return j.groupBy((F.col("t") + 1).alias("target_t")).agg(y.alias("yhat"))
