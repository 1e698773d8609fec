"""One ranking from scores of different scales: closeness to an ideal point.

Scores are winsorised at percentiles of their group, vector-normalised, weighted, and compared with the ideal point (the
best of each score) and the anti-ideal point (the worst of each); closeness is d_anti / (d_ideal + d_anti).

Defined results: candidates without all scores (NULL, NaN or infinite in one of them) get no rank; a candidate at the
ideal point has closeness 1, also where all candidates are equal; a score that is zero throughout adds no distance;
candidates of equal closeness go by the sum of their normalised scores before winsorising, then by name; a NULL group
is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.entries import valid


def score_matrix(df: DataFrame, group: str, item: str, measure: str, value: str, measures: Sequence[str]) -> DataFrame:
    """Mean of each measure by group and item, one column a measure: a hash aggregation that combines on the map side,
    so that a group with a third of all rows shuffles no more than its items."""
    src = df.where(valid(value) & F.col(measure).isin(*measures))
    return src.groupBy(group, item).agg(*(F.avg(F.when(F.col(measure) == m, F.col(value))).alias(m) for m in measures))


def ideal_point_ranking(
    matrix: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float] | None = None,
    higher_is_better: Sequence[str] = (), winsor: tuple[float, float] = (0.05, 0.95),
) -> DataFrame:
    """group, item, the scores, d_ideal, d_anti, closeness, rnk.

    matrix has one row a group and item.  Percentiles, extremes and norms are aggregated with map-side combining and joined
    back, so a group of many items is no single task until the items' order, whose rows are sorted by one task a group.
    """
    weights = list(weights or [1.0] * len(scores))
    ok = matrix.select(F.col(group).alias("_g"), F.col(item).alias("_item"), *(F.col(s).alias(f"_x{i}") for i, s in enumerate(scores)))
    ix = range(len(scores))
    for i in ix:
        ok = ok.where(valid(f"_x{i}"))
    # Winsorise; the norm is that of the winsorised scores, so it takes a second pass.
    ends = ok.groupBy("_g").agg(
        *(F.percentile(f"_x{i}", [winsor[0], winsor[1]]).alias(f"_e{i}") for i in ix), *(F.min(f"_x{i}").alias(f"_lo{i}") for i in ix), *(F.max(f"_x{i}").alias(f"_hi{i}") for i in ix))
    inside = lambda c, i: F.least(F.greatest(F.col(c), F.get(f"_e{i}", F.lit(0))), F.get(f"_e{i}", F.lit(1)))
    df = _with(ok, ends).select("_g", "_item", *(f"_x{i}" for i in ix), *(inside(f"_x{i}", i).alias(f"_w{i}") for i in ix), *(inside(f"_{e}{i}", i).alias(f"_{e}{i}") for i in ix for e in ("lo", "hi")))
    df = _with(df, df.groupBy("_g").agg(*(F.sqrt(F.sum(F.col(f"_w{i}") * F.col(f"_w{i}"))).alias(f"_n{i}") for i in ix)))
    # Vector-normalise and weight; raw scores by the same norm serve for ties.
    signed = [wt * (-1.0 if s in higher_is_better else 1.0) for s, wt in zip(scores, weights, strict=True)]
    unit = lambda c, i: F.when(F.col(f"_n{i}") > 0, F.col(c) / F.col(f"_n{i}") * F.lit(signed[i])).otherwise(F.lit(0.0))
    # The ideal has the least of each weighted score, the anti-ideal the greatest: at the ends, which of them by the weight's sign.
    best, worst = ([unit(f"_{'lo' if (w >= 0) == low else 'hi'}{i}", i) for i, w in enumerate(signed)] for low in (True, False))
    dist = lambda to: F.sqrt(sum(((unit(f"_w{i}", i) - to[i]) * (unit(f"_w{i}", i) - to[i]) for i in ix), F.lit(0.0)))
    raw = sum((unit(f"_x{i}", i) for i in ix), F.lit(0.0))
    df = df.select("_g", "_item", *(f"_x{i}" for i in ix), raw.alias("_raw"), dist(best).alias("d_ideal"), dist(worst).alias("d_anti"))
    df = df.withColumn("closeness", F.when(F.col("d_ideal") == 0, F.lit(1.0)).otherwise(F.col("d_anti") / (F.col("d_ideal") + F.col("d_anti"))))
    ranked = df.withColumn("rnk", F.row_number().over(Window.partitionBy("_g").orderBy(F.col("closeness").desc(), F.col("_raw"), F.col("_item"))))
    return ranked.select(F.col("_g").alias(group), F.col("_item").alias(item), *(F.col(f"_x{i}").alias(s) for i, s in enumerate(scores)), "d_ideal", "d_anti", "closeness", "rnk")


def _with(df: DataFrame, per_group: DataFrame) -> DataFrame:
    """df with its group's row; a NULL group is a group.  At run time Spark broadcasts the groups' table if it is small, and
    splits hot groups of a shuffle join."""
    return df.join(per_group.withColumnRenamed("_g", "_k"), F.col("_g").eqNullSafe(F.col("_k"))).drop("_k")


def dominant(ranked: DataFrame, group: str, item: str, scores: Sequence[str], least_items: int = 3, margin: float = 1e-9) -> DataFrame:
    """First-ranked items that are lower than every other item of their group in all scores, by more than margin
    (absolute); an exact check of candidates that the ranking puts at the ideal point."""
    lows = ranked.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *(F.min(s).alias(f"_low{i}") for i, s in enumerate(scores))).where(F.col("_n") >= least_items)
    near = [F.col(s) - F.col(f"_low{i}") <= margin for i, s in enumerate(scores)]
    df = ranked.select(F.col(group).alias("_h"), F.col(item).alias("_item"), "d_ideal", "rnk", *scores).join(lows, F.col("_h").eqNullSafe(F.col("_g")))
    first = (F.col("rnk") == 1) & (F.col("d_ideal") == 0)
    for i, s in enumerate(scores):
        first = first & (F.col(s) == F.col(f"_low{i}"))
    # One aggregation tells whether the first item is alone within the margin of each lowest value.
    alone = df.groupBy("_h").agg(*(F.count_if(c).alias(f"_c{i}") for i, c in enumerate(near)), F.max(F.when(first, F.struct(F.col("_item")))).alias("_first"))
    for i in range(len(scores)):
        alone = alone.where(F.col(f"_c{i}") == 1)
    return alone.where(F.col("_first").isNotNull()).select(F.col("_h").alias(group), F.col("_first._item").alias(item))
