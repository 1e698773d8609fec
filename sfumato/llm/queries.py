"""The pN queries of this subpackage: each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.llm import lookalike, packing, percentile, ranking, tokenizer, topn
from sfumato.operators.entries import entries, measure_key, valid
from sfumato.session import cut, table

KEYS = ("model", "partitions")
SCORES = ("rmse", "mape", "u", "time")


def _run_times(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = table(spark, d, "benchmarks").where((measure_key("measure") == "time") & valid("value") & F.col("partitions").isNotNull())
    return entries(rows, *KEYS, "value", *more)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose 90th percentile exceeds 8 times the median: decided by the summaries' bounds where these suffice,
    by the exact search between the bounds where they don't."""
    rows = _run_times(spark, d)
    # One row a group, written once: the sure groups, the open ones and the size of the search come from it.
    bounds = cut(percentile.percentiles(percentile.merge(percentile.summarize(rows, KEYS, "value"), KEYS), KEYS, (50, 90)).where(F.col("n") >= 10))
    sure = bounds.where(F.col("p90_low") > 8 * F.col("p50_high"))
    open_ = bounds.where((F.col("p90_low") <= 8 * F.col("p50_high")) & (F.col("p90_high") > 8 * F.col("p50_low")))
    found = percentile.exact_percentiles(rows, open_, KEYS, "value", (50, 90)).where(F.col("p90") > 8 * F.col("p50"))
    return sure.select(*KEYS).unionByName(found.select(*KEYS))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with bounds, from summaries made apart for each day and put together afterwards."""
    rows = _run_times(spark, d, "run_date").withColumn("day", F.to_date("run_date"))
    days = percentile.summarize(rows, [*KEYS, "day"], "value")
    return percentile.percentiles(percentile.merge(days, KEYS), KEYS, (25, 50, 75, 90, 99))


def p1_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each estimate's exact rank lies within the proven error of the rank asked for: counted over all rows."""
    rows, qs = _run_times(spark, d), (25, 50, 75, 90, 99)
    got = cut(percentile.percentiles(percentile.merge(percentile.summarize(rows, KEYS, "value"), KEYS), KEYS, qs))
    each = got.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "n", "rank_error", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"p{q}").alias("y")) for q in qs))).alias("e"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    few = got.limit(percentile.BROADCAST + 1).count() <= percentile.BROADCAST
    ranked = rows.join(F.broadcast(each) if few else each, on).groupBy(*KEYS, "n", "rank_error", F.col("e.q").alias("q")).agg(
        F.count_if(F.col("value") < F.col("e.y")).alias("below"), F.count_if(F.col("value") <= F.col("e.y")).alias("upto"))
    want = F.ceil(F.col("n") * F.col("q") / 100)
    return ranked.select(*KEYS, "n", "q", ((F.col("upto") + F.col("rank_error") >= want) & (F.col("below") + 1 - F.col("rank_error") <= want)).alias("within"))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Models of each dataset by closeness to the ideal of their error measures and run times."""
    rows = table(spark, d, "benchmarks").where((F.col("type") == "point") & F.col("dataset").isNotNull() & valid("value"))
    rows = rows.withColumn("score", measure_key("measure")).where(F.col("score").isin(*SCORES))
    # One row a dataset and model, read by several passes of the ranking.
    matrix = cut(ranking.score_matrix(entries(rows, "dataset", "model", "score", "value"), "dataset", "model", "score", "value", SCORES))
    return ranking.ideal_point_ranking(matrix, "dataset", "model", SCORES)


def p2_rank(spark: SparkSession, d: str) -> DataFrame:
    return p2_ranking(spark, d).select("dataset", "model", F.round("closeness", 6).alias("closeness"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.dominant(p2_ranking(spark, d), "dataset", "model", SCORES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The three lowest rmse values of each dataset in both tables."""
    parts = [
        entries(
            table(spark, d, s).where((measure_key("measure") == "rmse") & valid("value") & F.col("dataset").isNotNull()),
            "dataset", "value", "run_date",
        ).withColumn("source", F.lit(s))
        for s in ("benchmarks", "hyperparam")
    ]
    return topn.top_n(parts[0].unionByName(parts[1]), ["source", "dataset"], ["value", "run_date", "id"], 3).select("source", "dataset", "rnk", "id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks, by their tokens, in containers of each capacity."""
    documents = table(spark, d, "documents")
    sizes = tokenizer.count_tokens(documents)
    return packing.pack(sizes, table(spark, d, "container_sizes"), n_items=documents.select("doc_id").count())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that look the same; the keys are read by several branches and so are written once to the shared folder."""
    return lookalike.look_pairs(cut(lookalike.look_keys(table(spark, d, "documents"))))


def p8_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_percentiles, p1_within, p2_found, p2_rank, p3_found, p6_ids, p7_packing, p8_found, p8_normalized)}
