"""Models and results in Parquet: what a run writes, a later run reads."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sfumato.operators.partition import FuzzySet, Partition

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def _schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in ddl.split(", "))])


BENCHMARKS = _schema(
    "id bigint, run_date timestamp, dataset string, tag string, type string, model string, transformation string, fts_order int, scheme string, "
    "partitions int, size int, steps int, method string, measure string, value double"
)
HYPERPARAM = _schema(
    "id bigint, run_date timestamp, dataset string, tag string, model string, transformation string, mf string, fts_order int, partitioner string, "
    "partitions int, alpha double, lags string, measure string, value double"
)


def save_model(folder: str, part: Partition, rules: DataFrame, **config) -> None:
    """Rules as Parquet and a JSON header with the sets; an existing model is replaced, failures are raised."""
    rules.write.mode("overwrite").parquet(f"{folder}/rules")
    head = {"sets": [asdict(s) for s in part.sets], "lo": part.lo, "hi": part.hi, "grid": part.grid, "config": config}
    rules.sparkSession.createDataFrame([(json.dumps(head),)], "header string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")


def load_model(spark: SparkSession, folder: str) -> tuple[Partition, DataFrame, dict]:
    head = json.loads(spark.read.text(f"{folder}/header").head()[0])
    tuples = lambda s: {**s, "p": tuple(s["p"]), "more": tuple((m, tuple(p)) for m, p in s["more"])}
    part = Partition(tuple(FuzzySet(**tuples(s)) for s in head["sets"]), head["lo"], head["hi"], tuple(head["grid"]) if head["grid"] else None)
    return part, spark.read.parquet(f"{folder}/rules"), head["config"]


def append_results(df: DataFrame, path: str, schema: T.StructType = BENCHMARKS) -> None:
    """Results to a Parquet store; columns are cast to the store's schema, and missing ones are NULL."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    df.select(*cols).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, where: str | Column | None = None) -> DataFrame:
    """Results of a store; the condition reaches the files."""
    df = spark.read.parquet(path)
    return df if where is None else df.where(where)


def to_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def to_json(df: DataFrame, path: str) -> None:
    """Statistics of a search, appended."""
    df.write.mode("append").json(path)


def find_best(results: DataFrame, measure: str, keys=("model", "fts_order"), ascending: bool = True) -> DataFrame:
    """The best row of each group for a measure; equal values go by id."""
    order = F.col("value").asc() if ascending else F.col("value").desc()
    w = Window.partitionBy(*keys).orderBy(order, "id")
    return results.where(F.col("measure") == measure).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
