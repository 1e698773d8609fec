"""Online rules over Structured Streaming.

Transitions need the set before, which is kept as one number a series; rule counts are an ordinary streaming aggregation.
Windows with a watermark extend what a batch does and bound the state of late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sfumato.operators.fuzzify import maximum
from sfumato.operators.partition import Partition
from sfumato.operators.rules import merge_counts


def transitions(stream: DataFrame, part: Partition, key: str = "series_id") -> DataFrame:
    """key, t, lhs, rhs of a stream of (key, t, x); rows of one key arrive in time order over the batches."""
    f = stream.select(key, "t", maximum(part, F.col("x")).alias("set_ix")).where(F.col("set_ix").isNotNull())
    kind = f.schema[key].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("t")
        before = state.get[0] if state.exists else None
        sets = pdf["set_ix"].tolist()
        lhs = [before, *sets[:-1]]
        state.update((int(sets[-1]),))
        out = pd.DataFrame({key: [k[0]] * len(sets), "t": pdf["t"].to_numpy() - 1, "lhs": lhs, "rhs": sets})
        yield out[out["lhs"].notna()].astype({"lhs": "int32", "rhs": "int32"})

    return f.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t bigint, lhs int, rhs int", "last int", "append", GroupStateTimeout.NoTimeout)


def run_rules(stream: DataFrame, part: Partition, folder: str, key: str = "series_id") -> DataFrame:
    """Counts of (lhs, rhs) from all of a stream that is there now; each micro-batch adds its counts to a table of batches.

    A repeated micro-batch replaces its own part, so counts are exact after a restart.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/rules/batch={number}")

    q = transitions(stream, part, key).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    stored = stream.sparkSession.read.parquet(f"{folder}/rules").select("lhs", "rhs", "n")
    return merge_counts(stored)


def window_statistics(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Sliding or tumbling means of (ts, x) with a watermark; later rows than that are dropped, as the watermark says."""
    w = F.window("ts", width, slide or width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "series_id") -> DataFrame:
    """Session windows by key.  Appended ones are closed by the watermark; `collect_whole` also gives those open at the end."""
    return stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def drift_state(stream: DataFrame, key: str = "series_id", memory: int = 5) -> DataFrame:
    """key, t, mean of the last `memory` differences: a residual memory of fixed size as state."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values("t")
        last, kept = state.get if state.exists else (None, [])
        out = []
        for t, x in zip(pdf["t"], pdf["x"], strict=True):
            if last is not None:
                kept = [*kept, float(x) - last][-memory:]
            last = float(x)
            out.append((k[0], t, sum(kept) / len(kept) if kept else 0.0))
        state.update((last, kept))
        yield pd.DataFrame(out, columns=[key, "t", "drift"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t bigint, drift double", "last double, kept array<double>", "append", GroupStateTimeout.NoTimeout)


def collect_stream(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives from all that is there now, as a Parquet table."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def collect_whole(df: DataFrame, folder: str) -> DataFrame:
    """What an aggregated stream gives from all that is there now, with groups that the watermark hasn't closed.

    Each micro-batch gives the whole result and replaces the one before.
    """
    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{folder}/out")  # for a stream without any batch
    q = df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def file_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """Stream of a folder of Parquet, or of what a pattern matches."""
    r = spark.readStream.schema(like.schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)
