"""The N first rows of every group in a fixed order, for groups of any size.

Hot-cold split: exact group counts (a map-side combined aggregation) tell heavy groups from light ones.  Light groups go
through an ordinary window.  Rows of heavy groups get a range number from percentiles of the first order column; the exact
counts of the ranges tell how many of them, from the lowest on, hold the N first rows, and only rows of those are sorted: by
(group, range, hash salt), cut to N each, and then to N a group.  Ties in the order column can't gather in one task because
of the salt.  Both parts are united.  Spark cuts each window's input to N rows a partition key before it shuffles
(WindowGroupLimit).

A group is heavy above ``heavy_rows`` rows and above a MAX_HEAVY-th of all rows, so there are fewer than MAX_HEAVY of them;
that proves the bound of what is broadcast: one row a heavy group, or a row for each of its ranges.
The rows are read by several passes and so are written once, to the shared checkpoint folder.

Defined results: the order is that of the order columns, ascending, NULLs last; the last of them should be unique, else
rows equal in all are taken in an unspecified order; a NULL in a group column makes a group like any other; no group is
dropped, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sfumato.session import cut

#: Fewer groups than this are heavy, by definition.
MAX_HEAVY = 10_000


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, heavy_rows: int = 20_000, ranges: int = 16, salts: int = 4,
) -> DataFrame:
    """df's rows of rank 1 to n within the group, with the rank in ``rnk`` (in place of a column of that name)."""
    # The row travels as one value beside its keys, so that no column of df can clash with the operator's own.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "rnk"))
    gs, os_ = [f"g{i}" for i in range(len(group))], [f"o{i}" for i in range(len(order))]
    src = df.select(*(F.col(f"`{c}`").alias(g) for c, g in zip(group, gs, strict=True)), *(F.col(f"`{c}`").alias(o) for c, o in zip(order, os_, strict=True)), row.alias("row"))
    keys = [F.col(o).asc_nulls_last() for o in os_]
    src = cut(src)
    least = max(heavy_rows, src.count() // MAX_HEAVY)
    heavy = cut(src.groupBy(*gs).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least).select(*gs))

    def ranked(x: DataFrame, by: Sequence[str]) -> DataFrame:
        return x.withColumn("rnk", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("rnk") <= n)

    if heavy.isEmpty():
        return ranked(src, gs).select("row.*", "rnk")

    def bounded(small: DataFrame) -> DataFrame:
        """A table of bounded size for joins with the group columns, which are named h_... in it."""
        return F.broadcast(small.withColumnsRenamed({g: f"h_{g}" for g in gs}))

    on = [F.col(g).eqNullSafe(F.col(f"h_{g}")) for g in gs]
    split = bounded(heavy)
    cold, hot = src.join(split, on, "left_anti"), src.join(split, on, "left_semi")
    if df.schema[order[0]].dataType.typeName() not in ("string", "binary", "boolean"):
        cuts = bounded(cut(hot.groupBy(*gs).agg(F.percentile_approx("o0", [i / ranges for i in range(1, ranges)], 1000).alias("cuts"))))
        bucket = F.when(F.col("o0").isNull(), F.lit(ranges)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("o0"))))
        hot = hot.join(cuts, on).drop(*(f"h_{g}" for g in gs)).withColumn("bucket", bucket).drop("cuts")
        # Ranges before which there are fewer than n rows; at most ranges + 1 rows a heavy group.
        sizes = hot.groupBy(*gs, "bucket").agg(F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.partitionBy(*gs).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        needed = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).select(*gs, F.col("bucket").alias("h_bucket"))
        hot = hot.join(bounded(cut(needed)), [*on, F.col("bucket") == F.col("h_bucket")], "left_semi")
    else:  # only numbers and times have percentiles; the salt alone shares other columns out
        hot = hot.withColumn("bucket", F.lit(0))
    parts = ranked(hot.withColumn("salt", F.pmod(F.xxhash64(*os_), F.lit(salts))), [*gs, "bucket", "salt"]).drop("rnk", "bucket", "salt")
    return ranked(cold, gs).unionByName(ranked(parts, gs)).select("row.*", "rnk")
