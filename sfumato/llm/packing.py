"""Filling containers of fixed capacity with items of varying size.

First-fit decreasing: the items of a group, largest first, each go to the first bin with room for them, found in a
tournament tree over the bins' free room in log n steps.  Groups are random (a hash of the item's id) and of bounded
size, so each is packed alone; what this costs is at most one part-filled bin or so a group.  An item above the capacity
is cut into full pieces, each of which fills a bin of its own, and a rest that is packed like any other item.

Defined results: every item is assigned; items of size 0 go to the first bin of their group; NULL or negative sizes count
as 0; repeated rows are items of their own and equal sizes go by id; capacities below 1 or NULL raise or give no row; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items of one random group; a task packs whole groups.
GROUP_ITEMS = 4096
#: Kinds of containers; every item meets each of them.
MAX_KINDS = 1_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; sizes are descending and none exceeds the capacity."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    # tree[1] is the champion: the most room of any bin; the leaves are the bins, opened or not.
    tree = [capacity] * (2 * width)
    out = np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - width
        tree[node] -= size
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return out


def pack(
    items: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", container_cols: tuple[str, str] = ("size_id", "capacity"),
    group_items: int = GROUP_ITEMS, seed: int = 7, n_items: int | None = None,
) -> DataFrame:
    """One row a piece: container kind, capacity, id, piece, offset of the piece, its size, and the bin it lies in.

    containers is a table of at most MAX_KINDS kinds; more raise.  n_items, if known, saves a count of the items.
    """
    size_id, capacity = container_cols
    kinds = containers.select(F.col(size_id).alias("a"), F.col(capacity).cast("long").alias("b")).where(F.col("b") >= 1).distinct().head(MAX_KINDS + 1)
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    kind_type = T.ArrayType(T.StructType([T.StructField("a", containers.schema[size_id].dataType), T.StructField("b", T.LongType())]))
    if n_items is None:
        n_items = items.count()
    groups = max(1, -(-n_items // group_items))
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    src = items.select(F.col(id_col), size.alias("_size"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(groups)).cast("int").alias("_group"))
    # Repeated rows are items of their own, told apart by a copy number.
    src = src.groupBy(id_col, "_size", "_group").agg(F.count(F.lit(1)).alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
    # One row an item and kind of container: the few kinds are literals, so there is no join.
    literals = F.array(*(F.struct(F.lit(k["a"]).alias("a"), F.lit(k["b"]).alias("b")) for k in kinds)).cast(kind_type) if kinds else F.array().cast(kind_type)
    both = src.withColumn("_k", F.explode(literals)).select("*", F.col("_k.a").alias(size_id), F.col("_k.b").alias(capacity)).drop("_k")
    full = F.expr(f"CASE WHEN _size > {capacity} THEN _size div {capacity} ELSE 0L END")
    both = both.withColumn("_full", full).withColumn("_rest", F.col("_size") - F.col("_full") * F.col(capacity))
    whole = both.where(F.col("_full") > 0).select(
        size_id, capacity, id_col, "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("piece"),
    ).select(
        size_id, capacity, id_col, "piece", (F.col("piece") * F.col(capacity)).alias("start"), F.col(capacity).alias("size"),
        F.concat(F.lit("whole-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("-"), F.col("_copy"), F.lit("-"), F.col("piece")).alias("bin"),
    )
    rest = both.where((F.col("_rest") > 0) | (F.col("_full") == 0)).select(
        size_id, capacity, id_col, F.col("_full").alias("piece"), (F.col("_full") * F.col(capacity)).alias("start"), F.col("_rest").alias("size"), "_group",
    )
    schema = T.StructType([f for f in rest.schema if f.name != "_group"] + [T.StructField("bin", T.StringType())])

    def one(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("size", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        group = group.take(order)
        room = group[capacity][0].as_py()
        bins = first_fit_decreasing(group["size"].to_numpy(), room)
        name = pa.array([f"{group['_group'][0].as_py()}-{b}" for b in bins.tolist()], pa.string())
        return group.drop_columns(["_group"]).append_column("bin", name)

    return whole.unionByName(rest.groupBy(size_id, "_group").applyInArrow(one, schema))
