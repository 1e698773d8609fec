"""Attribute-value rows into one typed row per entity.

The cell of an (entity, attribute) is won by its latest row, of these the one with the greatest id.  Rows are shuffled once, by
entity, and sorted by entity, attribute and order, so that the winner is the last of its cell; builders stream over them and
collect sparse (column, row, value) triples, from which each column's typed buffer and validity mask are made when a batch of
entities is full.  Only one batch is held, whatever the number of rows, and columns without a cell cost nothing.

Entities with a great share of all rows (they are counted exactly, and by definition there are fewer than MAX_HEAVY of them)
aren't shuffled as rows: their cells are won by an aggregation that combines on the map side, and join the others afterwards.

Defined results: attributes outside of the catalogue and values that are NULL, NaN or infinite fill no cell; an entity
with no filled cell has a row of NULLs; a NULL entity is an entity like any other; whole-number columns take the nearest
whole number, and NULL where it exceeds their bits (its provenance stays); text that isn't of a column's type fills no cell;
extra columns of the input don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sfumato.operators.entries import valid

#: Entities in one batch given out by a builder, fewer where there are many columns: a batch has at most CELLS cells.
BATCH, CELLS = 4096, 1 << 22
#: Fewer entities than this are heavy, by definition; this bounds the broadcast table.
MAX_HEAVY = 10_000
_TYPES = {
    "double": T.DoubleType(), "float": T.FloatType(), "bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "string": T.StringType(),
}
_BITS = {T.LongType(): 63, T.IntegerType(): 31}


def attribute_index(df: DataFrame, key: Column, catalog: Sequence[tuple[str, str]]) -> Column:
    """Position of an attribute in the catalogue of (key, type) pairs, NULL if it isn't there."""
    pairs = F.create_map(*(x for i, (k, _) in enumerate(catalog) for x in (F.lit(k), F.lit(i))))
    return F.element_at(pairs, F.coalesce(key, F.lit("")))


def _number(df: DataFrame, value: str, ix: Column, catalog: Sequence[tuple[str, str]]) -> Column:
    """The value as a number: itself, 0 or 1 of a boolean, microseconds of a time; NULL for columns of text."""
    c = F.col(value)
    if isinstance(df.schema[value].dataType, T.NumericType):
        return c.cast("double")
    of = lambda *kinds: ix.isin([i for i, (_, k) in enumerate(catalog) if k in kinds])
    number = F.when(of("boolean"), c.try_cast("boolean").cast("double")).when(of("timestamp"), F.unix_micros(c.try_cast("timestamp")).cast("double"))
    return number.when(of("string"), F.lit(None)).otherwise(c.try_cast("double"))


def cell_rows(
    df: DataFrame, entity: Sequence[str], index: Column, value: str, order: Sequence[str], catalog: Sequence[tuple[str, str]], heavy_rows: int = 100_000,
) -> DataFrame:
    """entity, _ix, _v (number), _s (text, where the catalogue has such columns) and the order columns of rows that may fill
    a cell: all rows of light entities, the winners of heavy ones; _ix is NULL in rows that fill none."""
    counts = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("_rows"))
    least = F.greatest(F.lit(heavy_rows), F.coalesce(counts.agg(F.sum("_rows")).scalar() / MAX_HEAVY, F.lit(0)))
    heavy = counts.where(F.col("_rows") > least).select(*(F.col(c).alias(f"_h_{c}") for c in entity))
    texts = [i for i, (_, kind) in enumerate(catalog) if kind == "string"]
    v = _number(df, value, index, catalog)
    s = F.when(index.isin(texts), F.col(value).cast("string"))
    fills = F.when(index.isin(texts), s.isNotNull()).otherwise(valid(v))
    src = df.select(*entity, F.when(fills, index).alias("_ix"), v.alias("_v"), *([s.alias("_s")] if texts else []), *(F.col(c).alias(f"_o_{c}") for c in order))
    on = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in entity]
    light = src.join(F.broadcast(heavy), on, "left_anti")
    hot = src.join(F.broadcast(heavy), on, "left_semi")
    rest = [*(f"_o_{c}" for c in order), "_v", *(["_s"] if texts else [])]
    won = hot.groupBy(*entity, "_ix").agg(F.max(F.struct(*rest)).alias("_w")).select(*entity, "_ix", *(F.col(f"_w.{c}").alias(c) for c in rest))
    return light.unionByName(won)


def widen(cells: DataFrame, entity: Sequence[str], catalog: Sequence[tuple[str, str]], provenance: str | None = None) -> DataFrame:
    """One row an entity from the result of cell_rows: a column for each catalogued attribute, in its type.

    provenance names an order column (a long) to be laid beside each value as ``<attribute>__<provenance>``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    width, n_key = len(catalog), len(entity)
    kinds = [_TYPES[kind] for _, kind in catalog]
    fields = [cells.schema[c] for c in entity]
    fields += [T.StructField(name, kind) for (name, _), kind in zip(catalog, kinds, strict=True)]
    if provenance:
        fields += [T.StructField(f"{name}__{provenance}", T.LongType()) for name, _ in catalog]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    text = "_s" in cells.columns
    carried = ["_ix", "_v", *(["_s"] if text else []), *([f"_o_{provenance}"] if provenance else [])]
    orders = [c for c in cells.columns if c.startswith("_o_")]
    rows = cells.repartition(*entity).sortWithinPartitions(*entity, "_ix", *orders).select(*entity, *(F.col(c).cast("long").alias(c) if c.startswith("_o_") else c for c in carried))
    size = max(16, min(BATCH, CELLS // max(1, width)))

    def column(i: int, n: int, at: np.ndarray, v: np.ndarray, s: list | None) -> pa.Array:
        """Column i of n rows with the values v (or texts s) in the rows `at`."""
        if not len(at):
            return pa.nulls(n, arrow[n_key + i].type)
        kind, mask = kinds[i], np.ones(n, bool)
        if isinstance(kind, T.StringType):
            out = np.full(n, None, object)
            out[at] = [s[k] for k in range(len(at))]
            return pa.array(out, pa.string())
        mask[at] = False
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            data = np.zeros(n, np.float64 if isinstance(kind, T.DoubleType) else np.float32)
            data[at] = v
            return pa.array(data, arrow[n_key + i].type, mask=mask)
        if isinstance(kind, T.BooleanType):
            data = np.zeros(n, bool)
            data[at] = v != 0
            return pa.array(data, mask=mask)
        data, fits = np.zeros(n, np.int64), np.abs(v) < 2.0 ** _BITS.get(kind, 63)
        data[at] = np.rint(np.where(fits, v, 0)).astype(np.int64)
        mask[at[~fits]] = True
        return pa.array(data, pa.int64(), mask=mask).cast(arrow[n_key + i].type)

    def flush(keys: list[pa.RecordBatch], n: int, triples: list[tuple]) -> pa.RecordBatch:
        heads = pa.Table.from_batches(keys).combine_chunks()
        cols = [heads.column(i).combine_chunks() for i in range(n_key)]
        col, row, v, ids = (np.concatenate([t[k] for t in triples]) if triples else np.zeros(0, np.int64) for k in range(4))
        s = [x for t in triples for x in t[4]] if text else None
        last = np.append((col[1:] != col[:-1]) | (row[1:] != row[:-1]), True)[: len(col)]  # a cell may go on from one batch to the next
        by = np.flatnonzero(last)[np.argsort(col[last], kind="stable")]
        ends = np.searchsorted(col[by], np.arange(width + 1))
        mine = [by[ends[i] : ends[i + 1]] for i in range(width)]
        cols += [column(i, n, row[m], v[m], [s[k] for k in m] if text else None) for i, m in enumerate(mine)]
        if provenance:
            for m in mine:
                data, mask = np.zeros(n, np.int64), np.ones(n, bool)
                data[row[m]], mask[row[m]] = ids[m], False
                cols.append(pa.array(data, pa.int64(), mask=mask))
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        n, keys, triples, last = 0, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.select(list(range(n_key)))
            edge = np.zeros(batch.num_rows, bool)
            for i in range(n_key):
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                edge[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(i)[0].as_py() for i in range(n_key))
            edge[0] = last is None or first != last
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_key))
            starts = np.flatnonzero(edge)
            entity_no = np.cumsum(edge) - 1 + n  # place of each row's entity, counted from the open batch's start
            ix = batch.column(n_key).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(n_key + 1).fill_null(0.0).to_numpy(zero_copy_only=False)
            ids = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False) if provenance else ix
            wins = ix >= 0
            wins[:-1] &= (ix[1:] != ix[:-1]) | edge[1:]  # the last row of a cell
            done_rows, done_starts = 0, 0
            while done_rows < batch.num_rows:
                # Rows of entities that still fit; if more begin, the batch is given out first.
                stop = int(np.searchsorted(entity_no, size))
                till = int(np.searchsorted(starts, stop))
                if till > done_starts:
                    keys.append(heads.take(pa.array(starts[done_starts:till])))
                    n += till - done_starts
                use = np.flatnonzero(wins[done_rows:stop]) + done_rows
                if len(use):
                    triples.append((ix[use], entity_no[use], v[use], ids[use], batch.column(n_key + 2).take(pa.array(use)).to_pylist() if text else ()))
                done_rows, done_starts = stop, till
                if done_rows < batch.num_rows:
                    yield flush(keys, n, triples)
                    entity_no = entity_no - n
                    n, keys, triples = 0, [], []
        if n:
            yield flush(keys, n, triples)

    return rows.mapInArrow(run, schema)


def unpivot_cells(wide: DataFrame, entity: Sequence[str], catalog: Sequence[tuple[str, str]], provenance: str) -> DataFrame:
    """Filled cells of a wide table: entity, measure and the provenance."""
    cells = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(f"{name}__{provenance}").alias(provenance)) for name, _ in catalog))
    return wide.select(*entity, F.explode(F.filter(cells, lambda c: c[provenance].isNotNull())).alias("c")).select(*entity, "c.measure", f"c.{provenance}")
