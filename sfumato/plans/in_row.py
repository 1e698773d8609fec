"""Forecasts within the row, for grids of triangles and rule tables of a bounded size.

On a grid at most two sets fire for a value, so the paths of a row are a fixed number of slots, written out as plain columns;
the rules are literal arrays addressed by a path's number.  A forecast is then a projection: after the lags nothing is
exploded, joined or shuffled.  Where the bounds don't hold the models use a join with the rule table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import with_slots
from sfumato.operators.partition import Partition
from sfumato.operators.series import with_lags

#: Rule tables of at most so many possible rows become literals, and rows have at most so many paths.
RULES, PATHS = 20_000, 16


def fits(parts: Sequence[Partition], columns: int = 1) -> bool:
    """Whether models over these partitions (one a place of the path) can be evaluated within the row."""
    return all(p.grid is not None for p in parts) and 2 ** len(parts) <= PATHS and math.prod(map(len, parts)) * columns <= RULES


def lagged(df: DataFrame, part: Partition, lags: Sequence[int], alpha: float = 0.0, x: str | Column = "x", keys: Sequence[str] = (), rhs: bool = False) -> DataFrame:
    """keys, t, s_<lag> (slots) of every target whose inputs are all there; with rhs also its own slots s, else the step
    after the last row is a target too.  The sets are found before the lags, once a row."""
    src = with_slots(df.select(*keys, "t", (F.col(x) if isinstance(x, str) else x).alias("x")), part, "x", "s", alpha).drop("x")
    if not rhs:
        end = src.groupBy(*keys).agg((F.max("t") + 1).alias("t")) if keys else src.agg((F.max("t") + 1).alias("t"))
        src = src.unionByName(end.withColumn("s", F.lit(None).cast(src.schema["s"].dataType)))
    src = with_lags(src, ["s"], list(lags), keys)
    for o in lags:
        src = src.where(F.col(f"s_{o}").isNotNull())
    return src.where(F.col("s").isNotNull()) if rhs else src.drop("s")


class Paths:
    """The paths of a row over slots made by with_slots: numbers and degrees as columns n<c> and u<c>.

    A path that isn't there has NULL in its number and the degree 0.
    """

    def __init__(self, df: DataFrame, keep: Sequence[str], slots: Sequence[str], parts: Sequence[Partition], weight: str = "min"):
        sizes = [len(p) for p in parts]
        picks = list(itertools.product("ab", repeat=len(slots)))
        self.range = range(len(picks))
        cols = []
        for c, pick in enumerate(picks):
            ix = [F.col(f"{s}.{k}") for s, k in zip(slots, pick, strict=True)]
            mu = [F.col(f"{s}.{k}mu") for s, k in zip(slots, pick, strict=True)]
            number = ix[0].cast("bigint") if math.prod(sizes) >= 1 << 31 else ix[0]
            for i, n in zip(ix[1:], sizes[1:], strict=True):
                number = number * n + i
            degree = mu[0]
            for m in mu[1:]:
                degree = F.when(m < degree, m).otherwise(degree) if weight == "min" else degree * m
            there = pick.count("b") == 0 or number.isNotNull()
            cols += [number.alias(f"n{c}"), (degree if there is True else F.when(there, degree).otherwise(0.0)).alias(f"u{c}")]
        self.df = df.select(*keep, *cols)

    def number(self, c: int) -> Column:
        return F.col(f"n{c}")

    def degree(self, c: int) -> Column:
        return F.col(f"u{c}")

    def sum(self, value: Callable[[int], Column]) -> Column:
        """Sum over the paths that are there."""
        out = F.coalesce(value(0), F.lit(0.0))
        for c in self.range[1:]:
            out = out + F.coalesce(value(c), F.lit(0.0))
        return out


class Rules:
    """A rule table as literal arrays by the path's number.

    Paths without a rule have what `otherwise` gives for the path, by column, or NaN, which get() turns into NULL.
    """

    def __init__(self, table: DataFrame | dict, sizes: Sequence[int], columns: Sequence[str], otherwise: dict[str, Callable[[tuple[int, ...]], float]] | None = None):
        """table: path and the columns, one row a path, or the same as a dictionary of lists."""
        self.given = otherwise or {}
        known = table
        if isinstance(table, DataFrame):
            known = {tuple(r["path"]): [r[c] for c in columns] for r in table.select("path", *columns).limit(math.prod(sizes)).collect()}
        values: dict[str, list[str]] = {c: [] for c in columns}
        for path in itertools.product(*map(range, sizes)):
            row = known.get(path)
            for k, c in enumerate(columns):
                v = row[k] if row else self.given[c](path) if c in self.given else None
                values[c].append("NaN" if v is None else repr(float(v)))
        self.arrays = {c: literal(v) for c, v in values.items()}

    def get(self, column: str, number: Column) -> Column:
        """The rule's value; NULL for a NULL number."""
        v = F.get(self.arrays[column], number)
        return v if column in self.given else F.nanvl(v, F.lit(None).cast("double"))


def literal(numbers: Sequence[str]) -> Column:
    """An array of doubles from their texts; the optimizer folds it to a constant."""
    return F.split(F.lit(",".join(numbers)), ",").cast("array<double>")


def lagged_paths(df: DataFrame, part: Partition, lags: Sequence[int], weight: str = "min", alpha: float = 0.0, x: str | Column = "x") -> Paths:
    """Paths of each target, oldest lag first."""
    order = sorted(lags, reverse=True)
    return Paths(lagged(df, part, lags, alpha, x), ["t"], [f"s_{o}" for o in order], [part] * len(order), weight)


def counted(src: DataFrame, slots: Sequence[str], parts: Sequence[Partition], mass: bool = False) -> DataFrame:
    """path, rhs_ix and n, their number of rows, or mass, the sum of their degrees' products; the last slots are the right side.

    A row's rules are numbers in one array, so that rows are exploded once and grouped by a number.
    """
    p = Paths(src, [], slots, parts, "product")
    if mass:
        each = p.df.select(F.explode(F.array(*(F.struct(p.number(c).alias("k"), p.degree(c).alias("v")) for c in p.range))).alias("r")).select("r.k", "r.v")
        got = each.where(F.col("k").isNotNull()).groupBy("k").agg(F.sum("v").alias("mass"))
    else:
        each = p.df.select(F.explode(F.array(*(p.number(c) for c in p.range))).alias("k"))
        got = each.where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    *path, rhs = places("k", [len(x) for x in parts])
    return got.select(F.array(*path).alias("path"), rhs.alias("rhs_ix"), "mass" if mass else "n")


def places(number: str, sizes: Sequence[int]) -> list[Column]:
    """The sets of a path from its number."""
    out, step = [], 1
    for n in reversed(sizes):
        out.insert(0, (F.expr(f"{number} div {step}") % n).cast("int"))
        step *= n
    return out


def rules(df: DataFrame, part: Partition, lags: Sequence[int], alpha: float = 0.0, x: str | Column = "x", mass: bool = False) -> DataFrame:
    """counted() of the paths of lags and their successors."""
    order = sorted(lags, reverse=True)
    return counted(lagged(df, part, lags, alpha, x, rhs=True), [*(f"s_{o}" for o in order), "s"], [part] * (len(order) + 1), mass)


def learns(parts: Sequence[Partition]) -> bool:
    """Whether rules over these partitions (the right side among them) can be counted by number."""
    return all(p.grid is not None for p in parts) and 2 ** len(parts) <= 2 * PATHS and math.prod(map(len, parts)) < 1 << 53
