"""Multivariate models: a left side is one set of each variable, its degree the least of theirs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import maximum, with_fired, with_slots
from sfumato.operators.partition import MAX_SETS, Partition
from sfumato.operators.rules import small
from sfumato.operators.series import with_lags
from sfumato.plans import in_row

#: Labels whose scores are columns of the row.
INLINE_CLASSES = 64


@dataclass(frozen=True)
class Variable:
    """A column with its sets; transform is applied to it first."""

    name: str
    col: Column
    part: Partition
    alpha: float = 0.0


def _fuzzy(df: DataFrame, variables: Sequence[Variable], keep: Sequence[str]) -> DataFrame:
    """keep and f0, f1, ...: the fired sets of each variable."""
    src = df.select(*keep, *(v.col.alias(f"_v{i}") for i, v in enumerate(variables)))
    for i, v in enumerate(variables):
        src = with_fired(src, v.part, f"_v{i}", f"f{i}", v.alpha)
    return src.select(*keep, *(f"f{i}" for i in range(len(variables))))


def size(variables: Sequence[Variable]) -> int:
    n = 1
    for v in variables:
        n *= len(v.part)
    return n


def combos(df: DataFrame, variables: Sequence[Variable], keep: Sequence[str]) -> DataFrame:
    """keep, path (array of sets by variable), mu, own (the target's set if the first variable is the target)."""
    src = _fuzzy(df, variables, keep)
    for i in range(len(variables)):
        src = src.withColumn(f"s{i}", F.explode(f"f{i}"))
    mu = F.least(*(F.col(f"s{i}.mu") for i in range(len(variables)))) if len(variables) > 1 else F.col("s0.mu")
    return src.select(*keep, F.array(*(F.col(f"s{i}.set_ix") for i in range(len(variables)))).alias("path"), mu.alias("mu"))


def rules(df: DataFrame, variables: Sequence[Variable], target: Variable, weighted: bool = False, h: int = 1) -> DataFrame:
    """path, mid, lower, upper, n over the target's sets h rows later."""
    if in_row.learns([*(v.part for v in variables), target.part]):
        seen = _count_in_row(df, variables, target, h).withColumnRenamed("rhs_ix", "j")
        return _rule_table(seen, target, weighted)
    own = with_fired(df.withColumn("_t", target.col), target.part, "_t", "_g", target.alpha)
    src = with_lags(own, ["_g"], [-h]) if h else own.withColumn("_g_0", F.col("_g"))
    src = src.where(F.col(f"_g_{-h}").isNotNull())
    seen = combos(src, variables, ["t", f"_g_{-h}"]).select("path", F.explode(f"_g_{-h}").alias("g"))
    return _rule_table(seen.groupBy("path", F.col("g.set_ix").alias("j")).agg(F.count(F.lit(1)).alias("n")), target, weighted)


def _count_in_row(df: DataFrame, variables: Sequence[Variable], target: Variable, h: int) -> DataFrame:
    """path, rhs_ix, n: slots are found before the target's are laid beside those of the row h earlier."""
    src = df.select("t", *(v.col.alias(f"_v{i}") for i, v in enumerate(variables)), target.col.alias("_g"))
    names = [f"s{i}" for i in range(len(variables))]
    for i, v in enumerate(variables):
        src = with_slots(src, v.part, f"_v{i}", names[i], v.alpha)
    src = with_slots(src, target.part, "_g", "g", target.alpha).select("t", *names, "g")
    src = with_lags(src, ["g"], [-h]).withColumn("g", F.col(f"g_{-h}")) if h else src
    for c in (*names, "g"):
        src = src.where(F.col(c).isNotNull())
    return in_row.counted(src, [*names, "g"], [*(v.part for v in variables), target.part])


def _rule_table(seen: DataFrame, target: Variable, weighted: bool) -> DataFrame:
    p = target.part
    c, lo, up, n = p.centroid(F.col("j")), p.lower(F.col("j")), p.upper(F.col("j")), F.sum("n")
    if weighted:
        return seen.groupBy("path").agg((F.sum(F.col("n") * c) / n).alias("mid"), (F.sum(F.col("n") * lo) / n).alias("lower"), (F.sum(F.col("n") * up) / n).alias("upper"), n.alias("n"))
    return seen.groupBy("path").agg(F.avg(c).alias("mid"), F.min(lo).alias("lower"), F.max(up).alias("upper"), n.alias("n"))


def forecast(df: DataFrame, variables: Sequence[Variable], target: Variable, rule_table: DataFrame, h: int = 1) -> DataFrame:
    """target_t, yhat, lower, upper; an unseen left side gives the target's own set if the target is among the variables."""
    at = next((i for i, v in enumerate(variables) if v.name == target.name), None)
    if in_row.fits([v.part for v in variables]):
        return _forecast_in_row(df, variables, target, rule_table, h, at)
    j = combos(df, variables, ["t"]).join(small(rule_table, size(variables)), "path", "left")
    own = (lambda pick: pick(F.get("path", F.lit(at)))) if at is not None else (lambda pick: F.lit(0.0))
    mu, n = F.col("mu"), F.sum("mu")
    p = target.part
    return j.groupBy((F.col("t") + h).alias("target_t")).agg(
        (F.sum(mu * F.coalesce("mid", own(p.centroid))) / n).alias("yhat"), (F.sum(mu * F.coalesce("lower", own(p.lower))) / n).alias("lower"),
        (F.sum(mu * F.coalesce("upper", own(p.upper))) / n).alias("upper"))


def _row_paths(df: DataFrame, variables: Sequence[Variable], keep: Sequence[str]) -> in_row.Paths:
    src = df.select(*keep, *(v.col.alias(f"_v{i}") for i, v in enumerate(variables)))
    for i, v in enumerate(variables):
        src = with_slots(src, v.part, f"_v{i}", f"s{i}", v.alpha).where(F.col(f"s{i}").isNotNull())
    return in_row.Paths(src, keep, [f"s{i}" for i in range(len(variables))], [v.part for v in variables])


def _forecast_in_row(df: DataFrame, variables: Sequence[Variable], target: Variable, rule_table: DataFrame, h: int, at: int | None) -> DataFrame:
    p, sets = _row_paths(df, variables, ["t"]), target.part
    own = {c: (lambda k, c=c: getattr(sets[k[at]], c) if at is not None else 0.0) for c in ("centroid", "lower", "upper")}
    own["mid"] = own.pop("centroid")
    r = in_row.Rules(rule_table, [len(v.part) for v in variables], ("mid", "lower", "upper"), own)
    src = p.df.withColumn("_n", p.sum(p.degree))
    mean = lambda col: p.sum(lambda c: p.degree(c) * r.get(col, p.number(c))) / F.col("_n")
    return src.select((F.col("t") + h).alias("target_t"), mean("mid").alias("yhat"), mean("lower").alias("lower"), mean("upper").alias("upper"))


def class_rules(df: DataFrame, variables: Sequence[Variable], label: str) -> DataFrame:
    """path, class, share: frequencies of the labels of each left side."""
    parts = [v.part for v in variables]
    if in_row.learns(parts):
        p = _row_paths(df, variables, [label])
        each = p.df.select(F.col(label).alias("class"), F.explode(F.array(*(p.number(c) for c in p.range))).alias("n")).where(F.col("n").isNotNull())
        seen = each.groupBy("n", "class").agg(F.count(F.lit(1)).alias("k")).select(F.array(*in_row.places("n", list(map(len, parts)))).alias("path"), "class", "k")
    else:
        seen = combos(df, variables, [label]).groupBy("path", F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("k"))
    return seen.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("path")))


def classify(
    df: DataFrame, variables: Sequence[Variable], rule_table: DataFrame, key: str = "t", activation: str = "scale", weights: dict[str, float] | None = None, classes: int = 100,
) -> DataFrame:
    """key, class, p: scores sum(share * mu), brought to probabilities by 'scale', 'softmax' or 'argmax'.

    Labels are few: up to INLINE_CLASSES of them have a column of scores each, and a row isn't shuffled; else scores are grouped.
    """
    sizes = [len(v.part) for v in variables]
    if in_row.fits([v.part for v in variables], INLINE_CLASSES):
        most = math.prod(sizes) * INLINE_CLASSES
        rows = rule_table.select("path", "class", "share").limit(most + 1).collect()
        labels = sorted({r["class"] for r in rows}, key=lambda x: (x is not None, x))
        if len(rows) <= most and len(labels) <= INLINE_CLASSES:
            return _classify_in_row(df, variables, rows, labels, rule_table.schema["class"].dataType, key, activation, weights)
    j = combos(df, variables, [key]).join(small(rule_table, size(variables) * classes), "path")
    score = F.sum(F.col("share") * F.col("mu"))
    s = j.groupBy(key, "class").agg(score.alias("score"))
    if weights:
        s = s.withColumn("score", F.col("score") * F.coalesce(F.get(F.array(*(F.lit(w) for w in weights.values())), F.array_position(F.array(*map(F.lit, weights)), F.col("class")).cast("int") - 1), F.lit(1.0)))
    w = Window.partitionBy(key)
    if activation == "argmax":
        best = F.row_number().over(w.orderBy(F.col("score").desc(), "class"))
        return s.withColumn("_r", best).where("_r = 1").select(key, "class", F.lit(1.0).alias("p"))
    e = F.exp("score") if activation == "softmax" else F.col("score")
    return s.select(key, "class", (e / F.sum(e).over(w)).alias("p"))


def _classify_in_row(df: DataFrame, variables: Sequence[Variable], rows: list, labels: list, kind, key: str, activation: str, weights: dict[str, float] | None) -> DataFrame:
    p = _row_paths(df, variables, [key])
    sizes = [len(v.part) for v in variables]
    shares = [in_row.Rules({tuple(r["path"]): [r["share"]] for r in rows if r["class"] == x}, sizes, ("share",)) for x in labels]
    score = [p.sum(lambda c, r=r: p.degree(c) * r.get("share", p.number(c))) for r in shares]
    known = lambda i, v: F.when(F.col(f"_s{i}") > 0, v)  # noqa: E731  a class without a share in the row's paths has no row
    src = p.df.select(key, *(s.alias(f"_s{i}") for i, s in enumerate(score)))
    if weights:
        src = src.withColumns({f"_s{i}": F.col(f"_s{i}") * weights.get(x, 1.0) for i, x in enumerate(labels)})
    every = range(len(labels))
    if activation == "argmax":
        best = F.array_max(F.array(*(known(i, F.struct(F.col(f"_s{i}").alias("s"), F.lit(-i).alias("i"))) for i in every)))
        return src.withColumn("_b", best).where(F.col("_b").isNotNull()).select(key, F.get(F.array(*map(F.lit, labels)), -F.col("_b.i")).cast(kind).alias("class"), F.lit(1.0).alias("p"))
    src = src.withColumns({f"_e{i}": known(i, F.exp(f"_s{i}") if activation == "softmax" else F.col(f"_s{i}")) for i in every})
    total = sum((F.coalesce(f"_e{i}", F.lit(0.0)) for i in every), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(x).cast(kind).alias("class"), (F.col(f"_e{i}") / total).alias("p")) for i, x in enumerate(labels)))
    return src.select(key, F.inline(each)).where(F.col("p").isNotNull())


def clusters(df: DataFrame, variables: Sequence[Variable], seen_only: DataFrame | None = None, k: int = 2, keep: Sequence[str] = ("t",)) -> DataFrame:
    """keep, f: the k combinations of greatest degree as symbols, array<struct<path, mu>>; seen_only prunes by a table of paths."""
    c = combos(df, variables, keep)
    if seen_only is not None:
        c = c.join(small(seen_only.select("path").distinct(), size(variables)), "path", "left_semi")
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col("mu"), F.col("path"))), asc=False), 1, k)
    return c.groupBy(*keep).agg(top.alias("f"))


def cluster_rules(symbols: DataFrame, target: Variable, at: int = 0, lags: Sequence[int] = (1,)) -> DataFrame:
    """key (array of paths, oldest first), mid: frequency-weighted centroid of the target over the next symbols."""
    o = with_lags(symbols, ["f"], list(lags))
    for lag in lags:
        o = o.where(F.col(f"f_{lag}").isNotNull())
    order = sorted(lags, reverse=True)
    for lag in order:
        o = o.withColumn(f"s_{lag}", F.explode(f"f_{lag}"))
    o = o.withColumn("s", F.explode("f"))
    key = F.array(*(F.col(f"s_{lag}.path") for lag in order))
    return o.groupBy(key.alias("key")).agg(F.avg(target.part.centroid(F.get(F.col("s.path"), F.lit(at)))).alias("mid"), F.count(F.lit(1)).alias("n"))


def cluster_forecast(symbols: DataFrame, rule_table: DataFrame, target: Variable, at: int = 0, lags: Sequence[int] = (1,)) -> DataFrame:
    """target_t, yhat: mean over the paths of symbols; an unseen path gives the newest symbol's own centroid."""
    lagged = [lag - 1 for lag in lags]
    o = with_lags(symbols.withColumn("f_0", F.col("f")), ["f"], [x for x in lagged if x])
    for x in lagged:
        o = o.where(F.col(f"f_{x}").isNotNull())
    order = sorted(lagged, reverse=True)
    for x in order:
        o = o.withColumn(f"s_{x}", F.explode(f"f_{x}"))
    o = o.select("t", F.array(*(F.col(f"s_{x}.path") for x in order)).alias("key"), F.get(F.col(f"s_{order[-1]}.path"), F.lit(at)).alias("own"))
    j = o.join(rule_table, "key", "left")
    return j.groupBy((F.col("t") + 1).alias("target_t")).agg(F.avg(F.coalesce("mid", target.part.centroid(F.col("own")))).alias("yhat"))


def cluster_partition(variables: Sequence[Variable], target: Variable) -> Partition:
    """The product of the variables' sets as one partition: set number i * n2 * ... + j * ... + k has the target's set."""
    at = next(i for i, v in enumerate(variables) if v.name == target.name)
    sets = [replace(combo[at], name="".join(s.name for s in combo)) for combo in itertools.product(*(v.part.sets for v in variables))]
    if len(sets) > MAX_SETS:
        raise ValueError("too many combinations")
    return Partition(tuple(sets), target.part.lo, target.part.hi)


def cluster_symbols(df: DataFrame, variables: Sequence[Variable], k: int = 2) -> DataFrame:
    """t and f: the k multivariate sets of greatest degree as (set_ix, mu), numbered as in cluster_partition.

    The product of the fired sets is formed within the row, so nothing is shuffled.
    """
    rest = variables[1:]
    f = F.transform("f0", lambda s: F.struct(s["mu"].alias("mu"), s["set_ix"].alias("set_ix")))
    src = _fuzzy(df, variables, ["t"]).select("t", f.alias("f"), *(F.col(f"f{i + 1}").alias(f"g{i}") for i in range(len(rest))))
    def product(other: str, n: int) -> Column:
        def pair(a: Column) -> Column:
            return F.transform(other, lambda b: F.struct(F.least(a["mu"], b["mu"]).alias("mu"), (a["set_ix"] * n + b["set_ix"]).alias("set_ix")))

        return F.flatten(F.transform("f", pair))

    for i, v in enumerate(rest):
        src = src.withColumn("f", product(f"g{i}", len(v.part)))
    top = F.slice(F.sort_array("f", asc=False), 1, k)
    return src.select("t", F.transform(top, lambda s: F.struct(s["set_ix"].alias("set_ix"), s["mu"].alias("mu"))).alias("f"))


def argmax_symbols(df: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """t and the combination of each variable's set of greatest degree."""
    return df.select("t", F.array(*(maximum(v.part, v.col) for v in variables)).alias("path"))
