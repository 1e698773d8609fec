"""One interface over the models: fit, predict (point, interval, distribution; one or several steps), explain, render."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import clip_universe
from sfumato.operators.partition import Partition, grid
from sfumato.plans import ahead, high_order
from sfumato.plans import first_order as fo
from sfumato.plans.baselines import fit_ar
from sfumato.sources import store


@dataclass(frozen=True)
class Step:
    """A value-wise transformation with its inverse, such as Box-Cox or a scale."""

    apply: Callable[[Column], Column]
    inverse: Callable[[Column], Column]


@dataclass(frozen=True)
class Model:
    """method: a first-order method, 'hofts', 'whofts', 'ifts', 'wifts', 'pwfts', 'hwang', 'naive' or 'ar'."""

    method: str = "chen"
    partitions: int = 10
    lags: tuple[int, ...] = (1,)
    h: int = 1
    steps: tuple[Step, ...] = ()
    part: Partition | None = None
    rules: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def _in(self, df: DataFrame) -> DataFrame:
        x = F.col("x")
        for s in self.steps:
            x = s.apply(x)
        return df.withColumn("x", x)

    def _out(self, df: DataFrame) -> DataFrame:
        """Inverses in reverse order on every forecast column."""
        for c in ("yhat", "lower", "upper", "bin"):
            if c in df.columns:
                y = F.col(c)
                for s in reversed(self.steps):
                    y = s.inverse(y)
                df = df.withColumn(c, y)
        return df

    def fit(self, df: DataFrame, part: Partition | None = None) -> Model:
        """Learns the rules from (t, x); without a partition a grid over the transformed values is made."""
        s = self._in(df)
        part = part or self.part or grid(s, "x", self.partitions)
        if self.method in fo.RULES:
            return replace(self, part=part, rules=fo.fit(s, part, self.method, self.h).rules)
        if self.method in ("hofts", "ifts", "whofts", "wifts"):
            return replace(self, part=part, rules=high_order.rules(s, part, self.lags, self.method[0] == "w"))
        if self.method == "pwfts":
            mass = high_order.pwfts_rules(s, part, self.lags, self.h)
            return replace(self, part=part, rules=high_order.pwfts_groups(mass, part), extra={"mass": mass})
        if self.method == "ar":
            return replace(self, part=part, extra={"ar": fit_ar(s, len(self.lags))})
        return replace(self, part=part)

    def predict(self, df: DataFrame, kind: str = "point", steps_ahead: int = 1, step_to: int | None = None, key: str | None = None) -> DataFrame:
        """kind 'point', 'interval' or 'distribution'; steps_ahead > 1 feeds forecasts back from the end of each series;
        step_to gives, for every row, the forecast of that one horizon."""
        s = self._in(df)
        s = s.withColumn("x", clip_universe(self.part, F.col("x")))
        if step_to:
            return self._out(fo.ahead(fo.FirstOrder(self.part, self.rules), s, step_to).where(F.col("horizon") == step_to))
        if steps_ahead > 1:
            key = key or "series_id"
            s = s if key in s.columns else s.withColumn(key, F.lit("series"))
            if kind == "distribution":
                return self._out(ahead.distribution_ahead(s, self.part, self.extra["mass"], self.lags, steps_ahead, key=key))
            rules = self._dictionary()
            f = ahead.interval_ahead if kind == "interval" else ahead.point_ahead
            return self._out(f(s, rules, steps_ahead, key))
        if self.method == "naive":
            return self._out(s.select((F.col("t") + 1).alias("target_t"), F.col("x").alias("yhat")))
        if self.method == "ar":
            return self._out(self.extra["ar"].forecast(s))
        if self.method == "hwang":
            return self._out(high_order.hwang(s, self.part, max(2, len(self.lags))))
        if self.method == "pwfts":
            if kind == "distribution":
                return self._out(high_order.pwfts_distribution(s, self.part, self.extra["mass"], self.lags))
            return self._out(high_order.pwfts_point(s, self.part, self.rules, self.lags))
        if self.method in fo.RULES:
            return self._out(fo.FirstOrder(self.part, self.rules, self.h).predict(s))
        return self._out(high_order.forecast(s, self.part, self.rules, self.lags))

    def _dictionary(self) -> ahead.Rules:
        if self.method in fo.RULES:
            lo, up = self.part.lower(F.col("lhs")), self.part.upper(F.col("lhs"))
            rules = self.rules.select(F.array("lhs").alias("path"), "mid", lo.alias("lower"), up.alias("upper"))
            return ahead.collect_rules(rules, self.part, (1,))
        return ahead.collect_rules(self.rules, self.part, self.lags, "probabilistic" if self.method == "pwfts" else "mean")

    def update(self, df: DataFrame) -> Model:
        """Adds the rule masses of further data (probabilistic models): sums by rule, in any order."""
        if self.method != "pwfts":
            raise ValueError("only masses can be added up")
        more = high_order.pwfts_rules(self._in(df), self.part, self.lags, self.h)
        mass = self.extra["mass"].unionByName(more).groupBy("path", "rhs_ix").agg(F.sum("mass").alias("mass"))
        return replace(self, rules=high_order.pwfts_groups(mass, self.part), extra={"mass": mass})

    def render(self) -> DataFrame:
        """Rules by midpoint, with the names of their sets."""
        names = F.array(*(F.lit(s.name) for s in self.part.sets))
        lhs = F.array("lhs") if "lhs" in self.rules.columns else F.col("path")
        return self.rules.select(F.array_join(F.transform(lhs, lambda i: F.get(names, i)), ",").alias("lhs"), "mid").orderBy("mid")

    def __len__(self) -> int:
        return self.rules.count()

    def save(self, folder: str) -> None:
        store.save_model(folder, self.part, self.rules, method=self.method, lags=list(self.lags), h=self.h)


def load(spark, folder: str, steps: Sequence[Step] = ()) -> Model:
    part, rules, config = store.load_model(spark, folder)
    return Model(config["method"], len(part), tuple(config["lags"]), config["h"], tuple(steps), part, rules)


def nearest(part: Partition, x: Column, k: int = 3) -> Column:
    """Indexes of the k sets nearest to x by (lower, centroid, upper), ties to the lower index; on a cyclic partition the
    neighbours of the ends are at the other end."""
    n = len(part)
    cost = [F.struct(sum(((x - v) * (x - v) for v in (s.lower, s.centroid, s.upper)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, s in enumerate(part.sets)]
    got = F.transform(F.slice(F.sort_array(F.array(*cost)), 1, min(k, n)), lambda s: s["i"])
    if not part.cyclic:
        return got
    first = F.element_at(got, 1)
    wrap = F.when(first == 0, F.lit(n - 1)).when(first == n - 1, F.lit(0))
    return F.when(wrap.isNotNull() & ~F.array_contains(got, F.coalesce(wrap, F.lit(-1))), F.concat(F.slice(got, 1, max(1, min(k, n) - 1)), F.array(F.coalesce(wrap, F.lit(-1))))).otherwise(got)


def quade(df: DataFrame, block: str = "dataset", item: str = "model", value: str = "value") -> DataFrame:
    """item, s, w: Quade's sums of within-block ranks weighted by the rank of the block's range.

    Ranks within a block are over its items; blocks are ranked by one row each.
    """
    w = Window.partitionBy(block)
    ranked = df.withColumns({
        "_r": F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(block, value)) - 1) / 2.0,
        "_k": F.count(F.lit(1)).over(w)})
    spans = df.groupBy(block).agg((F.max(value) - F.min(value)).alias("_span"))
    counts = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    q = counts.select("_span", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_span")) - (F.col("_n") - 1) / 2.0).alias("_q"))
    j = ranked.join(spans.join(q, "_span").select(block, "_q"), block)
    return j.groupBy(item).agg(F.sum(F.col("_q") * (F.col("_r") - (F.col("_k") + 1) / 2.0)).alias("s"), F.sum(F.col("_q") * F.col("_r")).alias("w"))
