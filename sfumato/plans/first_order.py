"""First-order models: one rule midpoint a set, joined to the set of greatest degree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import fired, maximum, with_slots
from sfumato.operators.partition import Partition
from sfumato.operators.rules import nonrecurrent, occurrence, small, transitions
from sfumato.plans import in_row


def _mean(df: DataFrame, weight) -> DataFrame:
    return df.groupBy("lhs").agg((F.sum(weight * F.col("c")) / F.sum(weight)).alias("mid"))


def chen_rules(tr: DataFrame, part: Partition) -> DataFrame:
    return nonrecurrent(tr).withColumn("c", part.centroid(F.col("rhs"))).groupBy("lhs").agg(F.avg("c").alias("mid"))


def frequency_rules(tr: DataFrame, part: Partition) -> DataFrame:
    """Relative frequencies: the improved weighted and the Markov model."""
    counts = tr.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n"))
    return _mean(counts.withColumn("c", part.centroid(F.col("rhs"))), F.col("n"))


def yu_rules(tr: DataFrame, part: Partition) -> DataFrame:
    """Weights 1, 2, ... in time order."""
    return _mean(occurrence(tr, ["lhs"]).withColumn("c", part.centroid(F.col("rhs"))), F.col("k"))


def cheng_rules(tr: DataFrame, part: Partition) -> DataFrame:
    """Weights count occurrences within the upward, downward and level transitions."""
    return _mean(occurrence(tr, ["lhs", F.signum(F.col("rhs") - F.col("lhs"))]).withColumn("c", part.centroid(F.col("rhs"))), F.col("k"))


def sadaei_rules(tr: DataFrame, part: Partition, base: float = 1.1) -> DataFrame:
    """Weights base ** k, brought to base ** (k - n) so that long series don't overflow."""
    ks = occurrence(tr, ["lhs"])
    n = tr.groupBy("lhs").agg(F.count(F.lit(1)).alias("n"))
    df = ks.join(small(n, len(part)), "lhs").withColumn("c", part.centroid(F.col("rhs")))
    return _mean(df, F.pow(F.lit(base), F.col("k") - F.col("n")))


RULES = {"chen": chen_rules, "ismail_efendi": frequency_rules, "tsaur": frequency_rules, "yu": yu_rules, "cheng": cheng_rules, "sadaei": sadaei_rules}


@dataclass
class FirstOrder:
    """A fitted model: its partition, its rules (lhs, mid) and the horizon they are for."""

    part: Partition
    rules: DataFrame
    h: int = 1

    def predict(self, df: DataFrame, x: str = "x") -> DataFrame:
        """target_t and yhat for every row; a set without rule forecasts its own centroid."""
        f = df.select("t", maximum(self.part, F.col(x)).alias("lhs"))
        joined = f.join(small(self.rules, len(self.part)), "lhs", "left")
        return joined.select((F.col("t") + self.h).alias("target_t"), F.coalesce("mid", self.part.centroid(F.col("lhs"))).alias("yhat"))

    def explain(self, df: DataFrame, x: str = "x") -> DataFrame:
        """The fuzzification, the rule and the result of each row."""
        f = df.select("t", F.col(x).alias("x"), maximum(self.part, F.col(x)).alias("lhs"))
        out = f.join(small(self.rules, len(self.part)), "lhs", "left")
        return out.withColumn("unseen", F.col("mid").isNull()).withColumn("yhat", F.coalesce("mid", self.part.centroid(F.col("lhs"))))


def fit(df: DataFrame, part: Partition, method: str = "chen", h: int = 1, x: str = "x") -> FirstOrder:
    return FirstOrder(part, RULES[method](transitions(df, part, h, x=x), part), h)


def ahead(model: FirstOrder, df: DataFrame, steps: int) -> DataFrame:
    """target_t, horizon, yhat: each row's own forecast fed back `steps` times.

    The set of a forecast depends on the set before only, so a step is a join with the map set -> (yhat, next set), which
    has one row a set.  A forecast midway between two sets belongs to the lower one, whatever the last digits say.
    """
    part, spark = model.part, df.sparkSession
    known = {r["lhs"]: r["mid"] for r in model.rules.collect()}
    mids = [known.get(i, s.centroid) for i, s in enumerate(part.sets)]
    nxt = [max(range(len(part)), key=lambda j, m=m: (round(part.sets[j].degree(m), 9), -j)) for m in mids]
    table, at = [], list(range(len(part)))
    for k in range(1, steps + 1):
        table += [(i, k, mids[a]) for i, a in enumerate(at)]
        at = [nxt[a] for a in at]
    steps_df = spark.createDataFrame(table, "lhs int, horizon int, yhat double")
    f = df.select("t", maximum(part, F.col("x")).alias("lhs"))
    return f.join(F.broadcast(steps_df), "lhs").select((F.col("t") + F.col("horizon")).alias("target_t"), "horizon", "yhat")


def song_rules(tr: DataFrame, part: Partition) -> DataFrame:
    """R as rows (i, j, r): the union of min(mu_l, mu_r) at the centroids over the distinct transitions."""
    n = len(part)
    at = [[s.degree(other.centroid) for other in part.sets] for s in part.sets]  # at[s][i]: degree of centroid i in set s
    rows = [(s, i, at[s][i]) for s in range(n) for i in range(n) if at[s][i] > 0]
    mu = tr.sparkSession.createDataFrame(rows, "s int, i int, mu double")
    left = mu.select(F.col("s").alias("lhs"), "i", F.col("mu").alias("mu_l"))
    right = mu.select(F.col("s").alias("rhs"), F.col("i").alias("j"), F.col("mu").alias("mu_r"))
    pairs = nonrecurrent(tr).join(F.broadcast(left), "lhs").join(F.broadcast(right), "rhs")
    return pairs.groupBy("i", "j").agg(F.max(F.least("mu_l", "mu_r")).alias("r"))


def song_predict(df: DataFrame, relation: DataFrame, part: Partition, x: str = "x") -> DataFrame:
    """Max-min composition, then the mean centroid of the sets of greatest degree; within the row where the relation is small."""
    if in_row.fits([part, part]):
        return _song_in_row(df, relation, part, x)
    f = df.select("t", F.explode(fired(part, F.col(x))).alias("f")).select("t", F.col("f.set_ix").alias("i"), "f.mu")
    y = f.join(small(relation, len(part) ** 2), "i").groupBy("t", "j").agg(F.max(F.least("mu", "r")).alias("y"))
    best = y.withColumn("best", F.max("y").over(Window.partitionBy("t"))).where((F.col("y") == F.col("best")) & (F.col("y") > 0))
    mean = best.groupBy("t").agg(F.avg(part.centroid(F.col("j"))).alias("yhat"))
    own = df.select("t", part.centroid(maximum(part, F.col(x))).alias("own"))
    return own.join(mean, "t", "left").select((F.col("t") + 1).alias("target_t"), F.coalesce("yhat", "own").alias("yhat"))


def _song_in_row(df: DataFrame, relation: DataFrame, part: Partition, x: str) -> DataFrame:
    n = len(part)
    cells = {(r["i"], r["j"]): r["r"] for r in relation.limit(n * n).collect()}
    rows = F.array(*(in_row.literal([repr(float(cells.get((i, j), 0.0))) for j in range(n)]) for i in range(n)))
    src = with_slots(df.select("t", F.col(x).cast("double").alias("x")), part, "x", "s")
    # Array functions keep the code of a row small, whatever the number of sets.
    low = F.transform(F.get(rows, F.col("s.a")), lambda r: F.least(r, F.col("s.amu")))
    both = F.zip_with(low, F.transform(F.get(rows, F.col("s.b")), lambda r: F.least(r, F.col("s.bmu"))), lambda a, b: F.greatest(a, b))
    src = src.select("t", "x", F.when(F.col("s.b").isNull(), low).otherwise(both).alias("y")).withColumn("best", F.array_max("y"))
    hit = F.filter(F.transform("y", lambda y, j: F.when((y == F.col("best")) & (y > 0), part.centroid(j))), lambda c: c.isNotNull())
    src = src.select("t", "x", hit.alias("hit"))
    mean = F.try_divide(F.aggregate("hit", F.lit(0.0), lambda a, c: a + c), F.size("hit"))
    return src.select((F.col("t") + 1).alias("target_t"), F.coalesce(mean, part.centroid(maximum(part, F.col("x")))).alias("yhat"))
