"""High-order, interval and probabilistic models over paths of lagged fuzzy sets (true lags: t - o).

``fuzzy``, a column of (set_ix, mu) arrays, stands in for the fuzzification of x, for instance by multivariate sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sfumato.operators.fuzzify import clip, degrees
from sfumato.operators.partition import Partition
from sfumato.operators.rules import paths, small
from sfumato.operators.series import with_lags
from sfumato.plans import in_row


def rules(df: DataFrame, part: Partition, lags: Sequence[int], weighted: bool, alpha: float = 0.0, fuzzy: Column | None = None) -> DataFrame:
    """path, mid, lower, upper, n: plain means and extremes over distinct successors, or means by frequency."""
    if fuzzy is None and in_row.learns([part] * (len(lags) + 1)):
        seen = in_row.rules(df, part, lags, alpha)
    else:
        seen = paths(df, part, lags, alpha, rhs=True, fuzzy=fuzzy).groupBy("path", "rhs_ix").agg(F.count(F.lit(1)).alias("n"))
    c, lo, up = part.centroid(F.col("rhs_ix")), part.lower(F.col("rhs_ix")), part.upper(F.col("rhs_ix"))
    n = F.sum("n")
    if weighted:
        return seen.groupBy("path").agg(
            (F.sum(F.col("n") * c) / n).alias("mid"), (F.sum(F.col("n") * lo) / n).alias("lower"), (F.sum(F.col("n") * up) / n).alias("upper"), n.alias("n"))
    return seen.groupBy("path").agg(F.avg(c).alias("mid"), F.min(lo).alias("lower"), F.max(up).alias("upper"), n.alias("n"))


def forecast(df: DataFrame, part: Partition, rule_table: DataFrame, lags: Sequence[int], mode: str = "mean", alpha: float = 0.0, fuzzy: Column | None = None) -> DataFrame:
    """target_t, yhat, lower, upper.  mode 'mean' averages the midpoints of the paths, 'weighted' weights them by mu.

    Within the row where the rules are few enough; else by a join, whose map side leaves one row a target.
    """
    if fuzzy is None and in_row.fits([part] * len(lags)):
        p = in_row.lagged_paths(df, part, lags, "min", alpha)
        own = {"mid": lambda k: part[k[-1]].centroid, "lower": lambda k: part[k[-1]].lower, "upper": lambda k: part[k[-1]].upper}
        r = in_row.Rules(rule_table, [len(part)] * len(lags), ("mid", "lower", "upper"), own)
        total = lambda col: p.sum(lambda c: p.degree(c) * r.get(col, p.number(c)))
        src = p.df.withColumns({"_n": p.sum(p.degree), "_k": p.sum(lambda c: F.when(p.number(c).isNotNull(), 1.0))})
        y = p.sum(lambda c: r.get("mid", p.number(c))) / F.col("_k") if mode == "mean" else total("mid") / F.col("_n")
        return src.select(F.col("t").alias("target_t"), y.alias("yhat"), (total("lower") / F.col("_n")).alias("lower"), (total("upper") / F.col("_n")).alias("upper"))
    fired_paths = paths(df, part, lags, alpha, fuzzy=fuzzy)
    j = fired_paths.join(small(rule_table, len(part) ** len(lags)), "path", "left")
    mid = F.coalesce("mid", part.centroid(F.col("newest")))
    lo = F.coalesce(F.col("lower"), part.lower(F.col("newest")))
    up = F.coalesce(F.col("upper"), part.upper(F.col("newest")))
    mu = F.col("mu_min")
    y = F.avg(mid) if mode == "mean" else F.sum(mu * mid) / F.sum(mu)
    return j.groupBy(F.col("t").alias("target_t")).agg(
        y.alias("yhat"), (F.sum(mu * lo) / F.sum(mu)).alias("lower"), (F.sum(mu * up) / F.sum(mu)).alias("upper"))


def hwang(df: DataFrame, part: Partition, order: int = 2, x: str = "x") -> DataFrame:
    """No training: the mean centroid of the sets where max over w of mu(x_t) * mu(x_(t-w)) is greatest."""
    src = df.select("t", clip(part, F.col(x)).alias("x"))
    lags = list(range(1, order - 1))
    if lags:
        src = with_lags(src, ["x"], lags)
        for o in lags:
            src = src.where(F.col(f"x_{o}").isNotNull())
    now = degrees(part, F.col("x"))
    past = [F.transform(degrees(part, F.col(c)), lambda s: s["mu"]) for c in ["x", *(f"x_{o}" for o in lags)]]
    score = F.transform(now, lambda s, i: s["mu"] * (F.greatest(*(F.get(p, i) for p in past)) if len(past) > 1 else F.get(past[0], i)))
    src = src.select("t", score.alias("r"))
    best = F.array_max("r")
    total = F.aggregate(F.transform("r", lambda r, i: F.when(r == best, part.centroid(i)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    count = F.size(F.filter("r", lambda r: r == best))
    return src.select((F.col("t") + 1).alias("target_t"), (total / count).alias("yhat"))


def pwfts_rules(df: DataFrame, part: Partition, lags: Sequence[int], h: int = 1, fuzzy: Column | None = None) -> DataFrame:
    """path, rhs_ix, mass: the sum of degree products over the whole series."""
    lagged = [o + h - 1 for o in lags]
    if fuzzy is None and in_row.learns([part] * (len(lags) + 1)):
        return in_row.rules(df, part, lagged, mass=True)
    p = paths(df, part, lagged, rhs=True, fuzzy=fuzzy)
    return p.groupBy("path", "rhs_ix").agg(F.sum(F.col("mu_prod") * F.col("rhs_mu")).alias("mass"))


def pwfts_groups(mass: DataFrame, part: Partition) -> DataFrame:
    """path, f (its mass), p (its share), mid, lower, upper: conditional expectations of each left side."""
    c, lo, up = part.centroid(F.col("rhs_ix")), part.lower(F.col("rhs_ix")), part.upper(F.col("rhs_ix"))
    f = F.sum("mass")
    g = mass.groupBy("path").agg(
        f.alias("f"), (F.sum(F.col("mass") * c) / f).alias("mid"), (F.sum(F.col("mass") * lo) / f).alias("lower"), (F.sum(F.col("mass") * up) / f).alias("upper"))
    # One row a left side: at most (sets ** order) of them.
    return g.withColumn("p", F.col("f") / F.sum("f").over(Window.partitionBy(F.lit(0))))


def pwfts_point(df: DataFrame, part: Partition, groups: DataFrame, lags: Sequence[int], fuzzy: Column | None = None) -> DataFrame:
    """target_t, yhat, lower, upper: means over the fired left sides, weighted by degree times the left side's share."""
    if fuzzy is None and in_row.fits([part] * len(lags)):
        return _pwfts_in_row(df, part, groups, lags)
    j = paths(df, part, lags, fuzzy=fuzzy).join(small(groups, len(part) ** len(lags)), "path", "left")
    p = F.coalesce("p", F.lit(1.0))
    norm = F.when(F.col("mu_prod") * p > 0, F.col("mu_prod") * p).otherwise(p)
    over = lambda pick: F.aggregate(F.col("path"), F.lit(0.0), lambda a, i: a + pick(i)) / F.size("path")
    mid = F.coalesce("mid", over(part.centroid))
    lo = F.coalesce("lower", F.array_min(F.transform("path", lambda i: part.lower(i))))
    up = F.coalesce("upper", F.array_max(F.transform("path", lambda i: part.upper(i))))
    n = F.sum(norm)
    return j.groupBy(F.col("t").alias("target_t")).agg(
        (F.sum(norm * mid) / n).alias("yhat"), (F.sum(norm * lo) / n).alias("lower"), (F.sum(norm * up) / n).alias("upper"))


def _pwfts_in_row(df: DataFrame, part: Partition, groups: DataFrame, lags: Sequence[int]) -> DataFrame:
    p = in_row.lagged_paths(df, part, lags, "product")
    own = {
        "p": lambda k: 1.0, "mid": lambda k: sum(part[i].centroid for i in k) / len(k), "lower": lambda k: min(part[i].lower for i in k), "upper": lambda k: max(part[i].upper for i in k),
    }
    r = in_row.Rules(groups, [len(part)] * len(lags), tuple(own), own)
    src = p.df.withColumns({f"q{c}": r.get("p", p.number(c)) for c in p.range})
    src = src.withColumns({f"w{c}": F.when(p.degree(c) * F.col(f"q{c}") > 0, p.degree(c) * F.col(f"q{c}")).otherwise(F.col(f"q{c}")) for c in p.range})
    src = src.withColumn("_n", p.sum(lambda c: F.col(f"w{c}")))
    mean = lambda col: p.sum(lambda c: F.col(f"w{c}") * r.get(col, p.number(c))) / F.col("_n")
    return src.select(F.col("t").alias("target_t"), mean("mid").alias("yhat"), mean("lower").alias("lower"), mean("upper").alias("upper"))


def rule_bins(mass: DataFrame, groups: DataFrame, part: Partition, bins: int = 100) -> DataFrame:
    """path, ps (p over the path's mass Z), bin_ix, bin, w: densities of each left side, independent of the data."""
    z = part.mass(bins)
    at = [part.lo + k * (part.hi - part.lo) / (bins - 1) for k in range(bins)]
    rows = [(j, k, at[k], s.degree(at[k]) / z[j]) for j, s in enumerate(part.sets) for k in range(bins) if s.degree(at[k]) > 0]
    set_bins = mass.sparkSession.createDataFrame(rows, "rhs_ix int, bin_ix int, bin double, d double")
    share = mass.join(groups.select("path", "f", "p"), "path").withColumn("q", F.col("mass") / F.col("f"))
    zs = F.aggregate(F.col("path"), F.lit(0.0), lambda a, i: a + part._pick(i, z))
    return (
        share.join(F.broadcast(set_bins), "rhs_ix").groupBy("path", "p", "bin_ix", "bin").agg(F.sum(F.col("q") * F.col("d")).alias("w"))
        .withColumn("ps", F.col("p") / zs)
    )


def pwfts_distribution(df: DataFrame, part: Partition, mass: DataFrame, lags: Sequence[int], bins: int = 100, fuzzy: Column | None = None) -> DataFrame:
    """target_t, bin_ix, bin, density: mixtures of the fired left sides; bins without density have no row."""
    groups = pwfts_groups(mass, part)
    rb = rule_bins(mass, groups, part, bins)
    z = part.mass(bins)
    if fuzzy is None and in_row.fits([part] * len(lags), bins):
        return _distribution_in_row(df, part, rb, lags, bins)
    total = groups.select("path", (F.col("p") / F.aggregate(F.col("path"), F.lit(0.0), lambda a, i: a + part._pick(i, z))).alias("ps"))
    fired_paths = paths(df, part, lags, fuzzy=fuzzy).select("t", "path", "mu_prod")
    bound = len(part) ** len(lags)
    hit = fired_paths.join(small(total, bound), "path").withColumn("m", F.col("mu_prod") * F.col("ps"))
    # The sum over a target's paths is needed beside each of them: they come from one row, so it's small.
    hit = hit.withColumn("all", F.sum("m").over(Window.partitionBy("t"))).where(F.col("all") > 0)
    mixed = hit.join(small(rb.select("path", "bin_ix", "bin", "w"), bound * bins), "path")
    return mixed.groupBy(F.col("t").alias("target_t"), "bin_ix", "bin").agg(F.sum(F.col("m") * F.col("w") / F.col("all")).alias("density"))


def _distribution_in_row(df: DataFrame, part: Partition, rb: DataFrame, lags: Sequence[int], bins: int) -> DataFrame:
    """The weights of a row's paths are normalised before its bins are laid out, so that a bin is one sum of few terms."""
    p = in_row.lagged_paths(df, part, lags, "product")
    sizes = [len(part)] * len(lags)
    share = in_row.Rules(rb.groupBy("path").agg(F.first("ps").alias("ps")), sizes, ("ps",))
    density = in_row.Rules(rb.select(F.concat("path", F.array("bin_ix")).alias("path"), "w"), [*sizes, bins], ("w",))
    src = p.df.withColumns({f"m{c}": F.coalesce(p.degree(c) * share.get("ps", p.number(c)), F.lit(0.0)) for c in p.range})
    every = p.sum(lambda c: F.col(f"m{c}"))
    src = src.withColumn("every", every).where(F.col("every") > 0).select("t", *(f"n{c}" for c in p.range), *((F.col(f"m{c}") / F.col("every")).alias(f"m{c}") for c in p.range))
    src = src.withColumn("bin_ix", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    y = p.sum(lambda c: F.col(f"m{c}") * density.get("w", p.number(c) * bins + F.col("bin_ix")))
    at = in_row.literal([repr(part.lo + k * (part.hi - part.lo) / (bins - 1)) for k in range(bins)])
    return src.select(F.col("t").alias("target_t"), "bin_ix", F.get(at, F.col("bin_ix")).alias("bin"), y.alias("density")).where(F.col("density") > 0)


def quantiles(dist: DataFrame, qs: Sequence[float], t: str = "target_t") -> DataFrame:
    """t and q<percent>: the first bin at which the distribution reaches each q."""
    w = Window.partitionBy(t).orderBy("bin_ix")
    cdf = dist.withColumn("cdf", F.sum("density").over(w))
    return cdf.groupBy(t).agg(*(F.min(F.when(F.col("cdf") >= q - 1e-12, F.col("bin"))).alias(f"q{round(q * 100):02d}") for q in qs))


def markov_matrix(mass: DataFrame, part: Partition) -> DataFrame:
    """lhs, p and one column a right side: an order-1 chain."""
    groups = pwfts_groups(mass, part)
    j = mass.join(groups.select("path", "f", "p"), "path").select(F.col("path")[0].alias("lhs"), "p", "rhs_ix", (F.col("mass") / F.col("f")).alias("q"))
    return j.groupBy("lhs", "p").pivot("rhs_ix", list(range(len(part)))).agg(F.first("q")).na.fill(0.0).select(
        "lhs", "p", *(F.col(str(i)).alias(f"to_{i}") for i in range(len(part))))
