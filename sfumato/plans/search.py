"""Hyper-parameter search: the driver breeds small populations, the cluster evaluates them in sliding windows."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sfumato.operators.measures import actuals, point
from sfumato.operators.partition import grid
from sfumato.plans import multivariate as mv
from sfumato.plans.experiment import Windowed, windowed_benchmarks


@dataclass(frozen=True)
class Individual:
    partitions: int
    lags: tuple[int, ...]
    alpha: float
    method: str = "whofts"
    f1: float | None = None
    f2: float | None = None
    rmse: float | None = None
    size: float | None = None

    @property
    def config(self) -> dict:
        return {"method": self.method, "partitions": self.partitions, "lags": self.lags, "alpha": self.alpha}


def random_individual(rng: random.Random) -> Individual:
    return Individual(rng.randint(10, 100), tuple(range(1, rng.randint(1, 3) + 1)), rng.uniform(0, 0.5))


def evaluate(df: DataFrame | Windowed, population: Sequence[Individual], size: int = 800, train: float = 0.8, inc: float = 0.2) -> list[Individual]:
    """Fitness of all individuals in one job: f1 from the windows' mean error and its deviation, f2 from the rules and lags."""
    todo = [p for p in population if p.f1 is None]
    if not todo:
        return list(population)
    b = windowed_benchmarks(df, size, [p.config for p in todo], train, inc)
    ok = F.when(~F.isnan("rmse"), F.col("rmse"))
    got = {r["config"]: r for r in b.groupBy("config").agg(F.avg(ok).alias("m"), F.stddev_pop(ok).alias("s"), F.avg("size").alias("n")).collect()}
    done = []
    for i, p in enumerate(todo):
        r = got.get(i)
        if r is None or r["m"] is None:
            done.append(replace(p, f1=float("inf"), f2=float("inf"), rmse=float("inf"), size=float("inf")))
        else:
            done.append(replace(p, f1=0.6 * r["m"] + 0.4 * r["s"], f2=0.4 * r["n"] + 0.6 * 100 * sum(p.lags), rmse=r["m"], size=r["n"]))
    fresh = iter(done)
    return [p if p.f1 is not None else next(fresh) for p in population]


def held(df: DataFrame, size: int = 800, inc: float = 0.2, **_) -> Windowed:
    """The series in blocks of windows, for a search that evaluates them generation by generation."""
    return Windowed.of(df, size, inc)


def tournament(rng: random.Random, population: Sequence[Individual], objective: str) -> Individual:
    a, b = rng.sample(list(population), 2) if len(population) > 1 else (population[0],) * 2
    return a if getattr(a, objective) <= getattr(b, objective) else b


def double_tournament(rng: random.Random, population: Sequence[Individual]) -> Individual:
    """Winner by parsimony of two winners by accuracy."""
    a, b = tournament(rng, population, "f1"), tournament(rng, population, "f1")
    return a if a.f2 <= b.f2 else b


def crossover(rng: random.Random, a: Individual, b: Individual) -> Individual:
    """The better parent weighs 0.7; lags come from either parent, in the length of the order."""
    good, bad = (a, b) if a.f1 < b.f1 else (b, a)
    order = max(1, round(0.7 * len(good.lags) + 0.3 * len(bad.lags)))
    pool = sorted(set(good.lags) | set(bad.lags))
    lags = tuple(sorted(rng.sample(pool, min(order, len(pool)))))
    return Individual(max(3, round(0.7 * good.partitions + 0.3 * bad.partitions)), lags, 0.7 * good.alpha + 0.3 * bad.alpha, rng.choice((a, b)).method)


def mutate(rng: random.Random, p: Individual, rate: float) -> Individual:
    if rng.random() >= rate:
        return p
    lags, at = [], 0
    for _ in range(rng.randint(1, 3)):
        at += rng.randint(1, 5)
        lags.append(at)
    return Individual(min(100, max(3, p.partitions + round(rng.gauss(0, 10)))), tuple(lags), min(0.5, max(0.0, p.alpha + rng.gauss(0, 0.1))), p.method)


def genetic(
    df: DataFrame, generations: int = 30, patience: int = 7, population: int = 20, p_cross: float = 0.5, p_mut: float = 0.3, seed: int = 7, **windows,
) -> tuple[Individual, list[dict]]:
    """(best individual, statistics by generation).  Mutation rises by 0.05 while nothing improves; `patience` ends the search."""
    rng, df = random.Random(seed), held(df, **windows)
    pop = evaluate(df, [random_individual(rng) for _ in range(population)], **windows)
    best = min(pop, key=lambda p: (p.f1, p.f2))
    stats, still, rate = [], 0, p_mut
    for g in range(generations):
        parents = [double_tournament(rng, pop) for _ in range(population)]
        children = [crossover(rng, *rng.sample(parents, 2)) if rng.random() < p_cross else rng.choice(parents) for _ in range(population - 1)]
        pop = evaluate(df, [best, *(mutate(rng, c, rate) for c in children)], **windows)
        top = min(pop, key=lambda p: (p.f1, p.f2))
        improved = (top.f1, top.f2) < (best.f1, best.f2)
        still, rate = (0, p_mut) if improved else (still + 1, min(1.0, rate + 0.05))
        best = top if improved else best
        finite = [p.f1 for p in pop if p.f1 < float("inf")]
        stats.append({"generation": g, "best_f1": best.f1, "best_f2": best.f2, "mean_f1": sum(finite) / max(1, len(finite))})
        if still > patience:
            break
    return best, stats


def random_search(df: DataFrame, steps: int = 20, batch: int = 5, seed: int = 7, **windows) -> Individual:
    """Mutants of the best, accepted if better by (f1, f2); a batch of them is one job."""
    rng, df = random.Random(seed), held(df, **windows)
    best = evaluate(df, [random_individual(rng)], **windows)[0]
    for _ in range(max(1, steps // batch)):
        best = min([best, *evaluate(df, [mutate(rng, best, 1.0) for _ in range(batch)], **windows)], key=lambda p: (p.f1, p.f2))
    return best


def grid_search(df: DataFrame, partitions: Sequence[int], lags: Sequence[tuple[int, ...]], alphas: Sequence[float] = (0.0,), **windows) -> list[Individual]:
    """All combinations in one job, best first."""
    every = [Individual(n, k, a) for n in partitions for k in lags for a in alphas]
    return sorted(evaluate(df, every, **windows), key=lambda p: (p.f1, p.f2))


@dataclass(frozen=True)
class Composite:
    """A multivariate individual: (variable, partitions) pairs, the target among them, and its fitness."""

    variables: tuple[tuple[str, int], ...]
    f1: float | None = None
    f2: float | None = None


def evaluate_multivariate(df: DataFrame, individual: Composite, target: str, split: float = 0.8) -> Composite:
    """Fits on the first share of the times and tests on the rest; a plan over all rows, whose result is one row."""
    end = df.agg(F.max("t").alias("b"), F.min("t").alias("a")).head()
    cut = end["a"] + (end["b"] - end["a"]) * split
    vs = [mv.Variable(c, F.col(c), grid(df, c, n)) for c, n in individual.variables]
    own = next(v for v in vs if v.name == target)
    rules = mv.rules(df.where(F.col("t") <= cut), vs, own, weighted=True)
    fc = mv.forecast(df.where(F.col("t") > cut), vs, own, rules)
    m = point(actuals(df.withColumn("x", F.col(target)), fc)).head()
    size = rules.count()
    return replace(individual, f1=m["rmse"] if m["rmse"] is not None else float("inf"), f2=0.9 * size + 0.1 * sum(n for _, n in individual.variables))


def multivariate_search(df: DataFrame, target: str, others: Sequence[str], steps: int = 10, seed: int = 7) -> Composite:
    """Random search over subsets of variables and their numbers of sets; better by (f1, f2) is kept."""
    rng = random.Random(seed)

    def draw(base: Composite | None) -> Composite:
        n = lambda c: max(3, min(30, dict(base.variables).get(c, 10) + round(rng.gauss(0, 4)))) if base else rng.randint(3, 15)
        chosen = [c for c in others if rng.random() < 0.5]
        return Composite(((target, n(target)), *((c, n(c)) for c in chosen)))

    best = evaluate_multivariate(df, draw(None), target)
    for _ in range(steps):
        new = evaluate_multivariate(df, draw(best), target)
        best = min(best, new, key=lambda p: (p.f1, p.f2))
    return best


def as_frame(df: DataFrame, population: Sequence[Individual]) -> DataFrame:
    rows = [(p.method, p.partitions, ",".join(map(str, p.lags)), p.alpha, p.f1, p.f2, p.rmse, p.size) for p in population]
    return df.sparkSession.createDataFrame(rows, "method string, partitions int, lags string, alpha double, f1 double, f2 double, rmse double, size double")
