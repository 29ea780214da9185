"""Experiments: threshold tuning, sweeps, matrices, budgets, prices, bootstrap intervals and Pareto fronts."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.operators import cluster, metrics, score


def tune_threshold(pairs: DataFrame, gold: DataFrame, ids: DataFrame, grid: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """The first threshold of the best BCubed F1 over a grid; pairs are scored once, clustered for each."""
    told = []
    for t in grid:
        comp = cluster.complete_partition(cluster.connected_components(score.threshold(pairs, t)), ids)
        told.append((t, metrics.bcubed(comp.withColumnRenamed("component", "cluster"), gold).first()["f1"]))
    return max(told, key=lambda x: (round(x[1], 12), -grid.index(x[0])))[0], told


def sweep_k(ranked: DataFrame, gold: DataFrame, ks: list[int], target: float) -> tuple[int, list[tuple[int, float]]]:
    """Recall at each k, and the smallest k that reaches the target (else the greatest)."""
    told = sorted((r["k"], r["recall"]) for r in metrics.recall_curve(ranked, gold, ks).collect())
    return next((k for k, r in told if r >= target), told[-1][0]), told


def honest_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """F1 of the test rows at the train rows' best cut, at their own best cut, and the difference."""
    t = metrics.best_f1(train).select(F.col("threshold").alias("t"))
    own = metrics.best_f1(test).select(F.col("f1").alias("own_f1"))
    n = test.join(F.broadcast(t)).agg(F.max("t").alias("threshold"), F.count_if((F.col("score") >= F.col("t")) & F.col("label")).alias("tp"), F.count_if(F.col("score") >= F.col("t")).alias("yes"), F.count_if("label").alias("pos"))
    out = n.withColumn("f1", metrics.ratio(2 * F.col("tp"), F.col("yes") + F.col("pos"))).join(F.broadcast(own))
    return out.select("threshold", "f1", "own_f1", (F.col("own_f1") - F.col("f1")).alias("optimism"))


def grid(space: dict[str, list]) -> list[dict]:
    """Every combination of a search space, in order."""
    return [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


@dataclass(frozen=True)
class Constraint:
    """A bound on a metric."""

    metric: str
    op: str
    value: float

    def holds(self, told: dict[str, float]) -> bool:
        v = told.get(self.metric)
        return v is not None and {">=": v >= self.value, "<=": v <= self.value, ">": v > self.value, "<": v < self.value}[self.op]


def search(space: dict[str, list], run: Callable[[dict], dict[str, float]], goal: str, constraints: tuple[Constraint, ...] = ()) -> tuple[dict | None, list[dict]]:
    """Best trial of a grid by ``goal`` among those within the constraints, and all trials."""
    trials = [{"params": p, "metrics": (m := run(p)), "allowed": all(c.holds(m) for c in constraints)} for p in grid(space)]
    allowed = [t for t in trials if t["allowed"]]
    return (max(allowed, key=lambda t: t["metrics"][goal]) if allowed else None), trials


def pareto(runs: DataFrame, gain: str, cost: str) -> DataFrame:
    """Rows that none beats in gain and cost at once, by one pass over costs in order."""
    best = runs.groupBy(cost).agg(F.max(gain).alias("__g"))
    w = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("__b", F.max("__g").over(w)).where("__b is null or __g > __b").select(cost, "__g")
    return runs.join(front, cost).where(F.col(gain) == F.col("__g")).drop("__g")


def within_budget(pairs: DataFrame, worst_cost: float, budget: float, order: str = "left_id") -> DataFrame:
    """The rows that can be paid for at their worst cost; a distributed job cannot stop halfway."""
    return pairs.orderBy(order, "right_id").limit(int(budget / worst_cost + 1e-9))


def price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of calls by model: tokens times rates a million; null where the rates are unknown."""
    c = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost", c)


def cost_track(judged: DataFrame) -> DataFrame:
    """Calls, cost, and the share of pairs that went up."""
    return judged.agg(F.count("*").alias("n_pairs"), F.sum("cost").alias("cost"), F.avg(F.col("decision_step").eqNullSafe("teacher").cast("double")).alias("escalation_rate"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows after each stage; pairs of classes count their pairs of records."""
    out = None
    for k, (name, df) in enumerate(stages):
        one = df.agg(F.lit(k).alias("place"), F.lit(name).alias("stage"), (F.coalesce(F.sum("n_pairs"), F.lit(0)) if "n_pairs" in df.columns else F.count("*")).alias("n"))
        out = one if out is None else out.union(one)
    return out


def bootstrap(deltas: list[float], samples: int = 1000, level: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Mean of paired differences by entity and its percentile interval; one difference for each entity."""
    x, rng = np.asarray(deltas, float), np.random.default_rng(seed)
    means = x[rng.integers(0, len(x), (samples, len(x)))].mean(axis=1)
    return float(x.mean()), float(np.percentile(means, 50 - 50 * level)), float(np.percentile(means, 50 + 50 * level))


def split_instability(runs: DataFrame, metric: str, *by: str) -> DataFrame:
    """Mean, sample deviation, least, greatest and range of a metric over splits."""
    return runs.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("deviation"), F.min(metric).alias("least"), F.max(metric).alias("greatest"), (F.max(metric) - F.min(metric)).alias("range"))


def summarise(runs: DataFrame, metrics_: list[str], *by: str) -> DataFrame:
    """Number, means and medians of metrics by group."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *[F.avg(m).alias(f"mean_{m}") for m in metrics_], *[F.percentile(m, 0.5).alias(f"median_{m}") for m in metrics_])
