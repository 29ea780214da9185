"""Bootstrapping of a gold set: labelers, the run from records to labelled pairs, and its report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.pairs import canonical
from kinmatch.operators import curate, judge, metrics

KEY = ["pair_a", "pair_b"]


def label_by_clusters(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ground truth: a pair is a match if both records stand in one cluster (id, cluster); records without one match nothing."""
    of = lambda side: clusters.select(F.col("id").alias(f"{side}_id"), F.col("cluster").alias(f"{side}_cluster"))
    return label_clustered(pairs.drop("left_cluster", "right_cluster").join(of("left"), "left_id", "left").join(of("right"), "right_id", "left"))


def label_clustered(pairs: DataFrame) -> DataFrame:
    """The same of pairs that carry their records' clusters (left_cluster, right_cluster)."""
    label = F.coalesce(F.col("left_cluster") == F.col("right_cluster"), F.lit(False))
    return pairs.withColumn("label", label).withColumn("confidence", F.lit(1.0)).drop("left_cluster", "right_cluster")


def label_by_score(pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Stand-in labeler: score at or over the cut, with the distance to the cut as confidence (0.5 to 1); null scores do not match."""
    p = F.coalesce("score", F.lit(0.0))
    far = F.abs(p - cut) / F.greatest(F.lit(cut), F.lit(1 - cut))
    return pairs.withColumn("label", p >= cut).withColumn("confidence", F.round(0.5 + F.least(far, F.lit(1.0)) / 2, 4))


def label_by_teacher(pairs: DataFrame, records: DataFrame, fields: list[str], client: Callable[[list[str]], list[str | None]], budget: float, worst_cost: float) -> DataFrame:
    """A model's verdicts on as many pairs as the budget pays for at their worst cost, in hash order; the others have a null label.

    What cannot be read keeps a null label too, so nothing is labelled that nobody judged.
    """
    keyed = canonical(pairs)
    paid = keyed.orderBy(curate.hashed(*KEY), *KEY).limit(int(budget / worst_cost + 1e-9)).select(*KEY)
    asked = judge.parse(judge.generate(judge.prompts(keyed.join(paid, KEY, "left_semi").drop("score", "decision", "score_type", "decision_step"), records, fields), client))
    told = asked.select(*KEY, F.col("decision").alias("label"))
    return keyed.join(told, KEY, "left").withColumn("confidence", F.when(F.col("label").isNotNull(), 1.0)).drop(*KEY)


@dataclass
class Report:
    """Small tables of a bootstrapped set."""

    sections: dict[str, DataFrame]

    @classmethod
    def build(cls, candidates: DataFrame, labelled: DataFrame, gold: DataFrame, cost: float = 0.0) -> Report:
        """``candidates``: left_id, right_id, score; ``labelled``: those with label; ``gold``: pair_a, pair_b."""
        own = canonical(candidates).select(*KEY).distinct()
        truth = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
        rows = canonical(labelled.where("label is not null")).select(*KEY, "score", F.col("label").alias("verdict")).join(truth, KEY, "left").withColumn("label", F.col("g").isNotNull()).drop("g")
        found = own.join(truth, KEY).agg(F.count("*").alias("found")).join(F.broadcast(truth.agg(F.count("*").alias("gold"))))
        blocking = found.select("gold", "found", F.when(F.col("gold") == 0, 1.0).otherwise(F.col("found") / F.col("gold")).alias("recall"))
        n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") & F.col("label")).alias("tp"), F.count_if(F.col("verdict") & ~F.col("label")).alias("fp"), F.count_if(~F.col("verdict") & F.col("label")).alias("fn"))
        agreement = n.withColumn("f1", metrics.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).join(F.broadcast(metrics.agreement(rows, "verdict", "label").select("kappa")))
        scored = rows.where("score is not null")
        coverage = own.agg(F.count("*").alias("candidates")).join(F.broadcast(rows.agg(F.count("*").alias("labelled")))).withColumn("share", metrics.ratio(F.col("labelled").cast("double"), F.col("candidates"))).withColumn("cost", F.lit(cost))
        return cls({"blocking": blocking, "coverage": coverage, "agreement": agreement, "calibration": metrics.brier(scored).join(F.broadcast(metrics.calibration_error(scored))), "convergence": metrics.running_f1(rows)})


def bootstrap(records: DataFrame, block: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame], labeler: Callable[[DataFrame], DataFrame], budget: int, keep: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(candidates, labelled pairs): block, score, filter, mine ``budget`` pairs by stratum, label them."""
    candidates = score(block(records), records)
    if keep is not None:
        candidates = keep(candidates)
    mined = curate.mine_hard_negatives(candidates, budget, seed)
    return candidates, labeler(mined.withColumnsRenamed({"pair_a": "left_id", "pair_b": "right_id"}))
