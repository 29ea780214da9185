"""Comparison, scoring and selection of pairs.

A pair carries nullable similarities ``sim_<feature>`` (null: missing on a side), ``score``, ``score_type``,
``decision``, ``confidence`` and ``decision_step``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.pairs import canonical, predicted_match
from kinmatch.functions.text import similarity, with_similarity

#: A score needs this many present features, or this much present weight.
MIN_FEATURES, MIN_WEIGHT = 2, 0.5
#: Fixed names of score types.
SCORE_TYPES = ("sim_cos", "prob_llm", "heuristic", "calibrated_prob", "prob_fs", "prob_rf", "prob_group_llm")


@dataclass(frozen=True)
class Feature:
    """A string feature of a comparison."""

    name: str
    weight: float = 1.0
    algorithm: str = "token_sort_ratio"


def features_of(records: DataFrame, exclude: tuple[str, ...] = ("id",)) -> list[Feature]:
    """Every string column but the excluded ones, with equal weights."""
    return [Feature(f.name) for f in records.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]


def compare(pairs: DataFrame, records: DataFrame, features: list[Feature]) -> DataFrame:
    """Add ``sim_<feature>`` of every pair; pairs whose records are missing drop."""
    of = lambda side: records.select(F.col("id").alias(f"{side}_id"), *[F.col(f.name).alias(f"__{side}_{f.name}") for f in features])
    out = pairs.join(of("left"), "left_id").join(of("right"), "right_id")
    for f in features:
        out = with_similarity(out, f"sim_{f.name}", F.col(f"__left_{f.name}"), F.col(f"__right_{f.name}"), f.algorithm)
    return out.drop(*[f"__{s}_{f.name}" for s in ("left", "right") for f in features])


def compare_classes(pairs: DataFrame, features: list[Feature]) -> DataFrame:
    """Add ``sim_<feature>`` of every pair of classes (:meth:`kinmatch.operators.classes.Classes.pairs`), which are the
    similarities of every pair of their records."""
    for f in features:
        pairs = with_similarity(pairs, f"sim_{f.name}", F.col(f"left_{f.name}"), F.col(f"right_{f.name}"), f.algorithm)
    return pairs


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def combine_present(features: list[Feature]) -> Column:
    """Weighted mean over present features; 0 below the evidence floor."""
    there = [F.col(f"sim_{f.name}").isNotNull() for f in features]
    weight = _sum([F.when(p, f.weight).otherwise(0.0) for p, f in zip(there, features, strict=True)])
    total = _sum([F.when(p, F.col(f"sim_{f.name}") * f.weight).otherwise(0.0) for p, f in zip(there, features, strict=True)])
    n = _sum([p.cast("int") for p in there])
    enough = (n >= MIN_FEATURES) | (weight >= MIN_WEIGHT)
    return F.when((n > 0) & enough & (weight > 0), total / weight).otherwise(0.0)


def weighted_average(pairs: DataFrame, features: list[Feature]) -> DataFrame:
    """Heuristic score; weights are normalised over all features first (evenly if all are 0)."""
    whole = sum(f.weight for f in features)
    own = [Feature(f.name, f.weight / whole if whole else 1 / len(features), f.algorithm) for f in features]
    n = _sum([F.col(f"sim_{f.name}").isNotNull().cast("int") for f in own])
    weight = _sum([F.when(F.col(f"sim_{f.name}").isNotNull(), f.weight).otherwise(0.0) for f in own])
    step = F.when(n == 0, "all_features_missing").when((n < MIN_FEATURES) & (weight < MIN_WEIGHT), "below_evidence_floor").otherwise("weighted_average")
    return _judged(pairs.withColumn("score", combine_present(own)), "heuristic", step)


def _judged(pairs: DataFrame, score_type: str, step: Column) -> DataFrame:
    return pairs.withColumns({"score_type": F.lit(score_type), "decision": F.lit(None).cast("boolean"), "decision_step": step})


def rapid(pairs: DataFrame, records: DataFrame, features: list[Feature]) -> DataFrame:
    """Weighted sum of similarities where missing values count as empty strings (two of them are alike)."""
    of = lambda side: records.select(F.col("id").alias(f"{side}_id"), *[F.coalesce(f.name, F.lit("")).alias(f"__{side}_{f.name}") for f in features])
    return _rapid(pairs.join(of("left"), "left_id").join(of("right"), "right_id"), features)


def rapid_classes(pairs: DataFrame, features: list[Feature]) -> DataFrame:
    """The same of pairs of classes (:meth:`kinmatch.operators.classes.Classes.pairs`)."""
    return _rapid(pairs.withColumns({f"__{s}_{f.name}": F.coalesce(f"{s}_{f.name}", F.lit("")) for s in ("left", "right") for f in features}), features)


def _rapid(out: DataFrame, features: list[Feature]) -> DataFrame:
    whole = sum(f.weight for f in features) or 1.0
    for f in features:
        a, b = F.col(f"__left_{f.name}"), F.col(f"__right_{f.name}")
        told = out.select(a, b).distinct().withColumn(f"sim_{f.name}", similarity(a, b, f.algorithm))
        out = out.join(told, [f"__left_{f.name}", f"__right_{f.name}"])
    score = _sum([F.col(f"sim_{f.name}") * (f.weight / whole) for f in features])
    return _judged(out.drop(*[f"__{s}_{f.name}" for s in ("left", "right") for f in features]).withColumn("score", score), "heuristic", F.lit("rapidfuzz"))


def embedding_score(pairs: DataFrame) -> DataFrame:
    """The blocker's similarity as score."""
    return _judged(pairs.withColumn("score", F.col("similarity")), "sim_cos", F.lit("embedding_score"))


# Fellegi-Sunter


@dataclass
class FellegiSunter:
    """Prior and, per feature, the probabilities of agreement among matches (m) and others (u)."""

    features: list[str]
    prior: float
    m: list[float]
    u: list[float]
    agree_at: float = 0.85
    converged: bool = True

    def score(self, pairs: DataFrame) -> DataFrame:
        """Posterior of a match from agreements over present features."""
        logit = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for f, m, u in zip(self.features, self.m, self.u, strict=True):
            s = F.col(f"sim_{f}")
            logit = logit + F.when(s.isNull(), 0.0).when(s >= self.agree_at, float(np.log(m / u))).otherwise(float(np.log((1 - m) / (1 - u))))
        return _judged(pairs.withColumn("score", 1 / (1 + F.exp(-logit))), "prob_fs", F.lit("fellegi_sunter"))


def patterns(pairs: DataFrame, features: list[str], agree_at: float = 0.85) -> DataFrame:
    """Number of pairs by agreement pattern: 1, 0 or - for each feature; at most 3**F rows. Pairs of classes count their pairs of records."""
    mark = F.concat(*[F.when(F.col(f"sim_{f}").isNull(), "-").when(F.col(f"sim_{f}") >= agree_at, "1").otherwise("0") for f in features])
    n = F.sum("n_pairs") if "n_pairs" in pairs.columns else F.count("*")
    return pairs.groupBy(mark.alias("pattern")).agg(n.alias("n"))


def fit_fellegi_sunter(pairs: DataFrame, random_pairs: DataFrame, features: list[str], agree_at: float = 0.85, prior: float = 0.5, iterations: int = 20, tolerance: float = 1e-4) -> FellegiSunter:
    """u from random pairs (add-one), prior and m by EM over pattern counts, which are all that leaves the cluster.

    ``random_pairs`` are drawn from all records (:func:`kinmatch.operators.curate.random_pairs`), not from the candidates.
    """

    def table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = patterns(df, features, agree_at).orderBy("pattern").collect()
        x = np.array([[np.nan if c == "-" else float(c) for c in r["pattern"]] for r in rows]).reshape(-1, len(features))
        return x, np.array([r["n"] for r in rows], float)

    x, n = table(random_pairs)
    seen, agreed = (~np.isnan(x) * n[:, None]).sum(0), (np.nan_to_num(x) * n[:, None]).sum(0)
    u = np.clip((agreed + 1) / (seen + 2), 1e-6, 1 - 2e-3)
    x, n = table(pairs)
    m, p, there, done = np.full(len(features), 0.9), prior, ~np.isnan(x), False
    one = np.nan_to_num(x)
    for _ in range(iterations):
        with np.errstate(divide="ignore"):
            like = lambda q: np.where(there, one * np.log(q) + (1 - one) * np.log(1 - q), 0).sum(1)
            w = 1 / (1 + np.exp(np.clip(np.log((1 - p) / p) + like(u) - like(m), -700, 700)))
        got = w * n
        new_p = float(np.clip(got.sum() / max(n.sum(), 1), 1e-6, 1 - 1e-6))
        new_m = np.clip((one * got[:, None]).sum(0) / np.maximum((there * got[:, None]).sum(0), 1e-12), 1e-6, 1 - 1e-6)
        new_m = np.minimum(np.maximum(new_m, u + 1e-3), 1 - 1e-6)
        moved = max(abs(new_p - p), float(np.abs(new_m - m).max()))
        p, m = new_p, new_m
        if moved < tolerance:
            done = True
            break
    if not done:
        p, m = prior, np.maximum(np.full(len(features), 0.9), u + 1e-3)
    return FellegiSunter(features, p, m.tolist(), u.tolist(), agree_at, done)


# Learned scorers


def _vector(pairs: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = pairs.withColumns({f"__{f}": F.coalesce(F.col(f"sim_{f}"), F.lit(-1.0)) for f in features})
    return VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x").transform(filled)


def fit_random_forest(labelled: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 8, seed: int = 0):
    """Random forest over similarities, missing ones as -1."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _vector(labelled, features).withColumn("__y", F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def score_random_forest(model, pairs: DataFrame, features: list[str]) -> DataFrame:
    """Mean share of positives in the trees' leaves."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vector(pairs, features)).withColumn("score", vector_to_array("probability")[1])
    return _judged(out.drop("__x", "rawPrediction", "probability", "prediction", *[f"__{f}" for f in features]), "prob_rf", F.lit("random_forest"))


@dataclass
class Calibrator:
    """Platt (logistic) or isotonic map of scores to probabilities."""

    slope: float | None = None
    intercept: float | None = None
    bounds: list[float] | None = None
    values: list[float] | None = None

    @classmethod
    def fit(cls, scored: DataFrame, label: str = "label", method: str = "platt") -> Calibrator:
        rows = scored.where("score is not null").select(F.col("score").cast("double").alias("score"), F.col(label).cast("double").alias("y"))
        if method == "isotonic":
            from pyspark.ml.regression import IsotonicRegression

            model = IsotonicRegression(featuresCol="score", labelCol="y").fit(rows)
            return cls(bounds=model.boundaries.toArray().tolist(), values=model.predictions.toArray().tolist())
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        x = VectorAssembler(inputCols=["score"], outputCol="x").transform(rows)
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=200).fit(x)
        return cls(slope=float(model.coefficients[0]), intercept=float(model.intercept))

    def value(self, score: Column) -> Column:
        """Calibrated probability; isotonic maps are interpolated and flat outside. The boundaries are one array literal."""
        if self.slope is not None:
            return 1 / (1 + F.exp(-(score * self.slope + self.intercept)))
        xs, ys = (F.array(*[F.lit(float(x)) for x in v]) for v in (self.bounds, self.values))
        above = F.size(F.filter(xs, lambda x: x < score))  # boundaries below the score
        x0, x1, y0, y1 = F.get(xs, above - 1), F.get(xs, above), F.get(ys, above - 1), F.get(ys, above)
        between = F.when(x1 > x0, y0 + (y1 - y0) * (score - x0) / (x1 - x0)).otherwise(y1)
        return F.when(score.isNull(), F.lit(None).cast("double")).when(above == 0, F.get(ys, F.lit(0))).when(above >= len(self.bounds), F.lit(float(self.values[-1]))).otherwise(between)

    def apply(self, pairs: DataFrame) -> DataFrame:
        """Rows that have a score and a score type get the probability; decisions stay."""
        is_scored = F.col("score").isNotNull() & F.col("score_type").isNotNull()
        out = pairs.withColumn("__p", F.least(F.greatest(self.value(F.col("score")), F.lit(0.0)), F.lit(1.0)))
        return out.withColumn("score", F.when(is_scored, F.col("__p")).otherwise(F.col("score"))).withColumn("score_type", F.when(is_scored, "calibrated_prob").otherwise(F.col("score_type"))).drop("__p")


# Cascades and contracts


def needs_teacher(low: float, high: float) -> Column:
    """A pair goes up if the student abstains or its band value is within the bounds, both included; a
    decision without score and confidence does not."""
    band = F.coalesce("score", "confidence")
    abstains = F.col("decision").isNull() & F.col("score").isNull()
    return abstains | F.coalesce(band.between(low, high), F.lit(False))


def cascade(student: DataFrame, teacher, low: float, high: float) -> DataFrame:
    """The student's rows, and the teacher's for those that need one; ``teacher`` maps pairs to judged pairs."""
    cols = student.columns
    up = teacher(student.where(needs_teacher(low, high))).withColumn("decision_step", F.lit("teacher"))
    return student.where(~needs_teacher(low, high)).select(*cols).unionByName(up.select(*cols))


def chain_exit(low: float, high: float) -> Column:
    """Early exits of a chain: no below ``low``, yes above ``high``, both strict; null goes on."""
    return F.when(F.col("score") < low, False).when(F.col("score") > high, True)


def rescored(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Pairs with their judgements; raises unless each unordered pair has exactly one."""
    j = canonical(judgements).select("pair_a", "pair_b", "decision", "score", "score_type", "confidence", "decision_step")
    both = canonical(pairs).select("pair_a", "pair_b").withColumn("p", F.lit(1)).unionByName(j.select("pair_a", "pair_b").withColumn("p", F.lit(0)))
    wrong = both.groupBy("pair_a", "pair_b").agg(F.sum("p").alias("p"), F.count("*").alias("n")).where("p <> 1 or n <> 2").limit(1).count()
    if wrong:
        raise ValueError("judgements do not match the pairs one to one")
    return canonical(pairs).drop("decision", "score", "score_type", "confidence", "decision_step").join(j, ["pair_a", "pair_b"]).drop("pair_a", "pair_b")


def scripted(pairs: DataFrame, script: DataFrame, default: float | None = None) -> DataFrame:
    """Scores of a script (left_id, right_id, score), whichever way round; others get ``default``."""
    s = canonical(script).groupBy("pair_a", "pair_b").agg(F.max("score").alias("score"))
    out = canonical(pairs.drop("score")).join(s, ["pair_a", "pair_b"], "left").drop("pair_a", "pair_b")
    return _judged(out.withColumn("score", F.coalesce("score", F.lit(default).cast("double"))), "heuristic", F.lit("scripted"))


# Selection


def threshold(pairs: DataFrame, at: float) -> DataFrame:
    """Rows that are matches; those that abstain are not."""
    return pairs.where(predicted_match(at))


def top_k(pairs: DataFrame, k: int, order: str = "right_id") -> DataFrame:
    """The k best rows of each left id; a null score ranks below all, ties by ``order``."""
    w = Window.partitionBy("left_id").orderBy(F.coalesce("score", F.lit(-1.0)).desc(), order)
    return pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def link(pairs: DataFrame, at: float) -> DataFrame:
    """The best match of each left id, if it has one."""
    return top_k(threshold(pairs, at), 1)


def assign(pairs: DataFrame, at: float) -> DataFrame:
    """One-to-one greedy assignment: rounds of mutually best pairs until none is left."""
    from kinmatch.storage import discard, materialise

    left, chosen = materialise(threshold(pairs, at), "pairs"), None
    cols = pairs.columns
    while True:
        best = lambda c, o: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), o))
        won = left.withColumn("__l", best("left_id", "right_id")).withColumn("__r", best("right_id", "left_id")).where("__l = 1 and __r = 1").select(*cols)
        won = materialise(won, "assigned")
        chosen = won if chosen is None else chosen.union(won)
        if not won.limit(1).count():
            return chosen
        before, left = left, materialise(left.join(won.select("left_id"), "left_id", "left_anti").join(won.select("right_id"), "right_id", "left_anti").select(*cols), "pairs")
        discard(before)
