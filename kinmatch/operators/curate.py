"""Curation: labels from judgement logs and corrections, review queues, mining and augmenting pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.pairs import canonical, last_wins, positioned
from kinmatch.operators.cluster import connected_components

KEY = ["pair_a", "pair_b"]


def harvest(log: DataFrame, corrections: DataFrame, order: str = "pos") -> DataFrame:
    """Labels of logged pairs: the last correction of a pair overrides the logged verdict; rows without either drop.

    Repeated log rows are kept. ``label_source`` is correction or log.
    """
    last = canonical(last_wins(corrections, order)).select(*KEY, F.col("label").alias("__c"))
    out = canonical(log).join(last, KEY, "left").withColumn("label", F.coalesce("__c", "verdict")).where("label is not null")
    return out.select("left_id", "right_id", "label", "score", F.when(F.col("__c").isNotNull(), "correction").otherwise("log").alias("label_source"))


def align(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Labelled pairs that are candidates, with the candidates' scores."""
    l = canonical(labels).groupBy(*KEY).agg(F.max("label").alias("label"))  # noqa: E741
    return canonical(candidates).join(l, KEY).select("left_id", "right_id", "score", "label")


def coverage(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Positives, positives that are no candidates, and the recall of positives (1 without any)."""
    pos = canonical(labels).where("label").select(*KEY).distinct()
    own = canonical(candidates).select(*KEY).distinct().withColumn("c", F.lit(1))
    n = pos.join(own, KEY, "left").agg(F.count("*").alias("positives"), F.count_if(F.col("c").isNull()).alias("dropped"))
    return n.withColumn("recall", F.when(F.col("positives") == 0, 1.0).otherwise(1 - F.col("dropped") / F.col("positives")))


def _open(log: DataFrame, corrections: DataFrame | None, order: str) -> DataFrame:
    rows = canonical(last_wins(log, order))
    return rows if corrections is None else rows.join(canonical(corrections).select(*KEY).distinct(), KEY, "left_anti")


def uncertain(log: DataFrame, limit: int, threshold: float = 0.5, margin: float = 0.2, corrections: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """Review items nearest the border: by confidence to 0.5 where there is one, first; else by score to the threshold."""
    d = F.when(F.col("confidence").isNotNull(), F.abs(F.col("confidence") - 0.5)).otherwise(F.abs(F.col("score") - threshold))
    rows = _open(log, corrections, order).withColumn("distance", d).withColumn("mode", F.when(F.col("confidence").isNotNull(), 0).otherwise(1)).where(F.round("distance", 12) <= margin)
    return rows.orderBy("mode", F.round("distance", 12), *KEY).limit(limit).select("left_id", "right_id", "score", "confidence", "distance", F.lit("uncertainty").alias("reason"))


def disagreeing(log: DataFrame, other: DataFrame, limit: int, corrections: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """Pairs on which the verdicts of two logs differ, widest score gap first."""
    b = canonical(last_wins(other, order)).select(*KEY, F.col("verdict").alias("other_verdict"), F.col("score").alias("other_score"))
    rows = _open(log, corrections, order).join(b, KEY).where("verdict <> other_verdict").withColumn("gap", F.abs(F.col("score") - F.col("other_score")))
    return rows.orderBy(F.desc_nulls_last(F.round("gap", 12)), *KEY).limit(limit).select("left_id", "right_id", "verdict", "other_verdict", "gap", F.lit("disagreement").alias("reason"))


def hashed(*cols: str, seed: int = 0) -> Column:
    """A hash order of rows that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def audit(log: DataFrame, limit: int, corrections: DataFrame | None = None, order: str = "pos", seed: int = 0) -> DataFrame:
    """A sample of the log in hash order."""
    return _open(log, corrections, order).orderBy(hashed(*KEY, seed=seed), *KEY).limit(limit).select("left_id", "right_id", "score", F.lit("audit").alias("reason"))


def review(log: DataFrame, limit: int, audit_fraction: float = 0.0, seed: int = 0, **kinds) -> DataFrame:
    """Uncertain items with ``int(limit * audit_fraction)`` audited ones among them."""
    n = int(limit * audit_fraction)
    first = uncertain(log, limit - n, **kinds)
    if not n:
        return first.select("left_id", "right_id", "score", "reason")
    rest = canonical(log).join(canonical(first).select(*KEY), KEY, "left_anti")
    return first.select("left_id", "right_id", "score", "reason").unionByName(audit(rest, n, kinds.get("corrections"), kinds.get("order", "pos"), seed))


def with_records(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items with both records as JSON; null where a record is missing."""
    told = F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)]))
    of = lambda side: records.select(F.col("id").alias(f"{side}_id"), told.alias(f"{side}_record"))
    return items.join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")


def strata(pairs: DataFrame, easy: float = 0.40, hard: float = 0.85) -> DataFrame:
    """Candidate pairs once each with their stratum by score percentile: hard, medium or easy."""
    one = canonical(pairs).groupBy(*KEY).agg(F.max("score").alias("score"))
    cut = one.agg(F.percentile("score", easy).alias("lo"), F.percentile("score", hard).alias("hi"))
    s = F.when(F.col("score") >= F.col("hi"), "hard").when(F.col("score") >= F.col("lo"), "medium").otherwise("easy")
    return one.join(F.broadcast(cut)).select(*KEY, "score", s.alias("stratum"))


def shares(budget: int, parts: dict[str, float], there: dict[str, int]) -> dict[str, int]:
    """Largest remainders of a budget; what a stratum cannot give goes to the next ones."""
    exact = {k: budget * v / sum(parts.values()) for k, v in parts.items()}
    got = {k: int(v) for k, v in exact.items()}
    for k in sorted(parts, key=lambda k: (int(exact[k]) - exact[k], k))[: budget - sum(got.values())]:
        got[k] += 1
    got = {k: min(v, there.get(k, 0)) for k, v in got.items()}
    for k in parts:
        got[k] += max(0, min(there.get(k, 0) - got[k], min(budget, sum(there.values())) - sum(got.values())))
    return got


def mine_hard_negatives(pairs: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """``budget`` pairs: a quarter hard, half medium, a quarter easy, each in hash order."""
    s = strata(pairs)
    there = {r["stratum"]: r["n"] for r in s.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    take = shares(budget, {"hard": 0.25, "medium": 0.5, "easy": 0.25}, there)
    out = None
    for k, n in take.items():
        part = s.where(F.col("stratum") == k).orderBy(hashed(*KEY, seed=seed), *KEY).limit(n)
        out = part if out is None else out.union(part)
    return out


def sample_negatives(labelled: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """All positives and, in hash order, ``ratio`` times as many negatives."""
    n = labelled.agg(F.count_if("label").alias("n")).first()["n"]
    few = canonical(labelled.where(~F.col("label"))).orderBy(hashed(*KEY, seed=seed), *KEY).limit(int(ratio * n)).select(*labelled.columns)
    return labelled.where("label").unionByName(few)


def random_pairs(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` distinct unordered pairs of all records (left_id, right_id, draw), each draw two hashed places.

    Places number the records in the order of ``pos``. Twice as many pairs are drawn as are asked for, equal places and
    repeated pairs drop, and the first ``n`` stay; nothing is paired but what is drawn.
    """
    rows = positioned(records.select("id", F.col("pos").alias("__at")), "__at").select("id", F.col("pos").alias("place"))
    total = rows.count()
    place = lambda side: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.lit(side))), 1, 8), 16, 10).cast("long"), F.lit(max(1, total)))
    drawn = records.sparkSession.range(2 * n + 16).select(F.col("id").alias("draw")).select("draw", place("a").alias("x"), place("b").alias("y")).where("x <> y")
    first = drawn.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("draw").alias("draw")).orderBy("draw").limit(n)
    of = lambda side, at: rows.select(F.col("id").alias(f"{side}_id"), F.col("place").alias(at))
    return first.join(of("left", "x"), "x").join(of("right", "y"), "y").select("left_id", "right_id", "draw")


def cross_cluster_pairs(clusters: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Negative pairs: random pairs of records (id, pos, cluster) of different clusters."""
    of = lambda side: clusters.select(F.col("id").alias(f"{side}_id"), F.col("cluster").alias(f"__{side}"))
    drawn = random_pairs(clusters, 2 * n, seed).join(of("left"), "left_id").join(of("right"), "right_id").where("__left <> __right")
    return drawn.orderBy("draw").limit(n).select("left_id", "right_id", F.lit(False).alias("label"))


def within_cluster_pairs(clusters: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Positive pairs: each record with the next one of its cluster in hash order, the first ``n`` of them in that order.

    A cluster of m records gives m - 1 pairs, never their square.
    """
    w = Window.partitionBy("cluster").orderBy(hashed("id", seed=seed), "id")
    rows = clusters.select("id", F.lead("id").over(w).alias("next")).where("next is not null")
    return rows.select(F.least("id", "next").alias("left_id"), F.greatest("id", "next").alias("right_id")).orderBy(hashed("left_id", "right_id", seed=seed)).limit(n).withColumn("label", F.lit(True))


def augment(labelled: DataFrame, fields: list[str]) -> DataFrame:
    """For each positive and each field present on both sides, a copy with that field blank on both."""
    there = F.array_compact(F.array(*[F.when((F.col(f"left_{f}") != "") & (F.col(f"right_{f}") != ""), F.lit(f)) for f in fields]))
    out = labelled.where("label").withColumn("blanked", F.explode(there))
    for f in fields:
        for side in ("left", "right"):
            out = out.withColumn(f"{side}_{f}", F.when(F.col("blanked") == f, F.lit("")).otherwise(F.col(f"{side}_{f}")))
    return out


def flip(pairs: DataFrame) -> DataFrame:
    """Left and right change places."""
    swap = {c: c.replace("left_", "right_", 1) if c.startswith("left_") else c.replace("right_", "left_", 1) for c in pairs.columns if c.startswith(("left_", "right_"))}
    return pairs.select(*[F.col(c).alias(swap.get(c, c)) for c in pairs.columns]).select(*pairs.columns)


def denoise(scored: DataFrame) -> DataFrame:
    """Confident learning: a pair goes if its out-of-fold probability of the other class is at least that class's mean
    probability among its own members."""
    m = scored.agg(F.avg(F.when(F.col("label"), F.col("score"))).alias("mp"), F.avg(F.when(~F.col("label"), 1 - F.col("score"))).alias("mn"))
    wrong = F.when(F.col("label"), 1 - F.col("score") >= F.col("mn")).otherwise(F.col("score") >= F.col("mp"))
    return scored.join(F.broadcast(m)).where(~F.coalesce(wrong, F.lit(False))).drop("mp", "mn")


def misclassified(labelled: DataFrame, features: list[str], folds: int = 3, limit: int | None = None) -> DataFrame:
    """Pairs that a forest fitted on the other folds gets wrong, missed positives first."""
    from kinmatch.operators.score import fit_random_forest, score_random_forest

    rows, out = canonical(labelled).withColumn("fold", F.conv(F.substring(hashed(*KEY), 1, 6), 16, 10).cast("long") % folds), None
    for k in range(folds):
        model = fit_random_forest(rows.where(F.col("fold") != k), features, trees=20)
        part = score_random_forest(model, rows.where(F.col("fold") == k), features)
        out = part if out is None else out.unionByName(part)
    wrong = out.where((F.col("score") >= 0.5) != F.col("label")).orderBy(F.desc("label"), F.abs(F.col("score") - 0.5).desc(), *KEY)
    return wrong.limit(limit) if limit is not None else wrong


def split_by_entity(labelled: DataFrame, test: float, seed: int = 0) -> DataFrame:
    """Labelled pairs with ``part`` train or test: whole components of labelled pairs go to one side, in hash order,
    until the test share is reached; never all of them. What grows with the pairs is merged, not broadcast through the driver."""
    comp = connected_components(labelled)
    rows = labelled.join(comp.select(F.col("id").alias("left_id"), "component").hint("merge"), "left_id")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", hashed("component", seed=seed))
    bucket = F.substring("h", 1, 3)  # 4,096 ranges of the hash: running sums in two steps
    by = sizes.groupBy(bucket.alias("b")).agg(F.sum("n").alias("bn")).withColumn("above", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("b", bucket).join(F.broadcast(by), "b").withColumn("before", F.col("above") + before)
    total = rows.agg(F.count("*").alias("total"))
    part = F.when((F.col("before") + F.col("n") <= F.round(F.lit(test) * F.col("total"))) & (F.col("before") + F.col("n") < F.col("total")), "test").otherwise("train")
    return rows.join(placed.join(F.broadcast(total)).select("component", part.alias("part")).hint("merge"), "component").drop("component")


def stratified_split(clusters: DataFrame, test: float, seed: int = 0) -> DataFrame:
    """Whole clusters to test or train: of each cluster size, max(1, int(n * test)) clusters in hash order."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    w = Window.partitionBy("size").orderBy(hashed("cluster", seed=seed), "cluster")
    n = sizes.groupBy("size").agg(F.greatest(F.lit(1), F.floor(F.count("*") * test)).alias("n_test"))
    placed = sizes.withColumn("nth", F.row_number().over(w)).join(F.broadcast(n), "size")
    return clusters.join(placed.select("cluster", F.when(F.col("nth") <= F.col("n_test"), "test").otherwise("train").alias("part")), "cluster")
