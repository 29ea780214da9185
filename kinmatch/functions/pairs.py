"""Column helpers for pairs of records and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Add ``pair_a`` and ``pair_b``: the pair's ids in ascending order, whatever its direction."""
    return pairs.withColumn("pair_a", F.least(left, right)).withColumn("pair_b", F.greatest(left, right))


def predicted_match(threshold: float) -> Column:
    """Tri-state verdict: the decision if there is one, else score >= threshold, else null (abstained).

    A row without ``score_type`` is unscored: its score is a blocker's similarity and decides nothing.
    """
    return F.coalesce(F.col("decision"), F.when(F.col("score_type").isNotNull(), F.col("score") >= threshold))


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """Of rows about the same unordered pair, the last one by ``order``."""
    w = Window.partitionBy("pair_a", "pair_b").orderBy(F.col(order).desc())
    return canonical(rows).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "pair_a", "pair_b")


def positioned(df: DataFrame, *order: str) -> DataFrame:
    """Add ``pos``, numbers from 0 in the order of unique sort columns, without one task seeing all rows.

    Rows are dealt by range, numbered within partitions, and shifted by the sizes of the
    partitions before, which are the only thing that comes to the driver.
    """
    from kinmatch.storage import materialise

    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = part.withColumn("__m", F.monotonically_increasing_id())
    part = materialise(part.withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))), "positioned")
    sizes = {r["__p"]: r["n"] for r in part.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(at)]
        at += sizes[p]
    shift = F.create_map(*base)[F.col("__p")] if base else F.lit(0)
    return part.withColumn("pos", (shift + F.col("__k")).cast("long")).drop("__m", "__p", "__k")
