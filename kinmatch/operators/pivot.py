"""Correlation clustering by pivots in a static order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.storage import materialise


def pivot_clusters(edges: DataFrame, selves: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id): nodes in the order of (greatest incident weight desc, id asc); each free node takes its free neighbours.

    ``edges``: left_id, right_id, weight; self edges are ignored, of repeated edges the heaviest counts. Rounds find
    every node that comes before all its free neighbours at once; a node then belongs to the first pivot next to it.

    ``selves`` (id, weight): weights of nodes that stand for several ones next to each other. They count as incident, and such a node
    is there without an edge too.
    """
    w = F.col("weight")
    e = edges.where("left_id <> right_id").groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.max(w).alias("weight"))
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").union(e.select("b", "a", "weight"))
    both = materialise(both, "edges")
    incident = both.select("u", "weight") if selves is None else both.select("u", "weight").union(selves.select("id", "weight"))
    rank = incident.groupBy("u").agg(F.max("weight").alias("w")).select("u", F.struct((-F.col("w")).alias("w"), F.col("u").alias("i")).alias("r"))
    ranked = materialise(both.select("u", "v").join(rank.withColumnRenamed("r", "ru"), "u").join(rank.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v"), "ranked")
    free, pivots = ranked, None
    while True:
        mine = free.groupBy("u", "ru").agg(F.min("rv").alias("m")).where("ru < m").select("u")
        alone = None
        new = materialise(mine, "pivots")
        if not new.limit(1).count():
            break
        pivots = new if pivots is None else pivots.union(new)
        taken = new.union(free.join(new, "u", "left_semi").select("v")).distinct()
        after = free.join(taken, "u", "left_anti").join(taken.withColumnRenamed("u", "v"), "v", "left_anti")
        # A free node that has lost all its neighbours is a pivot of its own.
        alone = free.select("u").distinct().join(taken, "u", "left_anti").join(after.select("u").distinct(), "u", "left_anti")
        pivots = materialise(pivots.union(alone).distinct(), "pivots")
        free = materialise(after.select("u", "v", "ru", "rv"), "ranked")
    lone = None if selves is None else selves.select("id").distinct().join(ranked.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("cluster_id"))
    if pivots is None:
        return lone if lone is not None else ranked.select(F.col("u").alias("id"), F.col("u").alias("cluster_id"))
    own = pivots.select(F.col("u").alias("id"), F.col("u").alias("cluster_id"))
    first = F.row_number().over(Window.partitionBy("u").orderBy("rv"))
    others = ranked.join(pivots, "u", "left_anti").join(pivots.withColumnRenamed("u", "v"), "v", "left_semi").withColumn("n", first).where("n = 1")
    out = own.union(others.select(F.col("u").alias("id"), F.col("v").alias("cluster_id")))
    return out if lone is None else out.union(lone)


