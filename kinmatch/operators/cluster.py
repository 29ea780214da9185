"""Connected components and partition completion over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.storage import discard, ensure_workers, materialise

#: Graphs counted at most this many edges are closed in one task; larger ones by star contraction.
ONE_TASK_EDGES = 200_000


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a bounded number of edges."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    if nodes:
        yield pd.DataFrame({"id": nodes, "component": [top(x) for x in nodes]})


def connected_components(edges: DataFrame, src: str = "left_id", dst: str = "right_id") -> DataFrame:
    """``(id, component)`` of every node that has an edge; the label is the smallest id reachable.

    Null ends are no nodes; repeated edges count once; a self edge makes a component of one.
    Large graphs alternate large-star and small-star contraction, each round written to
    shared storage, so no task ever holds a component. Their joins are merges by a hint: small files can hold many rows, and a
    broadcast in each round would pass all of them through the driver.
    """
    spark = edges.sparkSession
    ensure_workers(spark)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    kind = e.schema["u"].dataType.simpleString()
    if e.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return materialise(e.coalesce(1).mapInPandas(_closed, f"id {kind}, component {kind}"), "components")
    selves = e.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    now, mark = e.where("u <> v"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        was, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if was is not None:
            discard(now)
        now = after
        if mark == was:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).union(selves).groupBy("id").agg(F.min("component").alias("component"))


def complete_partition(components: DataFrame, ids: DataFrame) -> DataFrame:
    """Add every id of ``ids`` (one column ``id``) that has no component as its own."""
    alone = ids.select("id").distinct().join(components.select("id"), "id", "left_anti")
    return components.select("id", "component").union(alone.select("id", F.col("id").alias("component")))
