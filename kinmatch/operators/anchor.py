"""Incremental assignment of new records to entities that were resolved before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.pairs import positioned
from kinmatch.operators.blocking import nearest
from kinmatch.operators.cluster import complete_partition


@dataclass
class AnchorStore:
    """Table (record_id, entity_id, ordinal): entities are numbered by their first record's position."""

    anchors: DataFrame
    prefix: str = "e"

    @classmethod
    def build(cls, records: DataFrame, components: DataFrame, prefix: str = "e") -> AnchorStore:
        """``records``: id, pos; ``components``: id, component of matched ones; others are entities of their own."""
        whole = complete_partition(components, records).join(records.select("id", "pos"), "id")
        first = positioned(whole.groupBy("component").agg(F.min("pos").alias("first")), "first").select("component", F.col("pos").alias("ordinal"))
        rows = whole.join(first, "component").select(F.col("id").alias("record_id"), F.concat(F.lit(prefix), F.col("ordinal").cast("string")).alias("entity_id"), "ordinal")
        return cls(rows, prefix)

    def assign(self, new: DataFrame, matches: DataFrame) -> DataFrame:
        """(record_id, entity_id, kind) of new records (id, pos): a record that is an anchor, or matches some,
        links to the entity of the least ordinal; others get new entities in the order of pos.

        ``matches``: (record_id, anchor_id) above the threshold. New records do not become anchors.
        """
        known = self.anchors.select(F.col("record_id").alias("anchor_id"), "entity_id", "ordinal")
        asked = matches.select("record_id", "anchor_id").union(new.select(F.col("id").alias("record_id"), F.col("id").alias("anchor_id")))
        hit = asked.join(known, "anchor_id").groupBy("record_id").agg(F.min_by("entity_id", "ordinal").alias("entity_id"))
        told = new.select(F.col("id").alias("record_id"), "pos").join(hit, "record_id", "left")
        top = self.anchors.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("top"))
        linked = told.where("entity_id is not null").select("record_id", "entity_id", F.lit("link").alias("kind"))
        fresh = positioned(told.where("entity_id is null").select("record_id", F.col("pos").alias("p")), "p").join(F.broadcast(top))
        minted = fresh.select("record_id", F.concat(F.lit(self.prefix), (F.col("top") + 1 + F.col("pos")).cast("string")).alias("entity_id"), F.lit("new").alias("kind"))
        return linked.union(minted)

    def candidates(self, new: DataFrame, known: DataFrame | None = None, k: int | None = None) -> DataFrame:
        """(record_id, anchor_id) to be judged for new records: with ``k``, the k anchors nearest by the vectors of ``new`` and
        ``known`` (id, vector); without, every anchor, which is for small stores only."""
        own = self.anchors.select("record_id")
        if k is None:
            return new.select(F.col("id").alias("record_id")).crossJoin(own.withColumnRenamed("record_id", "anchor_id"))
        base = known.join(own.withColumnRenamed("record_id", "id"), "id", "left_semi")
        return nearest(new, base, k).select(F.col("id").alias("record_id"), F.col("neighbour").alias("anchor_id"))

    def save(self, path: str) -> None:
        self.anchors.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, prefix: str = "e") -> AnchorStore:
        return cls(spark.read.parquet(path), prefix)


def group_costs(judged: DataFrame) -> DataFrame:
    """Of each anchor group the first member carries the cost, and the last one ends the group."""
    w = Window.partitionBy("left_id").orderBy("right_id")
    n = F.count("*").over(Window.partitionBy("left_id"))
    nth = F.row_number().over(w)
    return judged.withColumn("stamped_cost", F.when(nth == 1, F.col("cost")).otherwise(0.0)).withColumn("group_end", nth == n)
