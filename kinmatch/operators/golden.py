"""Golden records: one row of each cluster, field by field, in one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.pairs import positioned

STRATEGIES = ("first", "source_priority", "longest", "most_frequent", "most_complete", "most_recent")


def present(c: Column) -> Column:
    """Not null and not blank."""
    return c.isNotNull() & (F.regexp_replace(c.cast("string"), r"\s+", "") != "")


def canonicalize(members: DataFrame, fields: dict[str, str], cluster: str = "cluster_id", order: str = "pos", timestamp: str | None = None) -> DataFrame:
    """One golden record a cluster. ``fields``: name -> strategy; ``order`` is the members' order, ties go to the earliest.

    Missing values never win; with most_recent only dated members count.
    """
    unknown = set(fields.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    rows = members.withColumn("__full", sum((present(F.col(f)).cast("int") for f in fields), F.lit(0)))
    pos, aggs = F.col(order), []
    for f, how in fields.items():
        v, has = F.col(f), present(F.col(f))
        if how in ("first", "source_priority"):
            a = F.min_by(v, F.when(has, pos))
        elif how == "longest":
            a = F.max_by(v, F.when(has, F.struct(F.length(v.cast("string")), -pos)))
        elif how == "most_complete":
            a = F.max_by(v, F.when(has, F.struct("__full", -pos)))
        elif how == "most_recent":
            a = F.max_by(v, F.when(has & F.col(timestamp).isNotNull(), F.struct(F.col(timestamp), -pos)))
        else:
            continue
        aggs.append(a.alias(f))
    out = rows.groupBy(cluster).agg(F.count("*").alias("n_members"), *aggs)
    for f, how in fields.items():
        if how == "most_frequent":  # counts first, so a cluster's values are never gathered
            counted = rows.where(present(F.col(f))).groupBy(cluster, f).agg(F.count("*").alias("__c"), F.min(pos).alias("__p"))
            mode = counted.groupBy(cluster).agg(F.max_by(f, F.struct("__c", -F.col("__p"))).alias(f))
            out = out.join(mode, cluster, "left")
    return out.select(cluster, "n_members", *fields)


def enrich(golden: DataFrame, mentions: DataFrame, fields: dict[str, str], cluster: str = "cluster_id", timestamp: str | None = None) -> DataFrame:
    """Golden records folded once more with new mentions, which come after them.

    With most_recent, ``timestamp`` is a column of both; a golden record without a date loses to any dated mention.
    """
    keep = [*fields] + ([timestamp] if timestamp and timestamp not in fields else [])
    old = golden if timestamp is None or timestamp in golden.columns else golden.withColumn(timestamp, F.lit(None).cast(mentions.schema[timestamp].dataType))
    old = old.select(cluster, F.lit(0).cast("long").alias("pos"), *keep)
    new = mentions.select(cluster, (F.col("pos") + 1).cast("long").alias("pos"), *keep)
    out = canonicalize(old.unionByName(new), fields, cluster, timestamp=timestamp)
    dated = [f for f, how in fields.items() if how == "most_recent"] if timestamp and timestamp not in golden.columns else []
    if dated:  # values of golden records without a date stay where no dated mention has one
        kept = golden.select(cluster, *[F.col(f).alias(f"__{f}") for f in dated])
        out = out.join(kept, cluster, "left").withColumns({f: F.coalesce(f, f"__{f}") for f in dated}).drop(*[f"__{f}" for f in dated])
    return out


def finalize(members: DataFrame, fields: dict[str, str], cluster: str = "cluster_id", timestamp: str | None = None) -> DataFrame:
    """The golden record of exactly one cluster, its members in the order of their ids; raises for none or several."""
    found = members.select(cluster).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("exactly one cluster is finalised at a time")
    return canonicalize(positioned(members.drop("pos"), "id"), fields, cluster, "pos", timestamp)
