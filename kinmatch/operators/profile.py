"""Profiles of corpora, labels, embeddings and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.vector import norm


def fields(records: DataFrame, names: list[str]) -> DataFrame:
    """Per field: present rate, distinct values, uniqueness, mean and median length; most missing first."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    has = F.col("value").isNotNull() & (F.regexp_replace("value", r"\s+", "") != "")
    out = long.withColumn("v", F.when(has, F.col("value"))).groupBy("field").agg(F.count("*").alias("n"), F.count("v").alias("present"), F.countDistinct("v").alias("n_distinct"), F.avg(F.length("v")).alias("mean_length"), F.percentile(F.length("v"), 0.5).alias("median_length"))
    rate = F.when(F.col("n") == 0, 0.0).otherwise(F.col("present") / F.col("n"))
    unique = F.when(F.col("present") == 0, 0.0).otherwise(F.col("n_distinct") / F.col("present"))
    return out.select("field", rate.alias("present_rate"), "n_distinct", unique.alias("uniqueness"), "mean_length", "median_length").orderBy("present_rate", "field")


def length_histogram(records: DataFrame, name: str, bins: int = 8) -> DataFrame:
    """Counts of a field's lengths in equal bins between the least and the greatest."""
    v = records.where(F.col(name).isNotNull()).select(F.length(name).alias("v"))
    m = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return v.join(F.broadcast(m)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def label_structure(clusters: DataFrame) -> DataFrame:
    """Records, clusters, singletons, largest, positive pairs, prevalence among all pairs, entropy of sizes in bits."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    one = sizes.agg(F.sum(F.col("n") * F.col("k")).alias("n_records"), F.sum("k").alias("n_clusters"), F.sum(F.when(F.col("n") == 1, F.col("k")).otherwise(0)).alias("n_singletons"), F.max("n").alias("largest"), F.sum(F.col("k") * F.col("n") * (F.col("n") - 1) / 2).alias("positive_pairs"), F.sum(F.col("k") * F.col("n") * F.log2("n")).alias("nlogn"))
    pairs = F.col("n_records") * (F.col("n_records") - 1) / 2
    return one.select("n_records", "n_clusters", "n_singletons", "largest", "positive_pairs", F.when(pairs > 0, F.col("positive_pairs") / pairs).otherwise(0.0).alias("prevalence"), (F.log2("n_records") - F.col("nlogn") / F.col("n_records")).alias("entropy"))


def embedding_norms(vectors: DataFrame, *by: str) -> DataFrame:
    """Number, mean, deviation, least and greatest length of usable vectors, and how many are not."""
    v = vectors.withColumn("v", norm(F.col("vector")))
    ok = (F.col("v") > 0) & ~F.isnan("v") & (F.col("v") < float("inf"))
    return v.withColumn("u", F.when(ok, F.col("v"))).groupBy(*by).agg(F.count("u").alias("n"), F.avg("u").alias("mean"), F.stddev_pop("u").alias("deviation"), F.min("u").alias("least"), F.max("u").alias("greatest"), F.count_if(F.col("u").isNull()).alias("dropped"))


def norm_histogram(vectors: DataFrame, bins: int = 10, *by: str) -> DataFrame:
    """Counts of usable vectors' lengths in equal bins on one axis, from the least to the greatest of all groups."""
    v = vectors.withColumn("v", norm(F.col("vector"))).where((F.col("v") > 0) & ~F.isnan("v") & (F.col("v") < float("inf")))
    m = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return v.join(F.broadcast(m)).groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def compare_embeddings(models: dict[str, DataFrame], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Norm statistics and histograms of several models' vectors on a shared axis, by ``model``."""
    both = None
    for name, df in models.items():
        one = df.select(F.lit(name).alias("model"), "vector")
        both = one if both is None else both.unionByName(one)
    return embedding_norms(both, "model"), norm_histogram(both, bins, "model")


def headline(sections: dict[str, DataFrame]) -> dict[str, float | int | None]:
    """Headline figures of a profile: the first row of every one-row section, as section.column."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(2).collect()
        if len(rows) == 1:
            out |= {f"{name}.{c}": rows[0][c] for c in df.columns if isinstance(rows[0][c], int | float)}
    return out


def failures(judged: DataFrame, slices: list[str]) -> DataFrame:
    """Errors by slice: rows, false positives and negatives, rate and lift over the overall rate, worst first.

    ``judged``: verdict, label and the slice columns; every slice is one grouping set of a single pass.
    """
    wrong = judged.withColumn("fp", (F.col("verdict") & ~F.col("label")).cast("int")).withColumn("fn", (~F.col("verdict") & F.col("label")).cast("int"))
    long = wrong.select("fp", "fn", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("x"))
    out = long.groupBy("x.slice", "x.value").agg(F.count("*").alias("n"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("rate", (F.col("fp") + F.col("fn")) / F.col("n"))
    base = out.where("slice = 'all'").select(F.col("rate").alias("base"))
    out = out.where("slice <> 'all'").join(F.broadcast(base)).withColumn("lift", F.when(F.col("base") > 0, F.col("rate") / F.col("base")).otherwise(0.0)).drop("base")
    return out.orderBy(F.desc("lift"), F.desc("rate"), F.desc("n"), "slice", "value")


def separability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of scores in [0, 1] by label."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.where("score is not null").groupBy(b.alias("bin")).agg(F.count_if("label").alias("positive"), F.count_if(~F.col("label")).alias("negative"))


def mining_readiness(labelled: DataFrame, threshold: float, bins: int = 5) -> DataFrame:
    """Positives and negatives by distance of the score to the threshold."""
    far = F.round(F.abs(F.col("score") - threshold), 12)  # 0.6 is a tenth from 0.5, though floating point says less
    b = F.least(F.floor(far * bins * 2), F.lit(bins - 1)).cast("int")
    return labelled.where("score is not null").groupBy(b.alias("margin")).agg(F.count_if("label").alias("positive"), F.count_if(~F.col("label")).alias("negative"))
