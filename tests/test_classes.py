"""Key blocking by classes: the same as by pairs of records, and no pair of records is shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinmatch import queries
from kinmatch.operators import blocking, classes, cluster, pivot, score
from kinmatch.operators.classes import Classes

FEATURES = [score.Feature("name", 0.7), score.Feature("type", 0.3)]


def shuffled(spark) -> int:
    """Records that all stages so far wrote to shuffles."""
    gateway = spark.sparkContext._gateway
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.fixture(scope="module")
def one_block(spark, tmp_path_factory):
    """500 parts of one block, 124,750 pairs, with four names."""
    p = spark.range(500).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part no "), (F.col("id") % 4).cast("string")).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    p.write.parquet(f"{(path := tmp_path_factory.mktemp('parts'))}/part.parquet")
    return str(path)


BY_CLASSES = [
    "anchor_groups", "assignment_one_to_one", "cascade_band", "cluster_labels", "complete_partition", "composite_union", "configured_blocking", "cross_source_pairs", "dedupe_parts", "fellegi_sunter_fit",
    "fellegi_sunter_patterns", "fellegi_sunter_scores", "funnel_counts", "fuzzy_string_chain", "group_selection", "indel_ratio_names", "link_best", "pivot_clusters",
    "rapid_scores", "score_labels", "scripted_model_verdicts", "threshold_select", "token_set_ratio_names", "token_sort_ratio_pairs", "topk_per_left",
    "tri_state_verdicts", "weighted_average_scores",
]


@pytest.mark.parametrize("name", BY_CLASSES)
def test_no_pair_is_shuffled(spark, one_block, name):
    before = shuffled(spark)
    queries.QUERIES[name](spark, one_block).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 30_000


def records(spark, seed, n=70):
    rng = random.Random(seed)
    place = rng.sample(range(1000), n)
    rows = [(str(rng.randrange(10)) + f"{k:03d}", place[k], rng.choice(["K", " k ", "m", None]), rng.choice(["ab cd", "cd ab", "ab ce", "x", "", None]), rng.choice(["t u", "t v", "", None])) for k in range(n)]
    return spark.createDataFrame(rows, "id string, pos long, k string, name string, type string").localCheckpoint()


@pytest.mark.parametrize("seed", range(2))
def test_same_as_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(classes, "PACK", 3)
    monkeypatch.setattr(classes, "TASK_PAIRS", 5)
    monkeypatch.setattr(classes, "BROADCAST_CLASSES", 10**6 * seed)
    r = records(spark, seed)
    c = Classes.build(r, F.col("k"), ["name", "type"], ["pos"])
    pairs = blocking.key_blocking(r, F.col("k"))
    rows = lambda df, *cols: Counter(tuple(x) for x in df.select(*cols).collect())
    own = score.weighted_average(score.compare_classes(c.pairs(), FEATURES), FEATURES).withColumn("score", F.round("score", 9)).localCheckpoint()
    plain = score.weighted_average(score.compare(pairs, r, FEATURES), FEATURES).withColumn("score", F.round("score", 9)).localCheckpoint()
    cols = ["left_id", "right_id", "sim_name", "sim_type", "score", "decision_step"]
    assert rows(c.expand(own), *cols) == rows(plain, *cols)
    assert c.expand(own).where("left_pos >= right_pos").count() == 0
    assert rows(score.patterns(own, ["name", "type"]), "pattern", "n") == rows(score.patterns(plain, ["name", "type"]), "pattern", "n")
    assert rows(score.rapid_classes(c.pairs(), FEATURES).transform(c.expand), "left_id", "right_id", "score") == rows(score.rapid(pairs, r, FEATURES), "left_id", "right_id", "score")
    assert rows(c.expand(c.pairs(ordered=True).withColumn("said", F.concat_ws("/", "left_name", "right_name")), ordered=True), "left_id", "right_id") == rows(pairs, "left_id", "right_id")
    assert rows(c.top_k(own, 3), "left_id", "right_id", "score") == rows(score.top_k(plain, 3), "left_id", "right_id", "score")
    few, plain_few = score.threshold(own, 0.7), score.threshold(plain, 0.7)
    assert rows(c.top_k(few, 1), "left_id", "right_id") == rows(score.link(plain, 0.7), "left_id", "right_id")
    assert rows(c.assign(few), "left_id", "right_id", "score") == rows(score.assign(plain, 0.7), "left_id", "right_id", "score")
    assert rows(c.components(few), "id", "component") == rows(cluster.connected_components(plain_few), "id", "component")
    assert rows(c.pivots(few.withColumn("weight", F.col("score"))), "id", "cluster_id") == rows(pivot.pivot_clusters(plain_few.withColumn("weight", F.col("score"))), "id", "cluster_id")
    # Classes that are not near themselves.
    apart, plain_apart = few.where("a <> b"), plain_few.join(r.select(F.col("id").alias("left_id"), F.struct("k", "name", "type").alias("l")), "left_id").join(r.select(F.col("id").alias("right_id"), F.struct("k", "name", "type").alias("r")), "right_id")
    plain_apart = plain_apart.where(~(F.lower(F.trim("l.k")) == F.lower(F.trim("r.k"))) | ~F.col("l.name").eqNullSafe(F.col("r.name")) | ~F.col("l.type").eqNullSafe(F.col("r.type")))
    assert rows(c.pivots(apart.withColumn("weight", F.col("score"))), "id", "cluster_id") == rows(pivot.pivot_clusters(plain_apart.withColumn("weight", F.col("score"))), "id", "cluster_id")
    groups = blocking.groups(pairs.join(r.select(F.col("id").alias("right_id"), "pos"), "right_id"), "pos")
    monkeypatch.setattr(blocking, "GROUPED", 4)
    listed = lambda df: rows(df.withColumn("members", F.array_join("members", ",")), "left_id", "members", "n_members")
    assert listed(blocking.key_groups(r, F.col("k"))) == listed(groups)


@pytest.mark.parametrize("op", ["union", "intersection", "difference"])
def test_composite_of_keys(spark, op):
    r = records(spark, 5).withColumn("source", F.col("pos") % 3)
    keys = [(F.col("k"), "k"), (F.col("name"), "name"), (F.col("type"), "type")]
    plain = blocking.composite([blocking.key_blocking(r, k, n) for k, n in keys], op)
    rows = lambda df: Counter(tuple(x) for x in df.select("left_id", "right_id", "blocker_name", "similarity").collect())
    assert rows(classes.composite_keys(r, keys, op)) == rows(plain)
    assert rows(classes.composite_keys(r, keys, op, "source")) == rows(blocking.cross_source(plain, r))
    with pytest.raises(ValueError, match="unknown"):
        classes.composite_keys(r, keys, "product")


def test_chain_by_classes(spark):
    """A chain clusters by classes what its own steps gave, and the pairs themselves where somebody changed them."""
    from kinmatch.plans import pipeline

    r = records(spark, 6)
    chain = pipeline.fuzzy_string(FEATURES, 0.7, F.col("k"))
    frames = chain.run(r)
    plain = score.threshold(score.weighted_average(score.compare(blocking.key_blocking(r, F.col("k")), r, FEATURES), FEATURES), 0.7)
    rows = lambda df, *cols: Counter(tuple(x) for x in df.select(*cols).collect())
    assert rows(frames["pairs"], "left_id", "right_id", "blocker_name", "score") == rows(plain, "left_id", "right_id", "blocker_name", "score")
    assert rows(frames["clusters"], "id", "component") == rows(cluster.connected_components(plain), "id", "component")
    few = pipeline.Model(chain).execute_from("cluster", {"records": r, "pairs": frames["pairs"].where("score > 0.99")})
    assert rows(few["clusters"], "id", "component") == rows(cluster.connected_components(plain.where("score > 0.99")), "id", "component")
