"""Searches and their gold on awkward rows, and what they shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch import queries
from kinmatch.operators import blocking, judge, metrics
from tests.test_classes import shuffled


@pytest.fixture(scope="module")
def one_label(spark, tmp_path_factory):
    """1,200 vectors of one label: 719,400 gold pairs."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=64)], 1) for k in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{(path := tmp_path_factory.mktemp('vectors'))}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["blocking_quality", "hybrid_rrf", "late_interaction", "ranking_quality", "recall_curve"])
def test_no_gold_pair_is_shuffled(spark, one_label, name):
    before = shuffled(spark)
    queries.QUERIES[name](spark, one_label).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 200_000


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("sources", [1, 3, 40])
def test_nearest_against_all(spark, monkeypatch, metric, sources):
    monkeypatch.setattr(blocking, "TILE", (7, 5))
    rng = random.Random(sources)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(3)], k % sources) for k in range(60)] + [(98, [0.0, 0.0, 0.0], 1), (99, [float("nan"), 1.0, 1.0], 0)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, source int").localCheckpoint()
    same = sources == 1

    def value(x, y):
        x, y = np.array(x), np.array(y)
        if metric == "cosine":
            return float(x @ y) / (max(np.linalg.norm(x), 1e-300) * max(np.linalg.norm(y), 1e-300))
        return float(x @ y) if metric == "ip" else -float(np.linalg.norm(x - y))

    want = set()
    for i, x, s in rows[:-1]:
        near = sorted((-round(value(x, y), 9) + 0.0, j) for j, y, t in rows[:-1] if i != j and (same or s != t))
        want |= {(i, j, rank) for rank, (_, j) in enumerate(near[:6], 1)}
    for size in (1 << 20, 300):
        monkeypatch.setattr(blocking, "BLOCK_BYTES", size)
        got = blocking.nearest(v, v, 6, same_source=same, metric=metric)
        assert {(r.id, r.neighbour, r.rank) for r in got.collect()} == want


def test_gold_of_clusters(spark):
    rng = random.Random(2)
    c = spark.createDataFrame([(k, rng.choice([1, 2, 3, None, 100 + k])) for k in range(40)], "id long, cluster int").localCheckpoint()
    ranked = spark.createDataFrame([(a, b, n) for a in range(40) for n, b in enumerate(rng.sample([x for x in range(40) if x != a], 5), 1)], "id long, neighbour long, rank int").localCheckpoint()
    gold, pairs = metrics.cluster_pairs(c), ranked.select(F.col("id").alias("left_id"), F.col("neighbour").alias("right_id"))
    assert metrics.cluster_blocking_quality(pairs, c, c).collect() == metrics.blocking_quality(pairs, gold, c).collect()
    assert sorted(metrics.cluster_recall_curve(ranked, c, [1, 3]).collect()) == sorted(metrics.recall_curve(ranked, gold, [1, 3]).collect())
    assert [pytest.approx(x) for x in metrics.cluster_ranking(ranked, c, 4).first()] == list(metrics.ranking(ranked, gold, 4).first())
    near = {(r.id, r.neighbour, r["rank"]) for r in blocking.first_of_cluster(c, 3).collect()}
    of = {r.id: r.cluster for r in c.collect()}
    assert near == {(a, b, n) for a in of if of[a] is not None for n, b in enumerate(sorted(x for x in of if x != a and of[x] == of[a])[:3], 1)}


def test_embedding_is_dealt(spark):
    one = spark.createDataFrame([(k, "x") for k in range(50)], "id long, name string").coalesce(1)
    sizes = judge.embed(one, ["name"], judge.hash_embedder).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 25


def test_entity_split_is_merged(spark):
    """Tables that grow with the pairs are not broadcast, however small their files are."""
    from kinmatch.operators import curate

    p = spark.createDataFrame([(k, k + 1000, True) for k in range(60)], "left_id long, right_id long, label boolean")
    plan = curate.split_by_entity(p, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [left_id" in plan and "SortMergeJoin [component" in plan
