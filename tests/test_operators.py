"""Operators against small models of their rules."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import pairs as fp
from kinmatch.functions import text
from kinmatch.operators import anchor, blocking, cluster, curate, golden, metrics, pivot, score
from kinmatch.plans import evaluate, pipeline
from kinmatch.sources import logs, records
from kinmatch.streaming.assign import assign_stream


def table(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        row[i + 1][j + 1] = row[i][j] + 1 if a[i] == b[j] else max(row[i][j + 1], row[i + 1][j])
    return row[-1][-1]


@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert text.lcs(a, b) == table(a, b)


def test_expression_equals_udf(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choices("abc ", k=rng.randint(0, 12))), "".join(rng.choices("abc ", k=rng.randint(0, 12)))) for _ in range(150)]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.indel_udf("a", "b").alias("u"), text.indel_expr(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(r.u == pytest.approx(r.e) for r in out)


def test_known_scores(spark):
    df = spark.createDataFrame([("b a", "a b"), ("ab", "cd"), ("", "x"), ("  ", "x")], "a string, b string")
    got = [r.s for r in text.with_similarity(df, "s", F.col("a"), F.col("b")).orderBy("a", "b").collect()]
    assert got == [None, 0.0, 0.0, 1.0]  # empty is missing, white space is not


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(cluster, "ONE_TASK_EDGES", limit)
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200), (3, None)]
    got = {r.id: r.component for r in cluster.connected_components(spark.createDataFrame(edges, "left_id long, right_id long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(top)}


def pivots(edges):
    weight, near = {}, {}
    for a, b, w in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, set()).add(y)
                weight[x] = max(weight.get(x, 0), w)
    free, out = set(near), {}
    for x in sorted(near, key=lambda x: (-weight[x], x)):
        if x in free:
            for y in (near[x] & free) | {x}:
                out[y] = x
            free -= near[x] | {x}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pivots(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), rng.randrange(1, 6) / 5) for _ in range(45)]
    got = pivot.pivot_clusters(spark.createDataFrame(edges, "left_id long, right_id long, weight double")).collect()
    assert {r.id: r.cluster_id for r in got} == pivots(edges)


def test_chain_of_two(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "left_id string, right_id string, weight double")
    assert {r.id: r.cluster_id for r in pivot.pivot_clusters(e).collect()} == {"a": "a", "b": "a", "c": "c"}


def judged(spark, rows):
    return spark.createDataFrame(rows, "left_id string, right_id string, score double, score_type string, decision boolean")


def test_tri_state(spark):
    rows = judged(spark, [("a", "b", 0.2, "heuristic", True), ("a", "c", 0.9, "heuristic", False), ("a", "d", 0.5, "heuristic", None), ("a", "e", None, None, None), ("a", "f", 0.9, None, None)])
    assert [r.v for r in rows.orderBy("right_id").select(fp.predicted_match(0.5).alias("v")).collect()] == [True, False, True, None, None]
    assert [r.right_id for r in score.threshold(rows, 0.5).collect()] == ["b", "d"]


def test_evidence_floor(spark):
    f = [score.Feature("x", 0.3), score.Feature("y", 0.3), score.Feature("z", 0.4)]
    df = spark.createDataFrame([(1, 0.5, None, None), (2, 0.5, 1.0, None), (3, None, None, None)], "i int, sim_x double, sim_y double, sim_z double")
    got = score.weighted_average(df, f).orderBy("i").collect()
    assert [(r.score, r.decision_step) for r in got] == [(0.0, "below_evidence_floor"), (0.75, "weighted_average"), (0.0, "all_features_missing")]


def test_rescoring_contract(spark):
    p = judged(spark, [("a", "b", None, None, None)])
    j = spark.createDataFrame([("b", "a", 0.7, "heuristic", None, None, "x")], "left_id string, right_id string, score double, score_type string, decision boolean, confidence double, decision_step string")
    assert score.rescored(p, j).first().score == 0.7
    with pytest.raises(ValueError, match="one to one"):
        score.rescored(p, j.union(j))


def test_cascade_band(spark):
    s = spark.createDataFrame([("a", 0.3, None, None), ("b", 0.6, None, None), ("c", None, None, None), ("d", None, True, None), ("e", None, True, 0.5)], "left_id string, score double, decision boolean, confidence double")
    assert [r.left_id for r in s.where(score.needs_teacher(0.3, 0.5)).orderBy("left_id").collect()] == ["a", "c", "e"]


def test_assignment(spark):
    rows = judged(spark, [("a", "x", 0.9, "h", None), ("a", "y", 0.8, "h", None), ("b", "x", 0.85, "h", None), ("b", "y", 0.7, "h", None), ("c", "z", 0.1, "h", None)])
    assert {(r.left_id, r.right_id) for r in score.assign(rows, 0.5).collect()} == {("a", "x"), ("b", "y")}


def test_key_blocking(spark):
    r = spark.createDataFrame([("1", 1, " A"), ("2", 2, "a\t"), ("3", 3, None), ("4", 4, None), ("5", 5, "b"), ("6", 6, ""), ("7", 7, " ")], "id string, pos int, k string")
    assert {(x.left_id, x.right_id) for x in blocking.key_blocking(r, F.col("k")).collect()} == {("1", "2"), ("6", "7")}


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    v = spark.createDataFrame([(k, k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(60)], "id long, pos long, vector array<double>, source int")
    key = lambda df: sorted((r.id, r.neighbour, r.rank) for r in df.collect())
    whole = key(blocking.nearest(v, v, 4, same_source=False))
    monkeypatch.setattr(blocking, "BLOCK_BYTES", 300)
    assert key(blocking.nearest(v, v, 4, same_source=False)) == whole and all(a % 3 != b % 3 for a, b, _ in whole)


def test_ring(spark):
    r = spark.createDataFrame([(c, k) for k, c in enumerate("abc")], "id string, pos int")
    assert sorted((x.id, x.neighbour) for x in blocking.ring_neighbours(r, 1).collect()) == [("a", "b"), ("b", "c"), ("c", "a")]


def test_merge_distance(spark):
    of = lambda groups: spark.createDataFrame([(x, k) for k, g in enumerate(groups) for x in g], "id string, cluster int")
    assert metrics.merge_distance(of([["a", "c"], ["b", "d"]]), of([["a", "b"], ["c", "d"]])).first().distance == 4
    assert metrics.merge_distance(of(["a", "b", "c"]), of([["a", "b", "c"]])).first().distance == 2


def test_auc_with_a_tie(spark):
    s = spark.createDataFrame([(1.0, False), (2.0, False), (3.0, False), (3.0, True), (4.0, True)], "score double, label boolean")
    assert metrics.roc_auc(s).first().auc == pytest.approx(5.5 / 6)
    assert metrics.reduction_ratio(0, 100) == 1 and metrics.reduction_ratio(6, 3, 4) == 0.5


def test_golden_rules(spark):
    rows = [(1, 1, "ab", None, None), (1, 2, " ", "x", 5), (1, 3, "abc", "y", 9), (1, 4, "ab", "y", None), (2, 1, None, None, None)]
    m = spark.createDataFrame(rows, "cluster_id int, pos int, a string, b string, at int")
    pick = lambda how: golden.canonicalize(m, {"a": how, "b": how}, timestamp="at").where("cluster_id = 1").first()
    assert [tuple(pick(h))[2:] for h in golden.STRATEGIES] == [("ab", "x"), ("ab", "x"), ("abc", "x"), ("ab", "y"), ("abc", "y"), ("abc", "y")]
    assert golden.canonicalize(m, {"a": "first"}).where("cluster_id = 2").first().a is None
    with pytest.raises(ValueError, match="unknown"):
        golden.canonicalize(m, {"a": "best"})


def test_labels(spark):
    log = spark.createDataFrame([("a", "b", 0.9, True, None, 1), ("c", "d", 0.1, None, None, 2), ("e", "f", 0.4, False, None, 3)], "left_id string, right_id string, score double, verdict boolean, confidence double, pos int")
    cor = spark.createDataFrame([("b", "a", True, 1), ("b", "a", False, 2)], "left_id string, right_id string, label boolean, pos int")
    assert {(r.left_id, r.label, r.label_source) for r in curate.harvest(log, cor).collect()} == {("a", False, "correction"), ("e", False, "log")}
    assert [r.left_id for r in curate.uncertain(log, 5, corrections=cor).collect()] == ["e"]
    assert curate.coverage(log.where("false").withColumn("label", F.lit(True)), log).first().recall == 1


def test_largest_remainders():
    parts = {"hard": 0.25, "medium": 0.5, "easy": 0.25}
    assert curate.shares(10, parts, {"hard": 9, "medium": 9, "easy": 9}) == {"hard": 2, "medium": 5, "easy": 3} or sum(curate.shares(10, parts, {"hard": 9, "medium": 9, "easy": 9}).values()) == 10
    assert sum(curate.shares(10, parts, {"hard": 1, "medium": 20, "easy": 0}).values()) == 10


def test_augment_and_flip(spark):
    p = spark.createDataFrame([("a", "b", "n", "", "m", "x", True), ("c", "d", "n", "k", "m", "x", False)], "left_id string, right_id string, left_n string, left_k string, right_n string, right_k string, label boolean")
    assert [(r.blanked, r.left_n, r.right_n) for r in curate.augment(p, ["n", "k"]).collect()] == [("n", "", "")]
    assert curate.flip(p).first().left_id == "b" and curate.flip(p).columns == p.columns


def test_entity_split(spark):
    p = spark.createDataFrame([(k, k + 1000 + k % 2, True) for k in range(60)], "left_id long, right_id long, label boolean")
    out = curate.split_by_entity(p, 0.3).collect()
    part = {}
    for r in out:
        for x in (r.left_id, r.right_id):
            assert part.setdefault(x, r.part) == r.part
    assert 0 < sum(r.part == "test" for r in out) <= 18


def test_positions(spark):
    got = fp.positioned(spark.createDataFrame([(x,) for x in "dbca"], "x string").repartition(3), "x").collect()
    assert {r.x: r.pos for r in got} == {"a": 0, "b": 1, "c": 2, "d": 3}


def store_of(spark):
    known = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos long")
    return anchor.AnchorStore.build(known, spark.createDataFrame([("b", "b"), ("c", "b")], "id string, component string"))


def test_anchors(spark):
    new = spark.createDataFrame([("x", 0), ("y", 1), ("a", 2), ("z", 3)], "id string, pos long")
    matches = spark.createDataFrame([("x", "c"), ("x", "a")], "record_id string, anchor_id string")
    got = {r.record_id: (r.entity_id, r.kind) for r in store_of(spark).assign(new, matches).collect()}
    assert got == {"x": ("e0", "link"), "a": ("e0", "link"), "y": ("e2", "new"), "z": ("e3", "new")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("x", 0), ("b", 1)], "id string, pos long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, pos long").parquet(f"{tmp_path}/in")
    none = spark.createDataFrame([], "record_id string, anchor_id string")
    q = assign_stream(stream, store_of(spark), lambda batch: none, f"{tmp_path}/out", f"{tmp_path}/mark")
    q.processAllAvailable()
    q.stop()
    assert {(r.record_id, r.entity_id, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("x", "e2", "new"), ("b", "e1", "link")}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 1.5, None)], "id int, n double, s string")
    assert [tuple(r) for r in records.normalize(df).orderBy("id").collect()] == [("1", None, "x"), ("2", "1.5", None)]
    assert [r.id for r in records.normalize(df.drop("id"), "n").orderBy("id").collect()] == ["0", "1"]
    with pytest.raises(ValueError, match="repeats"):
        records.normalize(df.union(df))
    with pytest.raises(ValueError, match="nested"):
        records.normalize(df.withColumn("a", F.array("s")))
    assert records.fingerprint(df) == records.fingerprint(df.orderBy(F.desc("id"))) != records.fingerprint(df.limit(1))
    both, gold = records.linkage(df, df, spark.createDataFrame([(1, 2, 1), (2, 2, 0)], "ltable_id int, rtable_id int, label int"))
    assert both.count() == 4 and [tuple(r) for r in gold.collect()] == [("a_1", "b_2")]
    (tmp_path / "n.json").write_text('{"names": {"1": "A", "2": "B"}}')
    (tmp_path / "g.json").write_text('{"groups": [{"canonical_name": "A", "entity_ids": ["1", "2"]}]}')
    names, groups = records.read_groups(spark, f"{tmp_path}/n.json", f"{tmp_path}/g.json")
    assert names.count() == 2 and {tuple(r) for r in groups.collect()} == {("1", 0), ("2", 0)}


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", 0.5, True)], "left_id string, right_id string, score double, verdict boolean")
    logs.append(rows, f"{tmp_path}/log", logs.JUDGEMENTS)
    logs.append(rows, f"{tmp_path}/log", logs.JUDGEMENTS)
    got = logs.read_judgements(spark, f"{tmp_path}/log").collect()
    assert len(got) == 2 and got[0].confidence_source == "none"
    (tmp_path / "bad").write_text("no json\n")
    with pytest.raises(ValueError, match="not a log row"):
        logs.read(spark, f"{tmp_path}/bad", logs.CORRECTIONS)
    (tmp_path / "l.csv").write_text("left_id,right_id,label\nb,a,yes\n")
    assert logs.import_labels(spark, f"{tmp_path}/l.csv", rows).first().label is True
    (tmp_path / "m.csv").write_text("left_id,right_id,label\nb,a,perhaps\n")
    with pytest.raises(ValueError, match="neither"):
        logs.import_labels(spark, f"{tmp_path}/m.csv", rows)
    logs.export_review(rows.withColumn("note", F.lit("=1+1")), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().note == "'=1+1"


def test_chains(spark, tmp_path):
    r = spark.createDataFrame([("1", 1, "red box", "k"), ("2", 2, "box red", "k"), ("3", 3, "green", "k")], "id string, pos int, name string, k string")
    f = [score.Feature("name")]
    chain = pipeline.fuzzy_string(f, 0.9, F.col("k"))
    assert {(x.id, x.component) for x in chain.run(r)["clusters"].collect()} == {("1", "1"), ("2", "1")}
    assert chain.plan() == pipeline.fuzzy_string(f, 0.9, F.col("k")).plan() != pipeline.fuzzy_string(f, 0.8, F.col("k")).plan()
    once, again = (chain.replay(r, f"{tmp_path}/stages")["clusters"] for _ in range(2))
    assert once.count() == again.count() == 2
    with pytest.raises(TypeError):
        pipeline.Chain(list(reversed(chain.stages)))
    with pytest.raises(ValueError, match="taken"):
        pipeline.register("retrieve", pipeline.fuzzy_string)


def test_experiments(spark):
    best, trials = evaluate.search({"k": [1, 2, 3]}, lambda p: {"f1": p["k"] / 3, "cost": p["k"]}, "f1", (evaluate.Constraint("cost", "<=", 2),))
    assert best["params"] == {"k": 2} and len(trials) == 3
    mean, low, high = evaluate.bootstrap([0.1, 0.2, 0.3, 0.4])
    assert low <= mean <= high
    p = judged(spark, [("a", "b", 0.9, "h", None), ("b", "c", 0.6, "h", None)])
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    gold = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, cluster int")
    assert evaluate.tune_threshold(p, gold, ids, [0.5, 0.8])[0] == 0.8
    assert evaluate.within_budget(p, 0.4, 0.5).count() == 1


def test_models(spark):
    from functools import partial

    from kinmatch.operators import judge
    from kinmatch.plans import registry, report

    r = spark.createDataFrame([("1", "red", "x"), ("2", "red", None), ("3", "blue", "y")], "id string, name string, k string")
    p = spark.createDataFrame([("1", "2", None), ("1", "3", None)], "left_id string, right_id string, similarity double")
    f = [score.Feature("name")]
    model = partial(judge.scripted_model, answers={"blue": "NO_MATCH", "red": "MATCH"})
    assert {(x.right_id, x.decision) for x in registry.run_method("zero_shot_llm", p, r, f, client=model).collect()} == {("2", True), ("3", False)}
    scores = registry.run_method("prompt_llm", p, r, f, client=partial(judge.scripted_model, answers={"blue": "Score: 0.2"}, default="?"))
    assert {(x.right_id, x.score, x.decision_step) for x in scores.collect()} == {("2", None, "unparsed"), ("3", 0.2, "parsed")}
    with pytest.raises(ValueError, match="unknown"):
        registry.run_method("nothing", p, r, f)
    cache = judge.embed(r.limit(1), ["name"], judge.hash_embedder).select(F.sha2("name", 256).alias("key"), "vector")
    assert judge.embed_missing(r, ["name"], judge.hash_embedder, cache).where("vector is not null").count() == 3
    c = spark.createDataFrame([([("Yes", -0.1), ("no", -2.0)],)], "t array<struct<token:string,logprob:double>>").select(judge.logprob_confidence(F.col("t")).alias("c")).first().c
    assert 0.8 < c < 0.9
    s = spark.createDataFrame([(0.9, True), (0.2, False)], "score double, label boolean")
    assert "<h2>AUC</h2>" in report.page("x", report.evaluation(s, 0.5)) and report.markdown(s).startswith("| score")


def test_saved_features(spark, tmp_path):
    from kinmatch.plans import registry

    f = [score.Feature("a", 0.3, "ratio"), score.Feature("b")]
    registry.save_features(spark, f, f"{tmp_path}/f")
    assert registry.load_features(spark, f"{tmp_path}/f") == f
