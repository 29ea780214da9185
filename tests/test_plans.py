"""Persistence, checkpoints, experiments, recipes, bootstrapping, loaders and the command line."""

import math
import random
import warnings
from functools import partial

import pytest
from pyspark.sql import functions as F

from kinmatch import cli
from kinmatch.functions import text
from kinmatch.operators import anchor, blocking, bootstrap, curate, golden, judge, metrics, profile, score
from kinmatch.plans import configured, evaluate, experiment, persist, pipeline, registry
from kinmatch.sources import logs, records


def test_models_come_back(spark, tmp_path):
    parts = {"fs": score.FellegiSunter(["a"], 0.2, [0.9], [0.1]), "features": [score.Feature("a", 0.4), score.Feature("b")], "calibrator": score.Calibrator(bounds=[0.1, 0.5], values=[0.0, 1.0]), "settings": {"k": 5}}
    rows = spark.createDataFrame([(float(k % 2), 0.9, k % 2 == 1) for k in range(20)], "sim_a double, sim_b double, label boolean")
    forest = score.fit_random_forest(rows, ["a", "b"], trees=3, depth=2)
    persist.save_model(spark, parts | {"forest": forest}, f"{tmp_path}/m")
    got = persist.load_model(spark, f"{tmp_path}/m")
    assert {k: got[k] for k in parts} == parts
    told = lambda m: [r.score for r in score.score_random_forest(m, rows, ["a", "b"]).collect()]
    assert told(got["forest"]) == told(forest)
    with pytest.raises(FileExistsError):
        persist.save_model(spark, parts, f"{tmp_path}/m")
    manifest = tmp_path / "m" / "manifest.json"
    (tmp_path / "m" / ".manifest.json.crc").unlink(missing_ok=True)
    manifest.write_text(manifest.read_text().replace("0.9", "0.8"))
    with pytest.raises(ValueError, match="changed"):
        persist.load_model(spark, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="unknown kind"):
        persist._built({"__kind": "Popen", "settings": {}})
    with pytest.raises(TypeError):
        persist.save_model(spark, {"x": object()}, f"{tmp_path}/n")


def test_checkpoints(spark, tmp_path):
    store, df = persist.CheckpointStore(spark, f"{tmp_path}/c"), spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert store.get("s", "f") is None
    assert sorted(map(tuple, store.put("s", "f", df).collect())) == [(1, "a"), (2, None)]
    assert store.put("s", "f", df.orderBy(F.desc("k"))).count() == 2  # equal rows in another order
    with pytest.raises(ValueError, match="another result"):
        store.put("s", "f", df.limit(1))
    assert store.get("s", "f").count() == 2 and store.quarantined() == []
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.mode("overwrite").parquet(f"{tmp_path}/c/s/f/data")
    assert store.get("s", "f") is None and len(store.quarantined()) == 1
    assert store.put("s", "f", df).count() == 2


def test_fingerprints(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, v string")
    b = spark.createDataFrame([(1, "x"), (0, "y")], "pos long, v string")
    assert persist.ordered_fingerprint(a) == persist.ordered_fingerprint(a.orderBy(F.desc("pos"))) != persist.ordered_fingerprint(b)
    assert persist.identity({"a": 1, "b": 2}) == persist.identity({"b": 2, "a": 1})


def test_gold_sets(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", True), ("a", "c", False)], "left_id string, right_id string, label boolean")
    persist.save_gold(spark, pairs, f"{tmp_path}/g", "demo")
    rows, told = persist.load_gold(spark, f"{tmp_path}/g")
    assert told["name"] == "demo" and sorted(map(tuple, rows.collect())) == [("a", "b", True), ("a", "c", False)]
    pairs.limit(1).write.mode("append").json(f"{tmp_path}/g/pairs")
    with pytest.raises(ValueError, match="changed"):
        persist.load_gold(spark, f"{tmp_path}/g")


def test_protocol_and_runs(spark, tmp_path):
    p = experiment.Protocol(("b1", "b2"), ("x", "y"), seeds=(0, 1), architecture_repeats={"y": 2}, budget=10.0)
    assert len(p.cells()) == 2 * 2 * (1 + 2) and len({c["cell_id"] for c in p.cells()}) == 12
    assert len(experiment.official_matrix(("b1", "b2"), {"b1": "f", "b2": "g"}).cells()) == 18
    with pytest.raises(ValueError):
        experiment.official_matrix(("b1", "b2"), {"b1": "f"})
    with pytest.raises(ValueError):
        experiment.Protocol((), ("x",))

    def run(c):
        if c["architecture"] == "y" and c["repeat"] == 1:
            raise RuntimeError("broken")
        return {"pair": {"f1": 0.5 + 0.1 * c["seed"]}, "cost_usd": 1.0, "note": "text"}

    rows = experiment.Experiment(p, run).run()
    assert [r["status"] for r in rows].count("failed") == 4 and rows[0]["metrics"] == {"pair.f1": 0.5, "cost_usd": 1.0}
    table = experiment.aggregate(experiment.run_table(spark, rows)).where("metric = 'pair.f1' and architecture = 'x'").collect()
    assert {(r.benchmark, r.n, round(r["mean"], 6)) for r in table} == {("b1", 2, 0.55), ("b2", 2, 0.55)}
    short = experiment.Experiment(experiment.Protocol(("b",), ("x",), seeds=(0, 1, 2), budget=1.5), run)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert [r["status"] for r in short.run()] == ["done", "done", "not run"]
        assert [r["status"] for r in short.run(done=short.run())] == ["done", "done", "done"]  # what is done costs nothing again
    experiment.write_bundle(spark, f"{tmp_path}/b", p, rows)
    assert experiment.verify_bundle(spark, f"{tmp_path}/b", run) == []
    changed = experiment.verify_bundle(spark, f"{tmp_path}/b", lambda c: run(c) | {"pair": {"f1": 0.9}})
    assert len(changed) == 8
    assert experiment.flat({"a": {"b": 1, "c": math.nan}, "d": True, "e": 2.5}) == {"a.b": 1.0, "e": 2.5}
    with pytest.raises(TypeError):
        experiment.frozen({"a": {"b": [1]}})["a"]["b"] = 2


def test_ledger(spark):
    book = experiment.Ledger(1.0)
    book.add(1.0)
    with pytest.warns(UserWarning, match="spent"):
        book.check()
    assert book.rows_for(0.1) == 0 and experiment.Ledger(1.0).rows_for(0.3) == 3 and experiment.Ledger(float("inf")).rows_for(1.0) is None
    book.add_judged(spark.createDataFrame([(0.5,)], "cost_usd double"))
    with pytest.raises(experiment.BudgetExceeded):
        book.check()
    lost = experiment.Ledger(5.0)
    lost.add_judged(spark.createDataFrame([(0.5,), (None,)], "cost_usd double"))
    with pytest.raises(experiment.UnknownSpend):
        lost.check()
    free = experiment.Ledger(float("inf"))
    free.add(None)
    free.check()


def test_result_table():
    t = experiment.BenchmarkTable()
    assert t.best() is None
    for m, v in (("a", 0.5), ("b", 0.7), ("c", 0.7)):
        t.add({"method": m, "dataset": "d", "seed": 0, "threshold": 0.5, "bcubed_f1": v, "pair_f1": v, "delta_above_floor": 0.0, "usd_total": 0.0, "s_per_pair": 0.1})
    assert [r["method"] for r in t.rank()] == ["b", "c", "a"] and t.best()["method"] == "b" and len(t.to_markdown().split("\n")) == 5
    with pytest.raises(ValueError):
        t.rank("speed")


def test_paired_bootstrap(spark):
    rng = random.Random(5)
    rows = [(k, 0.5, 0.5 + rng.gauss(0.1, 0.2), k // 4 if k % 3 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "entity_id long, baseline double, candidate double, cluster_id long")
    got = experiment.paired_bootstrap(df, samples=400)
    assert got.lower < got.difference < got.upper and got.n_entities == 400 and got.n_units == len({("c", r[3]) if r[3] is not None else ("e", r[0]) for r in rows})
    # the interval of an ordinary cluster bootstrap is close by
    units = {}
    for k, a, b, c in rows:
        units.setdefault(("c", c) if c is not None else ("e", k), []).append(b - a)
    units, means = list(units.values()), []
    for _ in range(400):
        drawn = [d for u in rng.choices(units, k=len(units)) for d in u]
        means.append(sum(drawn) / len(drawn))
    means.sort()
    assert got.lower == pytest.approx(means[10], abs=0.01) and got.upper == pytest.approx(means[389], abs=0.01)
    assert experiment.paired_bootstrap(df, samples=400) == got
    assert experiment.paired_bootstrap(df.limit(1)).lower is None
    with pytest.raises(ValueError):
        experiment.paired_bootstrap(df.union(df.limit(1)))


def people(spark):
    r = spark.createDataFrame([("1", 1, "red box"), ("2", 2, "box red"), ("3", 3, "green hat"), ("4", 4, "green hat")], "id string, pos int, name string")
    return judge.embed(r, ["name"], judge.hash_embedder).drop("embed_text").withColumn("source", F.lit("s"))


def test_recipes(spark):
    r = people(spark)
    same = partial(judge.scripted_model, answers={"red box": "MATCH", "green hat": "MATCH"}, default="NO_MATCH")
    parts = lambda c: {frozenset(x.id for x in g) for g in _groups(c)}
    assert parts(pipeline.reranker(["name"], judge.hash_reranker, 0.0).run(r)["clusters"]) == {frozenset("1234")}
    for name, settings in {
        "retrieve_rerank": {"k": 2, "fields": ["name"], "client": judge.hash_reranker, "at": 0.0},
        "retrieve_llm": {"k": 2, "fields": ["name"], "client": same},
        "retrieve_rerank_llm": {"k": 2, "fields": ["name"], "rerank_client": judge.hash_reranker, "client": same},
        "vector_llm_cascade": {"k": 2, "fields": ["name"], "client": same, "low": 0.2, "high": 0.95},
    }.items():
        model = pipeline.Model.from_recipe(name, **settings)
        assert model.resolve(r).count() == 4
        assert model.predict(r).count() >= 1 and model.chain.plan() == pipeline.Model.from_recipe(name, **settings).chain.plan()
    with pytest.raises(ValueError, match="unknown recipe"):
        pipeline.Model.from_recipe("nothing")


def _groups(clusters):
    by = {}
    for r in clusters.collect():
        by.setdefault(r.component, []).append(r)
    return by.values()


def test_cascade_asks_for_the_band_only(spark):
    pairs = spark.createDataFrame([("1", "2", 0.1), ("1", "3", 0.5), ("1", "4", 0.99)], "left_id string, right_id string, score double").withColumn("score_type", F.lit("heuristic")).withColumn("decision", F.lit(None).cast("boolean"))
    stage = pipeline._ask_band(["name"], partial(judge.scripted_model, answers={}, default="MATCH"), judge.PROMPT, 0.3, 0.9)
    got = {(r.right_id, r.decision, r.decision_step) for r in stage.run({"pairs": pairs, "records": people(spark)}).collect()}
    assert got == {("2", False, "vector"), ("3", True, "teacher"), ("4", True, "vector")}


def test_model_verbs(spark):
    r = people(spark).drop("vector")
    model = pipeline.Model.from_records(r, 0.9)
    assert model.candidates(r).count() == 6
    assert {(x.id, x.component) for x in model.resolve(r).collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")}
    assert sorted(x.n_members for x in model.dedupe(r, {"name": "longest"}).collect()) == [2, 2]
    assert model.compare({"name": "red box"}, {"name": "box red"}, spark)["score"] == 1.0
    frames = model.chain.run(r, until="score")
    assert model.execute_from("select", frames)["clusters"].count() == 4
    with pytest.raises(ValueError, match="no stage"):
        model.execute_from("nothing", frames)


def test_registered_parts():
    registry.register_part("parser", "upper", str.upper)
    assert registry.get_part("parser", "upper")("a") == "A"
    with pytest.raises(ValueError, match="taken"):
        registry.register_part("parser", "upper", str.lower)
    with pytest.raises(ValueError, match="unknown"):
        registry.get_part("parser", "lower")
    assert len(registry.METHODS) >= 12


def test_bootstrapping(spark):
    r = spark.createDataFrame([(str(k), k, f"n{k // 2}") for k in range(40)], "id string, pos int, name string")
    clusters = r.select("id", F.col("name").alias("cluster"))
    scored = lambda p, rec: score.weighted_average(score.compare(p, rec, [score.Feature("name")]), [score.Feature("name")])
    candidates, labelled = bootstrap.bootstrap(r, blocking.all_pairs, scored, lambda p: bootstrap.label_by_clusters(p, clusters), 30)
    assert candidates.count() == 780 and labelled.count() == 30
    gold = metrics.cluster_pairs(clusters)
    report = bootstrap.Report.build(candidates, labelled, gold, cost=1.5)
    told = {k: df.first() for k, df in report.sections.items() if k != "convergence"}
    assert told["blocking"].recall == 1.0 and told["agreement"].f1 in (0.0, 1.0) and told["agreement"].fp == told["agreement"].fn == 0
    assert told["coverage"].share == pytest.approx(30 / 780) and told["coverage"].cost == 1.5
    assert report.sections["convergence"].count() == 30
    teacher = partial(judge.scripted_model, answers={}, default="MATCH")
    some = bootstrap.label_by_teacher(labelled.drop("label", "confidence"), r, ["name"], teacher, budget=1.0, worst_cost=0.1)
    assert some.where("label").count() == 10 and some.where("label is null").count() == 20


def test_random_pairs(spark):
    r = spark.createDataFrame([(f"r{k}", k * 10) for k in range(30)], "id string, pos long")
    got = [(x.left_id, x.right_id) for x in curate.random_pairs(r, 50).collect()]
    assert len(got) == len({frozenset(p) for p in got}) == 50 and all(a != b for a, b in got)
    assert curate.random_pairs(r.limit(1), 5).count() == 0
    few = {frozenset((x.left_id, x.right_id)) for x in curate.random_pairs(r.limit(2), 5).collect()}
    assert len(few) == 1
    c = r.withColumn("cluster", F.col("pos") / 10 % 4)
    of = {x.id: x.cluster for x in c.collect()}
    assert all(of[x.left_id] != of[x.right_id] for x in curate.cross_cluster_pairs(c, 20).collect())
    inside = curate.within_cluster_pairs(c, 100).collect()
    assert len(inside) == 30 - 4 and all(of[x.left_id] == of[x.right_id] for x in inside)


def test_fellegi_sunter_prior(spark):
    rows = [(1.0, 1.0)] * 30 + [(0.0, 0.0)] * 60 + [(1.0, 0.0)] * 10
    pairs = spark.createDataFrame(rows, "sim_a double, sim_b double")
    by_chance = spark.createDataFrame([(0.0, 0.0)] * 95 + [(1.0, 0.0)] * 4 + [(0.0, 1.0)], "sim_a double, sim_b double")
    m = score.fit_fellegi_sunter(pairs, by_chance, ["a", "b"])
    assert m.converged and 0.2 < m.prior < 0.45 and m.u[0] < 0.1
    lost = score.fit_fellegi_sunter(pairs, by_chance, ["a", "b"], iterations=1)
    assert not lost.converged and lost.prior == 0.5


def test_isotonic_map(spark):
    c = score.Calibrator(bounds=[0.2, 0.4, 0.4, 0.8], values=[0.1, 0.3, 0.5, 0.9])
    rows = spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.4,), (0.6,), (0.8,), (1.0,), (None,)], "score double").select("score", c.value(F.col("score")).alias("p")).collect()
    assert [None if r.p is None else round(r.p, 6) for r in rows] == [0.1, 0.1, 0.2, 0.3, 0.7, 0.9, 0.9, None]


def test_thresholds_from_pairs(spark):
    rows = spark.createDataFrame([(0.9, True, "log"), (0.8, True, "log"), (0.2, False, "log")], "score double, label boolean, label_source string")
    value, told = metrics.threshold_from_pairs(rows)
    assert value == 0.8 and len(told) == 1
    assert metrics.threshold_from_pairs(rows.withColumn("label_source", F.lit("correction")))[1] == []
    with pytest.raises(ValueError, match="no score"):
        metrics.threshold_from_pairs(rows.withColumn("score", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="both classes"):
        metrics.threshold_from_pairs(rows.where("label"))


def test_enrich_and_finalize(spark):
    old = spark.createDataFrame([(1, "x", "2020"), (2, "y", None)], "cluster_id long, v string, at string")
    new = spark.createDataFrame([(1, 0, "z", "2021"), (1, 1, "w", "2019"), (2, 0, "q", None), (3, 0, "n", "2001")], "cluster_id long, pos long, v string, at string")
    got = golden.enrich(old, new, {"v": "most_recent"}, timestamp="at")
    assert {(r.cluster_id, r.v) for r in got.collect()} == {(1, "z"), (2, None), (3, "n")}
    undated = golden.enrich(old.drop("at"), new, {"v": "most_recent"}, timestamp="at")
    assert {(r.cluster_id, r.v) for r in undated.collect()} == {(1, "z"), (2, "y"), (3, "n")}
    members = spark.createDataFrame([(1, "b", "second"), (1, "a", "first")], "cluster_id long, id string, v string")
    assert golden.finalize(members, {"v": "first"}).first().v == "first"
    with pytest.raises(ValueError, match="exactly one"):
        golden.finalize(members.withColumn("cluster_id", F.col("id")), {"v": "first"})


def test_vector_searches(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "id long, vector array<double>")
    near = {(r.id, r.neighbour): (r["l2"], r["rank"]) for r in blocking.nearest(v, v, 2, metric="l2").collect()}
    assert near[0, 1] == (1.0, 1) and near[0, 2] == (2.0, 2) and near[3, 2] == (1.0, 1)
    assert {(r.id, r.neighbour) for r in blocking.nearest(v, v, 1, metric="ip").collect()} == {(0, 1), (1, 5), (2, 5), (3, 5), (4, 5), (5, 4)}
    with pytest.raises(ValueError, match="metric"):
        blocking.nearest(v, v, 1, metric="hamming")
    ranked = spark.createDataFrame([(0, 1, 0.5, 1)], "id long, neighbour long, score double, rank int")
    rows = blocking.padded(ranked, v.where("id < 2"), 2).orderBy("id", "rank").collect()
    assert [(r.id, r.neighbour) for r in rows] == [(0, 1), (0, -1), (1, -1), (1, -1)] and math.isnan(rows[1].score)
    assert blocking.nearest(v.limit(0), v, 2).count() == 0 == blocking.nearest(v, v.limit(0), 2).count()
    store = anchor.AnchorStore(v.where("id < 3").select(F.col("id").alias("record_id"), F.lit("e").alias("entity_id"), F.col("id").alias("ordinal")))
    assert store.candidates(v.where("id = 5")).count() == 3
    stats, shape = profile.compare_embeddings({"a": v.where("id > 0"), "b": v.where("id > 3")}, 4)
    assert stats.count() == 2 and shape.agg(F.sum("n")).first()[0] == 7
    assert profile.headline({"x": stats.where("model = 'a'")})["x.n"] == 5


def test_loaders(spark, tmp_path):
    a = spark.createDataFrame([(" 1", "Ann", "x"), ("2", "Bo", "")], "rec_id string, given string, town string")
    b = spark.createDataFrame([("1", "Anne", "x")], "rec_id string, given string, town string")
    m = spark.createDataFrame([("1", "1")], "id_a string, id_b string")
    rows, clusters, gold = records.person_pairs(a, b, m)
    assert {r.id for r in rows.collect()} == {"a1", "a2", "b1"} and [tuple(g) for g in gold.collect()] == [("a1", "b1")]
    assert {(r.id, r.cluster) for r in clusters.collect()} == {("a1", "a1"), ("b1", "a1"), ("a2", "a2")}
    for name, df in (("person_a", a), ("person_b", b), ("perfectMapping", m)):
        df.coalesce(1).write.csv(f"{tmp_path}/{name}.csv", header=True)
    assert records.load_benchmark(spark, "febrl_person", str(tmp_path))[0].count() == 3
    with pytest.raises(ValueError, match="unknown benchmark"):
        records.load_benchmark(spark, "nothing", "")
    assert {(r.raw, r.id) for r in records.id_map(spark.createDataFrame([("7", 0), ("9", 1)], "k string, o int"), "k", "a", "o").collect()} == {("7", "a7"), ("9", "a9")}
    assert {(r.raw, r.id) for r in records.id_map(spark.createDataFrame([("x", 1), ("9", 0)], "k string, o int"), "k", "a", "o").collect()} == {("9", "a0"), ("x", "a1")}
    with pytest.raises(ValueError, match="repeat"):
        records.id_map(spark.createDataFrame([("x", 1), ("x", 0)], "k string, o int"), "k", "a", "o")
    blank = records.row_records(spark.createDataFrame([(" a ", " ", "")], "x string, y string, z string"), ["x", "y", "z"], ("z",)).first()
    assert tuple(blank) == ("a", None, "")


def test_matrix_files(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(8, dtype=np.float32).reshape(4, 2))
    ids = spark.createDataFrame([("c", 2), ("a", 0)], "id string, pos long")
    assert {r.id: list(r.vector) for r in records.read_matrix(spark, str(tmp_path / "m.npy"), ids).collect()} == {"c": [4.0, 5.0], "a": [0.0, 1.0]}


def test_control_characters(spark):
    rows = spark.createDataFrame([("\x1b[31mred\x1b[0m\x07 \tkept\n",), ("\x1b]0;title\x07plain",)], "t string")
    assert [r[0] for r in rows.select(text.without_controls(F.col("t"))).collect()] == ["red \tkept\n", "plain"]


def test_command_line(spark, tmp_path, capsys):
    log = spark.createDataFrame([("a", "b", 0.5, True, "1"), ("a", "c", 0.9, True, "2"), ("b", "c", 0.1, False, "3")], "left_id string, right_id string, score double, decision boolean, timestamp string").withColumn("v", F.lit(4))
    logs.append(log, f"{tmp_path}/log", logs.JUDGEMENTS)
    logs.append(spark.createDataFrame([("a", "b", False)], "left_id string, right_id string, label boolean"), f"{tmp_path}/fixed", logs.CORRECTIONS)
    assert cli.main(["review", f"{tmp_path}/log", f"{tmp_path}/queue", "--limit", "1"]) == 0
    assert cli.main(["show", f"{tmp_path}/queue"]) == 0 and capsys.readouterr().out.startswith("a | b | 0.5")
    assert cli.main(["export-csv", f"{tmp_path}/queue", f"{tmp_path}/csv"]) == 0
    (tmp_path / "l.csv").write_text("left_id,right_id,label\na,b,no\n")
    assert cli.main(["import-csv", f"{tmp_path}/l.csv", f"{tmp_path}/queue", f"{tmp_path}/fixed"]) == 0
    assert logs.read(spark, f"{tmp_path}/fixed", logs.CORRECTIONS).count() == 2
    assert cli.main(["threshold", f"{tmp_path}/log", f"{tmp_path}/fixed"]) == 0 and float(capsys.readouterr().out) == 0.9


def test_fit_report(spark):
    before = spark.createDataFrame([(0.9, True), (0.6, False)], "score double, label boolean")
    after = spark.createDataFrame([(1.0, True), (0.0, False)], "score double, label boolean")
    assert experiment.fit_report(before, after)["brier_change"] < 0


def test_configured_blockers(spark):
    r = people(spark)
    both = {"kind": "composite", "op": "union", "children": [{"kind": "key", "column": "name"}, {"kind": "vector", "k": 1}]}
    assert {(x.left_id, x.right_id) for x in configured.build_blocker(both)(r).collect()} >= {("3", "4")}
    assert configured.build_blocker({**both, "cross_source": True})(r).count() == 0
    assert [c["k"] for c in configured.vector_parts(both)] == [1]
    for wrong in ({"kind": "x"}, {"kind": "vector", "k": 0}, {"kind": "composite", "op": "x", "children": [both]}):
        with pytest.raises(ValueError):
            configured.build_blocker(wrong)
    gold = spark.createDataFrame([("1", "2"), ("3", "4")], "pair_a string, pair_b string")
    best, trials = configured.optimise_blocker({"k": [1, 3]}, {"kind": "vector"}, r, gold, constraints=(evaluate.Constraint("pair_completeness", ">=", 0.9),))
    assert len(trials) == 2 and best["params"]["k"] in (1, 3) and best["metrics"]["pair_completeness"] == 1.0


def test_splits_and_methods(spark):
    r = spark.createDataFrame([(str(k), k, f"name {k // 2} of {k // 2}") for k in range(40)], "id string, pos int, name string")
    clusters = r.select("id", F.floor(F.col("pos") / 2).alias("cluster"))
    train, test = (configured.split_of(r, clusters, p) for p in ("train", "test"))
    assert train.records.count() + test.records.count() == 40 and test.records.count() == 12
    assert train.clusters.join(test.clusters, "cluster").count() == 0
    with pytest.raises(ValueError):
        configured.split_of(r, clusters, "valid")
    pairs, gold = configured.candidates_for(r, clusters, {"kind": "all_pairs"}, [score.Feature("name")])
    assert pairs.count() == 66 and gold.count() == 6
    told = configured.run_method(lambda t: pipeline.Model.from_records(r, t), train, test, [0.2, 1.0])
    assert told["threshold"] == 1.0 and told["bcubed_f1"] == 1.0 and told["delta_above_floor"] > 0


def test_model_references():
    kinds = {"./m": "local", "org/name": "hub", "org/name@abc": "hub", "openai/gpt": "api", "http://h:1/v1/m": "endpoint"}
    assert {t: configured.ModelRef.parse(t).kind for t in kinds} == kinds
    assert configured.ModelRef.parse("org/name@abc").to_config() == {"base": "org/name", "kind": "hub", "revision": "abc"}
    for wrong in ({"base": "x", "kind": "api", "adapter": "a"}, {"base": "x", "kind": "endpoint"}, {"base": "", "kind": "hub"}, {"base": "x", "kind": "local", "revision": "r"}):
        with pytest.raises(ValueError):
            configured.ModelRef(**wrong)
    with pytest.raises(ValueError):
        configured.ModelRef.parse("plain")


def test_profiles(spark):
    r = people(spark)
    p = configured.Profile.of("demo", r, r.select("id", F.col("name").alias("cluster")), r.select("vector"))
    assert p.headline()["labels.n_records"] == 4 and "<h2>fields</h2>" in p.to_html()


def test_run_store(spark, tmp_path):
    p = experiment.Protocol(("b",), ("x",), seeds=(0, 1))
    e = experiment.Experiment(p, lambda c: {"f1": 0.5})
    store = experiment.RunStore(spark, f"{tmp_path}/runs")
    store.append(e.run())
    store.append(e.run())
    assert store.read().count() == 2
    asked = []
    again = experiment.Experiment(p, lambda c: asked.append(c) or {"f1": 0.9}).run(done=store.rows())
    assert not asked and [r["metrics"] for r in again] == [{"f1": 0.5}] * 2


def test_usage_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "one two"), ("a", "c", "three")], "left_id string, right_id string, prompt string")
    told = judge.generate_with_usage(rows, judge.counted_model)
    assert judge.usage(told).first().asDict() == {"calls": 2, "errors": 0, "input_tokens": 3, "output_tokens": 2, "cost_usd": pytest.approx(0.005)}
    silent = judge.generate_with_usage(rows, lambda texts: [None] * len(texts))
    assert judge.usage(silent).first().cost_usd is None and silent.where("response is null").count() == 2
    judged = judge.parse(told).withColumn("confidence", F.lit(None).cast("double"))
    assert logs.logged(judged, f"{tmp_path}/log", "r1", "m").count() == 2
    got = logs.read_judgements(spark, f"{tmp_path}/log")
    assert {(r.run_id, r.decision, r.model) for r in got.collect()} == {("r1", True, "m")}
