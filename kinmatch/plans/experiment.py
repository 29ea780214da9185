"""Experiments: protocols and their cells, runs with a ledger, tables of results, paired bootstrap, reproduction bundles."""

from __future__ import annotations

import itertools
import json
import time
import warnings
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.plans.persist import _Files, canonical_json, identity
from kinmatch.storage import ensure_workers

# Values


def frozen(value):
    """Mappings and lists as read-only ones, all the way down."""
    if isinstance(value, dict):
        return MappingProxyType({k: frozen(v) for k, v in value.items()})
    return tuple(map(frozen, value)) if isinstance(value, list | tuple | set) else value


def flat(metrics: dict, prefix: str = "") -> dict[str, float]:
    """Numbers of nested mappings under dotted names; what is no finite number is left out."""
    out: dict[str, float] = {}
    for k, v in metrics.items():
        if isinstance(v, dict):
            out |= flat(v, f"{prefix}{k}.")
        elif isinstance(v, int | float) and not isinstance(v, bool) and np.isfinite(v):
            out[f"{prefix}{k}"] = float(v)
    return out


# Spending


class BudgetExceeded(RuntimeError):
    """More was spent than the budget."""


class UnknownSpend(RuntimeError):
    """Work was paid for at a price nobody knows."""


@dataclass
class Ledger:
    """Spending of a run: a job's costs are added when it ends, so what is checked is what was measured.

    ``check`` raises strictly over the budget, warns from ``warn_at`` of it, and an unknown cost blocks a finite budget for
    good. :meth:`rows_for` is the cap before a job: a distributed job cannot stop halfway.
    """

    budget: float = 1.0
    warn_at: float = 0.8
    spent: float = 0.0
    unknown: str | None = None

    def add(self, cost: float | None, what: str = "a call") -> None:
        if cost is None or np.isnan(cost):
            if np.isfinite(self.budget) and self.unknown is None:
                self.unknown = f"the cost of {what} is unknown"
        else:
            self.spent += cost

    def add_judged(self, judged: DataFrame, cost: str = "cost_usd") -> None:
        """Add the costs of judged rows; a row without a cost makes the spending unknown."""
        total, missing = judged.agg(F.coalesce(F.sum(cost), F.lit(0.0)), F.count_if(F.col(cost).isNull())).first()
        self.add(total)
        if missing:
            self.add(None, f"{missing} rows")

    def check(self) -> None:
        if self.unknown is not None:
            raise UnknownSpend(self.unknown)
        if self.spent > self.budget:
            raise BudgetExceeded(f"spent {self.spent:.4f} of {self.budget:.2f}")
        if self.spent >= self.warn_at * self.budget and self.spent > 0:
            warnings.warn(f"spent {self.spent:.4f} of {self.budget:.2f}", stacklevel=2)

    def rows_for(self, worst_cost: float) -> int | None:
        """Rows that the rest of the budget pays for at their worst cost; None: as many as there are."""
        left = max(0.0, self.budget - self.spent)
        return None if worst_cost <= 0 or not np.isfinite(left) else int(left / worst_cost + 1e-9)


# Protocols

#: Fixed values of the official matrix: repeats of its five architectures, datasets, and budget.
OFFICIAL_REPEATS = {"fuzzy_string": 1, "retrieve": 1, "retrieve_rerank": 1, "retrieve_llm": 3, "retrieve_rerank_llm": 3}
OFFICIAL_DATASETS, OFFICIAL_BUDGET = 2, 20.0


@dataclass(frozen=True)
class Protocol:
    """What makes rows of a benchmark comparable."""

    benchmarks: tuple[str, ...]
    architectures: tuple[str, ...]
    splits: tuple[str, ...] = ("test",)
    seeds: tuple[int, ...] = (0,)
    repeats: int = 1
    architecture_repeats: dict[str, int] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (0.5,)
    confidence: float = 0.95
    samples: int = 1000
    fingerprints: dict[str, str] = field(default_factory=dict)
    official: bool = False
    budget: float | None = None

    def __post_init__(self):
        for name in ("benchmarks", "architectures", "splits", "seeds", "thresholds"):
            values = getattr(self, name)
            if not values or len(set(values)) != len(values):
                raise ValueError(f"{name} are empty or repeat")
        if not 0 < self.confidence < 1 or self.samples < 1 or self.repeats < 1 or any(not 0 <= t <= 1 for t in self.thresholds):
            raise ValueError("confidence, samples, repeats or thresholds are out of range")
        if set(self.architecture_repeats) - set(self.architectures):
            raise ValueError("repeats are given for architectures that are not run")
        if self.official:
            if set(self.benchmarks) - set(self.fingerprints):
                raise ValueError("an official protocol pins the data of every benchmark")
            if self.budget is None:
                raise ValueError("an official protocol has a budget")

    def cells(self) -> list[dict]:
        """Every architecture, benchmark, split, seed and repeat, with a stable id."""
        out = []
        for a, b, s, seed in itertools.product(self.architectures, self.benchmarks, self.splits, self.seeds):
            for r in range(self.architecture_repeats.get(a, self.repeats)):
                out.append({"cell_id": f"{a}:{b}:{s}:{seed}:repeat-{r}", "architecture": a, "benchmark": b, "split": s, "seed": seed, "repeat": r})
        return out


def official_matrix(benchmarks: tuple[str, str], fingerprints: dict[str, str]) -> Protocol:
    """The protocol of the official 18 cells: five architectures on two datasets."""
    if len(benchmarks) != OFFICIAL_DATASETS:
        raise ValueError("the official matrix has two datasets")
    return Protocol(tuple(benchmarks), tuple(OFFICIAL_REPEATS), architecture_repeats=dict(OFFICIAL_REPEATS), fingerprints=fingerprints, official=True, budget=OFFICIAL_BUDGET)


# Runs


@dataclass
class Experiment:
    """Cells of a protocol, run one after another: ``run(cell)`` gives nested metrics, of which ``cost_usd`` feeds the ledger."""

    protocol: Protocol
    run_cell: Callable[[dict], dict]
    code: str = "unversioned"

    def plan(self) -> list[dict]:
        """Cells with the identity of their recipe (architecture, code) and of their evaluation (that, data and protocol)."""
        out = []
        for c in self.protocol.cells():
            recipe = identity(c["architecture"], self.code)
            data = self.protocol.fingerprints.get(c["benchmark"], c["benchmark"])
            out.append(c | {"recipe_id": recipe, "evaluation_id": identity(recipe, data, c["split"], c["seed"], self.protocol.thresholds)})
        return out

    def run(self, done: Iterable[dict] = ()) -> list[dict]:
        """Rows of all cells; those of ``done`` are taken over by cell and evaluation id. A failed cell is a row with its error;
        cells after the budget are rows that were not run."""
        held = {(r["cell_id"], r["evaluation_id"]): r for r in done if r.get("status") == "done"}
        ledger, rows = Ledger(float("inf") if self.protocol.budget is None else self.protocol.budget), []
        for c in self.plan():
            if (c["cell_id"], c["evaluation_id"]) in held:
                rows.append(held[c["cell_id"], c["evaluation_id"]])
                continue
            try:
                ledger.check()
            except (BudgetExceeded, UnknownSpend) as error:
                rows.append(c | {"status": "not run", "error": str(error), "metrics": {}, "seconds": 0.0})
                continue
            began = time.time()
            try:
                told = self.run_cell(c)
                rows.append(c | {"status": "done", "error": None, "metrics": flat(told), "seconds": time.time() - began})
                ledger.add(told.get("cost_usd", 0.0), c["cell_id"])
            except Exception as error:  # one cell's failure is its own row
                rows.append(c | {"status": "failed", "error": f"{type(error).__name__}: {error}", "metrics": {}, "seconds": time.time() - began})
        return rows


def run_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of runs as a table, metrics as a map."""
    schema = "cell_id string, architecture string, benchmark string, split string, seed long, repeat long, recipe_id string, evaluation_id string, status string, error string, metrics map<string,double>, seconds double"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def aggregate(runs: DataFrame, by: tuple[str, ...] = ("architecture", "benchmark")) -> DataFrame:
    """Mean, sample deviation and number of each metric over the finished repeats, seeds and splits."""
    long = runs.where("status = 'done'").select(*by, F.explode("metrics").alias("metric", "value"))
    return long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))


@dataclass
class BenchmarkTable:
    """Results of methods: rows with method, dataset, seed, threshold and metrics."""

    rows: list[dict] = field(default_factory=list)
    metrics: tuple[str, ...] = ("pair_f1", "bcubed_f1", "delta_above_floor")

    def add(self, row: dict) -> None:
        self.rows.append(row)

    def rank(self, by: str = "pair_f1") -> list[dict]:
        """Best first; equal rows keep their order."""
        if by not in self.metrics:
            raise ValueError(f"rank by one of {', '.join(self.metrics)}")
        return sorted(self.rows, key=lambda r: -r[by])

    def best(self, by: str = "pair_f1") -> dict | None:
        ranked = self.rank(by)
        return ranked[0] if ranked else None

    def to_markdown(self) -> str:
        head = ["method", "dataset", "seed", "threshold", "bcubed_f1", "pair_f1", "usd_total", "s_per_pair"]
        told = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(told(r.get(h)) for h in head) + " |" for r in self.rows]])


# Statistics


@dataclass(frozen=True)
class Interval:
    """A paired difference with its percentile interval; without bounds if fewer than two units stand behind it."""

    difference: float
    lower: float | None
    upper: float | None
    error: float | None
    n_entities: int
    n_units: int
    samples: int


def paired_bootstrap(scores: DataFrame, samples: int = 1000, level: float = 0.95, seed: int = 0) -> Interval:
    """Bootstrap of candidate - baseline by cluster. ``scores``: entity_id, baseline, candidate, cluster_id (null: on its own).

    Clusters come down to sums and counts first. Samples are drawn where the clusters are: a cluster's number of draws in
    a sample is Poisson(1), drawn from a hash of cluster and sample, so a task adds up the sums and counts of its clusters for
    all samples, and only these (two numbers a sample and task) are shuffled. The interval is the linearly interpolated
    percentile of the samples' means.
    """
    if samples < 100 or not 0 < level < 1:
        raise ValueError("at least 100 samples and a level between 0 and 1 are needed")
    spark = scores.sparkSession
    ensure_workers(spark)
    unit = F.coalesce(F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")), F.concat(F.lit("entity:"), F.col("entity_id").cast("string")))
    n, missing, ids = scores.agg(F.count("*"), F.count_if(F.col("baseline").isNull() | F.col("candidate").isNull()), F.countDistinct("entity_id")).first()
    if not n or missing or ids != n:
        raise ValueError("entities are missing, unpaired or repeated")
    units = scores.groupBy(unit.alias("unit")).agg(F.sum(F.col("candidate") - F.col("baseline")).alias("s"), F.count("*").alias("n"))
    total, n_units = units.agg(F.sum("s"), F.count("*")).first()
    if n_units < 2:
        return Interval(total / n, None, None, None, n, n_units, samples)

    def draw(parts):
        sums, counts = np.zeros(samples), np.zeros(samples)
        for pdf in parts:
            for h, s, k in zip(pdf["h"], pdf["s"], pdf["n"], strict=True):
                times = np.random.default_rng([int(h) & (2**63 - 1), seed]).poisson(1.0, samples)
                sums += times * s
                counts += times * k
        yield pd.DataFrame({"sample": np.arange(samples), "s": sums, "n": counts})

    drawn = units.select(F.xxhash64("unit").alias("h"), "s", "n").mapInPandas(draw, "sample long, s double, n double")
    rows = drawn.groupBy("sample").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").toPandas()
    means = (rows["s"] / rows["n"]).to_numpy()
    low, high = np.percentile(means, [50 - 50 * level, 50 + 50 * level])
    return Interval(total / n, float(low), float(high), float(means.std(ddof=1)), n, n_units, samples)


# Bundles


def write_bundle(spark: SparkSession, path: str, protocol: Protocol, rows: list[dict]) -> None:
    """What another machine needs to repeat a run and to compare its own with it."""
    body = {"protocol": asdict(protocol), "rows": rows}
    files = _Files(spark, path)
    if files.there("bundle.json"):
        raise FileExistsError(path)
    files.write("bundle.json", canonical_json(body | {"sha256": identity(body)}))


def read_bundle(spark: SparkSession, path: str) -> tuple[Protocol, list[dict]]:
    """Protocol and rows of a bundle; raises if it was changed."""
    body = json.loads(_Files(spark, path).read("bundle.json"))
    if body.pop("sha256", None) != identity(body):
        raise ValueError(f"{path} was changed")
    p = body["protocol"]
    return Protocol(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}), body["rows"]


def verify_bundle(spark: SparkSession, path: str, run_cell: Callable[[dict], dict], code: str = "unversioned", tolerance: float = 1e-9) -> list[str]:
    """Run a bundle's cells again; what differs, as text."""
    protocol, rows = read_bundle(spark, path)
    wrong = []
    for old, new in zip(rows, Experiment(protocol, run_cell, code).run(), strict=True):
        if old["evaluation_id"] != new["evaluation_id"] or old["status"] != new["status"]:
            wrong.append(f"{old['cell_id']}: {old['status']} is now {new['status']}")
        for k in sorted(set(old["metrics"]) | set(new["metrics"])):
            a, b = old["metrics"].get(k), new["metrics"].get(k)
            if a is None or b is None or abs(a - b) > tolerance:
                wrong.append(f"{old['cell_id']}: {k} was {a} and is {b}")
    return wrong


def fit_report(before: DataFrame, after: DataFrame) -> dict[str, float]:
    """What calibration changed: Brier score and calibration error of (score, label) rows before and after."""
    from kinmatch.operators import metrics

    out = {}
    for name, df in (("before", before), ("after", after)):
        out[f"brier_{name}"], out[f"ece_{name}"] = metrics.brier(df).first()[0], metrics.calibration_error(df).first()[0]
    return out | {"brier_change": out["brier_after"] - out["brier_before"], "ece_change": out["ece_after"] - out["ece_before"]}


@dataclass
class RunStore:
    """Runs as JSON rows in a folder: every append is a set of files of its own, so writers need no lock."""

    spark: SparkSession
    path: str

    def append(self, rows: list[dict]) -> None:
        run_table(self.spark, rows).withColumn("stored_at", F.current_timestamp().cast("string")).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        """All runs; of runs of one cell and evaluation the last one stored."""
        schema = run_table(self.spark, []).schema.add("stored_at", "string")
        df = self.spark.read.schema(schema).json(self.path)
        last = df.groupBy("cell_id", "evaluation_id").agg(F.max_by(F.struct(*df.columns), "stored_at").alias("r"))
        return last.select("r.*")

    def rows(self) -> list[dict]:
        """The stored runs as :meth:`Experiment.run` takes them."""
        return [r.asDict(recursive=True) for r in self.read().collect()]
