"""Blockers, models and datasets from plain configurations, and what they score on a split."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import blocking, classes, curate, metrics, profile, score
from kinmatch.plans import evaluate, pipeline
from kinmatch.plans.report import page

Blocker = Callable[[DataFrame], DataFrame]


def build_blocker(config: Mapping) -> Blocker:
    """A blocker of a configuration: ``kind`` all_pairs, key (``column``), vector (``k``) or composite (``op``, ``children``).

    ``cross_source`` leaves pairs of one source out. Unknown kinds and missing settings are errors before anything runs.
    """
    kind = config["kind"]
    if kind == "all_pairs":
        run: Blocker = blocking.all_pairs
    elif kind == "key":
        column, name = config["column"], config.get("name", "key")
        run = lambda r: blocking.key_blocking(r, F.expr(column), name)
    elif kind == "vector":
        k = int(config["k"])
        if k < 1:
            raise ValueError("k is at least 1")
        run = lambda r: blocking.knn_blocking(r, k)
    elif kind == "composite":
        children, op = [build_blocker(c) for c in config["children"]], config["op"]
        if op not in ("union", "intersection", "difference") or not children:
            raise ValueError(f"unknown set operation {op}, or no children")
        if all(c["kind"] == "key" and not c.get("cross_source") for c in config["children"]):
            keys = [(c["column"], c.get("name", "key")) for c in config["children"]]
            return lambda r: classes.composite_keys(r, [(F.expr(k), n) for k, n in keys], op, "source" if config.get("cross_source") else None)
        run = lambda r: blocking.composite([c(r) for c in children], op)
    else:
        raise ValueError(f"unknown blocker {kind}; there are all_pairs, composite, key, vector")
    if config.get("cross_source"):
        return lambda r: blocking.cross_source(run(r), r)
    return run


def vector_parts(config: Mapping) -> Iterator[Mapping]:
    """Every vector blocker in a configuration, through all composites."""
    if config["kind"] == "vector":
        yield config
    for c in config.get("children", ()):
        yield from vector_parts(c)


def score_blocking(config: Mapping, records: DataFrame, gold: DataFrame) -> DataFrame:
    """Blocking metrics of a configuration; pairs of one source are left out if, and only if, there are exactly two sources."""
    two = "source" in records.columns and records.select("source").distinct().limit(3).count() == 2
    return metrics.blocking_quality(build_blocker({**config, "cross_source": two})(records), gold, records)


def optimise_blocker(space: dict[str, list], base: Mapping, records: DataFrame, gold: DataFrame, goal: str = "pair_completeness", constraints: tuple[evaluate.Constraint, ...] = ()) -> tuple[dict | None, list[dict]]:
    """The best configuration of a grid over a base one, and all trials."""
    return evaluate.search(space, lambda p: score_blocking({**base, **p}, records, gold).first().asDict(), goal, constraints)


@dataclass(frozen=True)
class Split:
    """Records, clusters (id, cluster) and gold pairs of one side of a dataset."""

    records: DataFrame
    clusters: DataFrame
    gold: DataFrame


def split_of(records: DataFrame, clusters: DataFrame, part: str, share: float = 0.3, seed: int = 0) -> Split:
    """The train or test side: whole clusters, stratified by size, so no entity stands on both."""
    if part not in ("train", "test"):
        raise ValueError(f"part is train or test, not {part}")
    own = curate.stratified_split(clusters, share, seed).where(F.col("part") == part).select("id", "cluster")
    return Split(records.join(own.select("id"), "id", "left_semi"), own, metrics.cluster_pairs(own))


def candidates_for(records: DataFrame, clusters: DataFrame, config: Mapping, features: list[score.Feature], part: str = "test", share: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Compared candidate pairs of one side, and that side's own gold pairs."""
    s = split_of(records, clusters, part, share, seed)
    return score.compare(build_blocker(config)(s.records), s.records, features), s.gold


def evaluate_model(model: pipeline.Model, split: Split) -> dict[str, float]:
    """BCubed and pair completeness of a model on a split."""
    found = model.resolve(split.records).withColumnRenamed("component", "cluster")
    b = metrics.bcubed(found, split.clusters).first()
    q = metrics.blocking_quality(model.candidates(split.records), split.gold, split.records).first()
    return {"bcubed_precision": b["precision"], "bcubed_recall": b["recall"], "bcubed_f1": b["f1"], "pair_completeness": q["pair_completeness"]}


def run_method(build: Callable[[float], pipeline.Model], train: Split, test: Split, grid: list[float]) -> dict[str, float]:
    """Tune the threshold of a model on the train side by BCubed F1 (the first of equals), grade it on the test side."""
    told = [(evaluate_model(build(t), train)["bcubed_f1"], t) for t in grid]
    best = max(range(len(grid)), key=lambda k: (round(told[k][0], 12), -k))
    floor = metrics.partition_track(test.clusters, test.clusters).first()["floor_bcubed_f1"]
    out = evaluate_model(build(grid[best]), test)
    return out | {"threshold": grid[best], "train_bcubed_f1": told[best][0], "delta_above_floor": out["bcubed_f1"] - floor}


# References to models


@dataclass(frozen=True)
class ModelRef:
    """A model by name only: ``kind`` hub (org/name), local (a path), api (a provider's name) or endpoint (with ``url``).

    Adapters go with models that are loaded in process; revisions pin hub models.
    """

    base: str
    kind: str
    adapter: str | None = None
    url: str | None = None
    revision: str | None = None

    def __post_init__(self):
        if not self.base or self.kind not in ("hub", "local", "api", "endpoint"):
            raise ValueError(f"no such model: {self.base!r} of kind {self.kind!r}")
        if self.adapter is not None and self.kind not in ("hub", "local"):
            raise ValueError("an adapter needs a model that is loaded in process")
        if (self.url is not None) != (self.kind == "endpoint"):
            raise ValueError("an endpoint, and only that, has a url")
        if self.revision is not None and self.kind != "hub":
            raise ValueError("only hub models have revisions")

    @classmethod
    def parse(cls, text: str, providers: tuple[str, ...] = ("openai", "anthropic", "openrouter", "azure", "gemini")) -> ModelRef:
        """``./dir`` and ``/dir`` are paths, ``http(s)://host/name`` an endpoint, ``provider/name`` an API, ``org/name[@revision]`` a hub model."""
        if text.startswith(("./", "../", "/", "~")):
            return cls(text, "local")
        if text.startswith(("http://", "https://")):
            url, _, name = text.rpartition("/")
            return cls(name, "endpoint", url=url)
        if text.partition("/")[0] in providers:
            return cls(text, "api")
        name, _, revision = text.partition("@")
        if name.count("/") != 1:
            raise ValueError(f"{text!r} names neither a path, an endpoint, an API nor a hub model")
        return cls(name, "hub", revision=revision or None)

    def to_config(self) -> dict[str, str]:
        """What is set, as plain values."""
        return {k: v for k, v in vars(self).items() if v is not None}


# Profiles


@dataclass(frozen=True)
class Profile:
    """Named tables that describe a dataset."""

    title: str
    sections: dict[str, DataFrame]

    @classmethod
    def of(cls, title: str, records: DataFrame, clusters: DataFrame | None = None, vectors: DataFrame | None = None, scored: DataFrame | None = None) -> Profile:
        """Fields always; labels, embeddings and scores where they are given."""
        names = [f.name for f in records.schema.fields if f.dataType.simpleString() == "string" and f.name != "id"]
        out = {"fields": profile.fields(records, names)}
        if clusters is not None:
            out |= {"labels": profile.label_structure(clusters), "cluster sizes": metrics.cluster_sizes(clusters)}
        if vectors is not None:
            out |= {"embeddings": profile.embedding_norms(vectors), "embedding lengths": profile.norm_histogram(vectors)}
        if scored is not None:
            out |= {"separability": profile.separability(scored), "AUC": metrics.roc_auc(scored), "best cut": metrics.best_f1(scored)}
        return cls(title, out)

    def headline(self) -> dict[str, float | int | None]:
        return profile.headline(self.sections)

    def to_html(self) -> str:
        return page(self.title, self.sections)
