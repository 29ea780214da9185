"""Names for what can be built: methods, and configurations as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmatch.operators import blocking, judge, score

#: Scoring methods by name: (pairs, records, features, settings) -> judged pairs.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "string": lambda p, r, f, **s: score.weighted_average(score.compare(p, r, f), f),
    "weighted_average": lambda p, r, f, **s: score.weighted_average(score.compare(p, r, f), f),
    "rapidfuzz": lambda p, r, f, **s: score.rapid(p, r, f),
    "embedding": lambda p, r, f, **s: score.embedding_score(p),
    "embedding_cosine": lambda p, r, f, **s: score.embedding_score(p),
    "fellegi_sunter": lambda p, r, f, model, **s: model.score(score.compare(p, r, f)),
    "random_forest": lambda p, r, f, model, **s: score.score_random_forest(model, score.compare(p, r, f), [x.name for x in f]),
    "zero_shot_llm": lambda p, r, f, client, **s: judge.parse(judge.generate(judge.prompts(p, r, [x.name for x in f]), client)),
    "prompt_llm": lambda p, r, f, client, template=judge.PROMPT, **s: judge.parse(judge.generate(judge.prompts(p, r, [x.name for x in f], template), client), score=True),
    "llm_judge": lambda p, r, f, client, template=judge.PROMPT, **s: judge.parse(judge.generate(judge.prompts(p, r, [x.name for x in f], template), client)),
    "select_judge": lambda p, r, f, client, **s: judge.select_in_groups(blocking.groups(p, "right_id"), client),
    "cascade": lambda p, r, f, teacher, low=0.4, high=0.8, **s: score.cascade(score.weighted_average(score.compare(p, r, f), f), teacher, low, high),
}


def register_method(name: str, build: Callable[..., DataFrame]) -> None:
    """Add a method; a name can be taken once."""
    if METHODS.setdefault(name, build) is not build:
        raise ValueError(f"method {name} is taken")


def run_method(name: str, pairs: DataFrame, records: DataFrame, features: list[score.Feature], **settings) -> DataFrame:
    """Judge pairs by a named method."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name}; there are {', '.join(sorted(METHODS))}")
    return METHODS[name](pairs, records, features, **settings)


#: Parts of one's own by kind and name: schemas, components, operators, text extractors, response parsers, serializers.
REGISTRY: dict[str, dict[str, object]] = {}


def register_part(kind: str, name: str, part: object) -> object:
    """Register a part; a name can be taken once for each kind."""
    if REGISTRY.setdefault(kind, {}).setdefault(name, part) is not part:
        raise ValueError(f"{kind} {name} is taken")
    return part


def get_part(kind: str, name: str) -> object:
    """A registered part; raises with the names there are."""
    there = REGISTRY.get(kind, {})
    if name not in there:
        raise ValueError(f"unknown {kind} {name}; there are {', '.join(sorted(there)) or 'none'}")
    return there[name]


def save_features(spark: SparkSession, features: list[score.Feature], path: str) -> None:
    """Features as one JSON row."""
    text = json.dumps([{"name": f.name, "weight": f.weight, "algorithm": f.algorithm} for f in features], sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_features(spark: SparkSession, path: str) -> list[score.Feature]:
    """What :func:`save_features` wrote."""
    return [score.Feature(**x) for x in json.loads(spark.read.text(path).first()[0])]
