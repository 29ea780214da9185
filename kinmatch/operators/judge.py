"""Model-backed operators with injectable clients: pairwise and set-wise judging, reranking, embedding.

A client is a picklable callable that takes a list of inputs and gives a list of outputs; it runs on the
executors, a batch at a time. The stand-ins below are deterministic and need no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType, _parse_datatype_string

from kinmatch.functions import text
from kinmatch.storage import dealt, ensure_workers

PROMPT = "Do these two records describe the same entity? Answer MATCH or NO_MATCH.\n\nA: {left}\n\nB: {right}\n"


def record_json(fields: list[str]) -> Column:
    """A record as JSON with sorted keys, missing values left out."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]))


def prompts(pairs: DataFrame, records: DataFrame, fields: list[str], template: str = PROMPT) -> DataFrame:
    """Pairs with the text that is put to a model."""
    of = lambda side: records.select(F.col("id").alias(f"{side}_id"), record_json(fields).alias(f"__{side}"))
    out = pairs.join(of("left"), "left_id").join(of("right"), "right_id")
    return out.withColumn("prompt", filled(F.col("__left"), F.col("__right"), template)).drop("__left", "__right")


def filled(left: Column, right: Column, template: str = PROMPT) -> Column:
    """A template with both records in it."""
    before, _, rest = template.partition("{left}")
    between, _, after = rest.partition("{right}")
    return F.concat(F.lit(before), left, F.lit(between), right, F.lit(after))


def _ask(parts: Iterator[pd.DataFrame], client: Callable[[list], list], column: str, to: str) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        yield pdf.assign(**{to: client(pdf[column].tolist()) if len(pdf) else []})


def generate(rows: DataFrame, client: Callable[[list[str]], list[str | None]], column: str = "prompt") -> DataFrame:
    """Add ``response`` of each row; a null response is an error of that row only."""
    ensure_workers(rows.sparkSession)
    rows = rows.drop("response")
    return rows.mapInPandas(partial(_ask, client=client, column=column, to="response"), StructType([*rows.schema.fields, StructField("response", StringType())]))


USAGE = "response string, input_tokens long, output_tokens long, cost_usd double, error string"


def _ask_with_usage(parts: Iterator[pd.DataFrame], client: Callable[[list], list], column: str) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in USAGE.split(", ")]
    for pdf in parts:
        told = client(pdf[column].tolist()) if len(pdf) else []
        if len(told) != len(pdf):
            raise ValueError(f"{len(told)} answers to {len(pdf)} questions")
        out = pd.DataFrame([[(t or {}).get(n) for n in names] for t in told], columns=names, dtype=object)
        yield pd.concat([pdf.reset_index(drop=True), out.astype({"input_tokens": "Int64", "output_tokens": "Int64", "cost_usd": "Float64"})], axis=1)


def generate_with_usage(rows: DataFrame, client: Callable[[list[str]], list[dict | None]], column: str = "prompt") -> DataFrame:
    """Add response, tokens, cost and error of each row, as far as the client tells them; what it does not stays null.

    The client gives one mapping for each question, in order; None is an answer of which nothing is known.
    """
    ensure_workers(rows.sparkSession)
    rows = rows.drop(*[c.split()[0] for c in USAGE.split(", ")])
    return rows.mapInPandas(partial(_ask_with_usage, client=client, column=column), StructType([*rows.schema.fields, *_parse_datatype_string(USAGE).fields]))


def usage(rows: DataFrame, *by: str) -> DataFrame:
    """Calls, errors, tokens and cost; the cost is null if that of any call is unknown."""
    known = F.count("cost_usd") == F.count("*")
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(known, F.sum("cost_usd")).alias("cost_usd"))


def parse(rows: DataFrame, score: bool = False) -> DataFrame:
    """Verdicts of responses: a decision, or a score if ``score``; what cannot be read abstains."""
    r = F.col("response")
    decision = F.lit(None).cast("boolean") if score else text.parse_binary(r)
    value = text.parse_score(r) if score else F.lit(None).cast("double")
    step = F.when(r.isNull(), "error").when(F.coalesce(decision.isNull() & value.isNull(), F.lit(True)), "unparsed").otherwise("parsed")
    return rows.withColumns({"decision": decision, "score": value, "score_type": F.when(step == "parsed", "prob_llm"), "decision_step": step})


def rerank(pairs: DataFrame, client: Callable[[list[str]], list[float]], column: str = "prompt") -> DataFrame:
    """New scores in [0, 1]; decisions are cleared."""
    ensure_workers(pairs.sparkSession)
    rows = pairs.drop("score", "decision", "score_type", "rerank")
    out = rows.mapInPandas(partial(_ask, client=client, column=column, to="rerank"), StructType([*rows.schema.fields, StructField("rerank", DoubleType())]))
    return out.withColumn("score", F.least(F.greatest(F.col("rerank").cast("double"), F.lit(0.0)), F.lit(1.0))).drop("rerank").withColumns({"decision": F.lit(None).cast("boolean"), "score_type": F.lit("heuristic")})


def select_in_groups(groups: DataFrame, client: Callable[[list], list]) -> DataFrame:
    """Set-wise judging of anchor groups (left_id, members): the client picks at most one member of each; rows
    (left_id, right_id, score) with 1 for the picked one and 0 for others, all 0 if it fails."""
    ensure_workers(groups.sparkSession)

    def pick(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return _pick(parts, client)

    pick = F.pandas_udf(pick, groups.schema["members"].dataType.elementType)
    told = groups.select("left_id", "members", pick("left_id", "members").alias("picked"))  # members go to the client, not back
    return told.select("left_id", F.explode("members").alias("right_id"), "picked").select("left_id", "right_id", F.coalesce(F.col("picked") == F.col("right_id"), F.lit(False)).cast("double").alias("score"), F.lit("prob_group_llm").alias("score_type"))


def _pick(parts: Iterator[tuple[pd.Series, pd.Series]], client: Callable[[list], list]) -> Iterator[pd.Series]:
    for left, members in parts:
        asked = [(a, list(m)) for a, m in zip(left, members, strict=True)]
        got = client(asked) if asked else []
        yield pd.Series([p if p in m else None for p, (_, m) in zip(got, asked, strict=True)], dtype=object)


def embed(records: DataFrame, fields: list[str], client: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add ``vector`` of the present fields joined by spaces."""
    ensure_workers(records.sparkSession)
    rows = dealt(records).drop("vector").withColumn("embed_text", F.concat_ws(" ", *[F.when(F.col(f) != "", F.col(f)) for f in fields]))
    return rows.mapInPandas(partial(_ask, client=client, column="embed_text", to="vector"), StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType()))]))


def embed_missing(records: DataFrame, fields: list[str], client, cache: DataFrame) -> DataFrame:
    """Vectors from a cache (key, vector) of text hashes, and the client's for texts that are not in it."""
    key = F.sha2(F.concat_ws(" ", *[F.when(F.col(f) != "", F.col(f)) for f in fields]), 256)
    keyed = records.withColumn("key", key)
    known = keyed.join(cache.select("key", "vector"), "key")
    fresh = embed(keyed.join(cache.select("key"), "key", "left_anti"), fields, client).drop("embed_text")
    return known.unionByName(fresh.select(*known.columns))


# Stand-ins


def hash_unit(value: Column) -> Column:
    """A number in [0, 1) that the SHA-256 of a text gives."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_embedder(texts: list[str], size: int = 32) -> list[list[float]]:
    """Unit vectors drawn from a generator that the text's SHA-256 seeds."""
    out = []
    for t in texts:
        v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8])).uniform(-1, 1, size)
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out


def hash_reranker(texts: list[str]) -> list[float]:
    """Scores that the SHA-256 of the text gives."""
    return [int.from_bytes(hashlib.sha256(t.encode()).digest()[:4]) / (1 << 32) for t in texts]


def scripted_model(texts: list[str], answers: dict[str, str], default: str | None = None) -> list[str | None]:
    """The answer of the first key that stands in the text."""
    return [next((a for k, a in answers.items() if k in t), default) for t in texts]


def counted_model(texts: list[str], answer: str = "MATCH", price: float = 0.001) -> list[dict]:
    """One answer to everything; tokens are words, and each costs the same."""
    n = [len(t.split()) for t in texts]
    return [{"response": answer, "input_tokens": k, "output_tokens": len(answer.split()), "cost_usd": price * (k + len(answer.split()))} for k in n]


def first_member(groups: list) -> list:
    """Picks the first member of every group."""
    return [m[0] if m else None for _, m in groups]


def logprob_confidence(tokens: Column) -> Column:
    """Share of yes in the mass of yes and no of an array of (token, logprob); null without either."""
    mass = lambda word: F.aggregate(F.filter(tokens, lambda t: F.lower(F.trim(t["token"])) == word), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))
    yes, no = mass("yes"), mass("no")
    return F.when(yes + no > 0, yes / (yes + no))
