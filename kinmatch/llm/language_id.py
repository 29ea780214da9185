"""Language identification with a string kernel.

Kernel: blended spectrum of byte n-grams (1 to 3) of the lower-cased text, presence only; for
each length the number of shared n-grams over the root of the product of both numbers, weighted
and added. Nystroem: landmark texts span the feature space, whose n-grams are the vocabulary.
One-versus-rest kernel ridge regression is fitted on the Nystroem features of a bounded sample;
whole texts are scored in batches, as a matrix product with the landmarks and one with the
regression's weights.

Bounds of the fit, whatever the corpus: SAMPLE_ROWS labelled rows of at most LONGEST characters and
together about SAMPLE_CHARS, shared out among the languages; the LANGUAGES that most rows bear (others are
never predicted, none is sampled away below that number); a landmark for each language and LANDMARKS at least;
the VOCABULARY n-grams of each length that most landmarks hold.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null language is
not learned from; without any labelled row every text is ``und``; a null doc_id is never learned
from; of tied scores the first language in the order of names is taken; a text of any length is scored as a
whole, a batch at a time; repeated rows are scored alike; other columns pass through, but those named lang_pred or
score are replaced.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm.textkit import with_columns
from kinmatch.storage import spread

#: Bounds of the fit: labelled rows sampled, characters of the longest text learned from and of all together, landmarks,
#: languages, n-grams of each length.
SAMPLE_ROWS, LONGEST, SAMPLE_CHARS, LANDMARKS, LANGUAGES, VOCABULARY = 3200, 200_000, 64_000_000, 192, 400, 60_000
#: Weights of the n-gram lengths 1, 2, 3; the ridge; texts in a matrix product.
WEIGHTS, RIDGE, BATCH = (0.1, 0.4, 0.5), 1e-3, 256
#: A text of a known language has this share of the known three-byte n-grams that the median landmark
#: has in common with the others.
FAMILIAR = 0.7
UNKNOWN = "und"
#: ASCII bytes that are no letters become spaces.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_tables: dict[str, list[np.ndarray]] = {}


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return text is not None and any(map(str.isalpha, text))


def ngrams(text: str) -> list[np.ndarray]:
    """Codes of the byte n-grams of lengths 1 to 3, with repetitions; runs of spaces count once."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()) + b" "
    one = np.frombuffer(raw, np.uint8).astype(np.int32)
    two = (one[:-1] << 8) | one[1:]
    return [one, two, (two[:-1] << 8) | one[2:]]


def lookup(model: dict) -> list[np.ndarray]:
    """For each length, code -> place in the vocabulary, or the place after the last; kept by each process."""
    if model["name"] not in _tables:
        _tables.clear()
        size, base, out = sum(len(v) for v in model["vocabulary"]), 0, []
        for n, codes in enumerate(model["vocabulary"]):
            table = np.full(1 << (8 * (n + 1)), size, np.int32 if size > 65_000 else np.uint16)
            table[codes] = base + np.arange(len(codes))
            base += len(codes)
            out.append(table)
        _tables[model["name"]] = out
    return _tables[model["name"]]


def features(texts: list[str], model: dict, covered: np.ndarray | None = None) -> np.ndarray:
    """Rows whose inner products are the kernel over the vocabulary; ``covered`` gets the share of known three-byte n-grams."""
    tables, lengths = lookup(model), [len(v) for v in model["vocabulary"]]
    x = np.zeros((len(texts), sum(lengths) + 1), np.float32)
    size = x.shape[1] - 1
    for k, (row, text) in enumerate(zip(x, texts, strict=True)):
        for table, codes in zip(tables, ngrams(text), strict=True):
            places = table[codes]
            row[places] = 1
        if covered is not None:
            covered[k] = (places < size).mean()
    x, base = x[:, :-1], 0
    for n, weight in zip(lengths, WEIGHTS, strict=True):
        part = x[:, base : base + n]
        part *= np.sqrt(weight / np.maximum(part.sum(axis=1, keepdims=True), 1))
        base += n
    return x


def _most_held(codes: list[np.ndarray]) -> np.ndarray:
    """Ascending n-grams of texts; beyond VOCABULARY those that most texts hold."""
    known, texts = np.unique(np.concatenate([np.unique(c) for c in codes]), return_counts=True)
    return known if len(known) <= VOCABULARY else np.sort(known[np.argsort(-texts, kind="stable")[:VOCABULARY]])


def _shared(codes: list[np.ndarray]) -> list[float]:
    """For each text, the share of its n-grams that another text has too."""
    known, texts = np.unique(np.concatenate([np.unique(c) for c in codes]), return_counts=True)
    return [float((texts[np.searchsorted(known, c)] > 1).mean()) for c in codes]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Model from labelled texts; the landmarks are the first texts of each language in turn."""
    names = sorted(set(langs))
    model = {"name": uuid.uuid4().hex, "langs": names, "vocabulary": [], "landmarks": None, "weights": None, "border": 0.0}
    if not names:
        return model
    queues = {n: [t for t, x in zip(texts, langs, strict=True) if x == n] for n in names}
    chosen = [q[k] for k in range(max(map(len, queues.values()))) for q in queues.values() if k < len(q)][: max(landmarks, len(names))]
    model["vocabulary"] = [_most_held(x) for x in zip(*map(ngrams, chosen), strict=True)]
    model["border"] = FAMILIAR * float(np.median(_shared([ngrams(t)[2] for t in chosen])))
    marks = features(chosen, model)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    gram, target = np.zeros((kept.sum(), kept.sum())), np.zeros((kept.sum(), len(names)))
    for k in range(0, len(texts), BATCH):
        phi = (features(texts[k : k + BATCH], model) @ marks.T).astype(np.float64) @ root
        y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs[k : k + BATCH]])
        gram += phi.T @ phi
        target += phi.T @ y
    weights = np.linalg.solve(gram + ridge * max(1, len(texts)) * np.eye(len(gram)), target)
    return model | {"landmarks": marks.T.copy(), "weights": (root @ weights).astype(np.float32)}


def judge(texts: list[str | None], model: dict) -> tuple[list[str], list[float], list[float]]:
    """Language, score (the best one-versus-rest output, moved from [-1, 1] to [0, 1]) and share of known n-grams of whole texts."""
    langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model["langs"] else []
    for k in range(0, len(known), BATCH):
        at = known[k : k + BATCH]
        covered = np.zeros(len(at))
        f = features([texts[i] for i in at], model, covered) @ model["landmarks"] @ model["weights"]
        best = f.argmax(axis=1)
        for i, b, v, c in zip(at, best, f.max(axis=1), covered, strict=True):
            langs[i], scores[i], shares[i] = model["langs"][b], float(min(1.0, max(0.0, (v + 1) / 2))), float(c)
    return langs, scores, shares


def classify(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score of whole texts."""
    return judge(texts, model)[:2]


def _columns(texts: list, shipped) -> dict:
    langs, scores, shares = judge(texts, shipped.value)
    return {"lang_pred": langs, "score": scores, "__covered": shares}


def _forget() -> None:
    _tables.clear()


def held_out():
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most about ``sample_rows`` labelled rows, as many of each language as there are."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).where(F.length("text").between(1, LONGEST))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    share = max(8, sample_rows // max(1, len(counts)))
    # Hash order: about a fifth more than a language's share is drawn, then cut to it and to its characters.
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * share / n + 10 / n))])[F.col("lang")] if counts else F.lit(0.0)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000).select("doc_id", "text", "lang")
    place = F.xxhash64("doc_id", F.lit(1))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("place", place).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_CHARS // max(1, len(counts)))
    drawn = sorted(drawn.drop("before").collect(), key=lambda r: (r["place"], r["doc_id"]))
    rows, taken = [], dict.fromkeys(counts, 0)
    for r in drawn:
        if taken[r["lang"]] < share and has_letter(r["text"]):
            taken[r["lang"]] += 1
            rows.append((r["text"], r["lang"]))
    return fit([t for t, _ in rows], [x for _, x in rows])


def identify(docs: DataFrame, model: dict, covered: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score; on demand also __covered, the share of known three-byte n-grams."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, partial(_columns, shipped=shipped), "lang_pred string, score double" + (", __covered double" if covered else ""), done=_forget)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spread(docs.select("doc_id", "text")), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
