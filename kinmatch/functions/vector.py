"""Vector arithmetic as built-in expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero or missing."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine moved from [-1, 1] to [0, 1]; 0 where it is undefined."""
    return F.coalesce(F.least(F.greatest((cosine(a, b) + 1) / 2, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query vector the best inner product among the document's, added up."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)
