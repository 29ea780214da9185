"""String similarity (normalised Indel) and text helpers.

The similarity is ``2 * LCS / (len a + len b)``, 1 for two empty strings. The fast path is an Arrow
UDF with a bit-parallel LCS; ``indel_expr`` is the same as a built-in expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine word operation a character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Normalised Indel similarity."""
    n = len(a) + len(b)
    return 2.0 * lcs(a, b) / n if n else 1.0


@F.pandas_udf(DoubleType())
def indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two columns; null if either is."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = indel(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def indel_expr(a: Column, b: Column) -> Column:
    """The same as an expression: dynamic programming in nested aggregates."""
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda new, j: F.concat(new, F.array(F.when(F.substring(b, j, F.lit(1)) == ch, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(new, j - 1))))),
        )

    common = F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.aggregate(F.split(a, ""), zero, step, lambda row: F.element_at(row, -1)))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def token_sorted(c: Column) -> Column:
    """Words in ascending order, by single spaces."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def similarity(a: Column, b: Column, algorithm: str = "token_sort_ratio") -> Column:
    """``ratio``, ``token_sort_ratio`` or ``token_set_ratio`` in [0, 1]."""
    if algorithm == "ratio":
        return indel_udf(a, b)
    if algorithm == "token_sort_ratio":
        return indel_udf(token_sorted(a), token_sorted(b))
    if algorithm != "token_set_ratio":
        raise ValueError(f"unknown algorithm {algorithm}")
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    join = lambda *xs: F.array_join(F.concat(*xs), " ")
    both, only_a, only_b = (F.array_sort(x) for x in (F.array_intersect(ta, tb), F.array_except(ta, tb), F.array_except(tb, ta)))
    with_a, with_b = join(both, only_a), join(both, only_b)
    score = F.greatest(indel_udf(join(both), with_a), indel_udf(join(both), with_b), indel_udf(with_a, with_b))
    subset = (F.size(both) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    return F.when(a.isNull() | b.isNull(), None).when(empty, 0.0).when(subset, 1.0).when(F.size(both) == 0, indel_udf(with_a, with_b)).otherwise(score)


def with_similarity(pairs: DataFrame, name: str, left: Column, right: Column, algorithm: str = "token_sort_ratio") -> DataFrame:
    """Add the similarity of two string columns, compared once for each distinct pair of values.

    Missing (null or empty) on either side gives null. Values repeat far more often than pairs do where
    records are duplicates of each other, so the costly comparison sees few rows.
    """
    from kinmatch.storage import ensure_workers

    ensure_workers(pairs.sparkSession)
    asked = pairs.withColumn("__a", F.when(left != "", left)).withColumn("__b", F.when(right != "", right))
    distinct = asked.select("__a", "__b").where("__a is not null and __b is not null").distinct()
    told = distinct.withColumn(name, similarity(F.col("__a"), F.col("__b"), algorithm))
    return asked.drop(name).join(told, ["__a", "__b"], "left").drop("__a", "__b")


def folded(c: Column) -> Column:
    """Blocking key: white space off both ends, lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def parse_score(c: Column) -> Column:
    """The number of the first ``score: x`` in an answer, cut to [0, 1]; null without one."""
    found = F.regexp_extract(c, r"(?i)score\s*:\s*([0-9]*\.?[0-9]+)", 1)
    return F.when(found != "", F.least(F.greatest(found.try_cast("double"), F.lit(0.0)), F.lit(1.0)))


def parse_yes_no(c: Column) -> Column:
    """True if the answer says yes, False if it says no, null if it says neither."""
    said = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))
    return F.when(said.contains("yes"), True).when(said.rlike(r"\bno\b"), False)


def parse_binary(c: Column) -> Column:
    """Strict verdict of the first line: MATCH or YES, NO_MATCH, NO MATCH or NO; else null."""
    first = F.upper(F.trim(F.substring_index(F.trim(c), "\n", 1)))
    return F.when(first.isin("MATCH", "YES"), True).when(first.isin("NO_MATCH", "NO MATCH", "NO"), False)


def col_val(fields: list[str]) -> Column:
    """``COL name VAL value`` of every field that is there."""
    return F.concat_ws(" ", *[F.when(F.col(f) != "", F.concat(F.lit(f"COL {f} VAL "), F.col(f))) for f in fields])


def truncated(c: Column, words: int) -> Column:
    """The first words."""
    return F.array_join(F.slice(tokens(c), 1, words), " ")


def spreadsheet_safe(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def without_controls(value: Column) -> Column:
    """Text for a terminal: escape sequences (ANSI) and control characters but tabs and line ends go."""
    bare = F.regexp_replace(value, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "")
    return F.regexp_replace(bare, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
