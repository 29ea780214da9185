"""Sinks and logs: judgement logs, corrections, review queues, gold sets and spreadsheet exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.pairs import canonical
from kinmatch.functions.text import spreadsheet_safe

#: Fixed schema of a judgement log, version 4; older rows lack the later columns.
JUDGEMENTS = "v int, run_id string, left_id string, right_id string, score double, decision boolean, verdict boolean, confidence double, confidence_source string, model string, cost_usd double, decision_step string, stage_id string, timestamp string"
CORRECTIONS = "v int, left_id string, right_id string, label boolean, original_score double, original_verdict boolean, reviewer string, timestamp string"
REVIEW = "v int, left_id string, right_id string, score double, verdict boolean, reason string, confidence double, left_record string, right_record string"


def append(rows: DataFrame, path: str, schema: str) -> None:
    """Append rows to a JSON log in the schema's columns; what is missing is null."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]).write.mode("append").json(path)


def logged(judged: DataFrame, path: str, run_id: str, model: str | None = None) -> DataFrame:
    """Judged pairs, written to a judgement log first; what is returned is read from the rows written, so a pair is judged once."""
    from kinmatch.storage import materialise

    rows = materialise(judged, "judged")
    append(rows.withColumn("v", F.lit(4)).withColumn("run_id", F.lit(run_id)).withColumn("model", F.lit(model).cast("string")).withColumn("timestamp", F.current_timestamp().cast("string")), path, JUDGEMENTS)
    return rows


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with the schema's columns; raises on a line that is no JSON of it."""
    df = spark.read.schema(schema + ", _corrupt_record string").json(path, columnNameOfCorruptRecord="_corrupt_record")
    bad = df.select("_corrupt_record", "left_id").where("_corrupt_record is not null").limit(1).collect()
    if bad:
        raise ValueError(f"not a log row: {bad[0][0][:200]}")
    return df.drop("_corrupt_record")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """A judgement log of any version: rows of old ones get their later columns filled in."""
    df = read(spark, path, JUDGEMENTS)
    return df.withColumn("confidence_source", F.coalesce("confidence_source", F.lit("none"))).withColumn("decision", F.when(F.coalesce("v", F.lit(1)) >= 4, F.col("decision")))


def export_review(items: DataFrame, path: str) -> None:
    """Review items as CSV with an empty label column; cells that look like formulas are quoted."""
    cols = [spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in items.columns]
    items.select(*cols, F.lit("").alias("label")).write.mode("overwrite").csv(path, header=True)


def import_labels(spark: SparkSession, path: str, queue: DataFrame) -> DataFrame:
    """Corrections of a labelled CSV: all of it or an error, if a label is neither yes nor no or a pair was never asked."""
    rows = spark.read.csv(path, header=True).withColumn("l", F.lower(F.trim("label"))).where("l <> ''")
    yes, no = ("1", "true", "yes", "match"), ("0", "false", "no", "no_match")
    wrong = rows.where(~F.col("l").isin(*yes, *no)).limit(1).collect()
    if wrong:
        raise ValueError(f"label {wrong[0]['label']!r} is neither yes nor no")
    if canonical(rows).join(canonical(queue).select("pair_a", "pair_b"), ["pair_a", "pair_b"], "left_anti").limit(1).count():
        raise ValueError("a labelled pair is not in the queue")
    return rows.select(F.lit(1).alias("v"), "left_id", "right_id", F.col("l").isin(*yes).alias("label"))
