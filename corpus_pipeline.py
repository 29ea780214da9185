"""A training corpus from raw documents: known languages, fresh lines, one of each group of near
copies, nothing of the benchmark, packed into sequences.

Every stage works on all that the one before it kept and returns the columns of ``documents``, but
the last, which returns the pieces of the packed sequences.

Defined cases, for every stage: texts of any length are worked on as a whole; an empty table gives no rows and
keeps its columns; columns of the documents pass through whatever their names. Null and empty texts go in the first stage,
as they have no letter; later stages, called by themselves, keep them. Rows without a doc_id are documents. Repeated rows
are decided alike but in the n-gram join, where one of them stays. Ties are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from kinmatch.storage import materialise, spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no known language go; the score cannot tell foreign from short texts, known n-grams can."""
    model = language_id.train(docs)
    scored = language_id.identify(spread(docs), model, covered=True)
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("__covered") >= model["border"])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and similarity 0.8, the smallest id stays."""
    return ngram_join.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark items go, re-parameterised ones too."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_sequences),
]
#: SQL cannot express the learned language model; tests hold the operators against brute force and the stages against what they
#: keep of awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
