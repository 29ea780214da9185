"""Fixtures with every awkward row: nulls, blanks, long texts, ties, repeats and clashing columns."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()), StructField("n_lines", StringType())])
LONG = "The long tale of a word that goes on " * 3000
ROWS = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "One two three four five six seven.\nA line.\n\n", "en", None),
    (4, "One two three four five six seven.\nA line.\n\n", "en", "a"),
    (4, "One two three four five six seven.\nA line.\n\n", "en", "a"),
    (5, LONG, "en", "b"),
    (6, LONG + " end", "en", "b"),
    (None, "Ünïcode <|end|> ß  12 km \t\n x", "de", "b"),
    (7, "   \n\t\n", "de", "b"),
    (8, "a", "de", "b"),
    (9, "12 34 ... !!!", "de", "b"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash") for r in rows], SCHEMA).repartition(3)


def stored(spark, df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
