"""Sources: normalised records, linkage tables, JSON datasets, splits of labelled pairs, embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from kinmatch.functions.pairs import positioned
from kinmatch.operators.cluster import complete_partition, connected_components


def check_unique(records: DataFrame, column: str = "id") -> DataFrame:
    """``records``; raises if an id repeats."""
    twice = records.groupBy(column).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0][0]!r} repeats")
    return records


def normalize(records: DataFrame, order: str | None = None) -> DataFrame:
    """Records with a string ``id`` and every other scalar as string, NaN as null; nested columns are refused.

    Without an ``id`` column ids are positions in the order of ``order``. Ids that are null are refused.
    """
    nested = [f.name for f in records.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)]
    if nested:
        raise ValueError(f"nested columns {nested} cannot be compared")
    if "id" not in records.columns:
        records = positioned(records, order or records.columns[0]).withColumnRenamed("pos", "id")
    elif records.where("id is null").limit(1).count():
        raise ValueError("some records have an id and some have none")
    out = []
    for f in records.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("float", "double"):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast("string").alias(f.name))
    return check_unique(records.select(*out))


def inferred_name(records: DataFrame) -> str:
    """Stable name of an inferred schema."""
    return "Inferred_" + hashlib.sha256(",".join(sorted(c for c in records.columns if c != "id")).encode()).hexdigest()[:8]


def read_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """A CSV file with a header; cells stripped, blank ones null."""
    df = spark.read.csv(path, header=True, quote=quote, multiLine=True)
    return df.select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in df.columns])


def linkage(left: DataFrame, right: DataFrame, mapping: DataFrame, left_prefix: str = "a_", right_prefix: str = "b_") -> tuple[DataFrame, DataFrame]:
    """Two tables as one with prefixed ids and ``source``, and the gold pairs of mapping rows whose label is 1.

    ``mapping``: ltable_id, rtable_id, label (absent: all are matches).
    """
    shared = [c for c in left.columns if c in right.columns and c != "id"]
    of = lambda t, p, s: t.select(F.concat(F.lit(p), F.col("id").cast("string")).alias("id"), F.lit(s).alias("source"), *shared)
    rows = mapping if "label" not in mapping.columns else mapping.where("label = 1")
    gold = rows.select(F.concat(F.lit(left_prefix), F.col("ltable_id").cast("string")).alias("l"), F.concat(F.lit(right_prefix), F.col("rtable_id").cast("string")).alias("r"))
    return of(left, left_prefix, "a").unionByName(of(right, right_prefix, "b")), gold.select(F.least("l", "r").alias("pair_a"), F.greatest("l", "r").alias("pair_b")).distinct()


def id_map(rows: DataFrame, column: str, prefix: str, order: str) -> DataFrame:
    """(raw, id) of a source table: prefix and raw id where every raw id is a number, else prefix and the row's place by ``order``.

    Raises if a raw id repeats, as two records would become one.
    """
    raw = rows.select(F.trim(F.col(column).cast("string")).alias("raw"), F.col(order).alias("__o"))
    n, distinct, numbers = raw.agg(F.count("*"), F.countDistinct("raw"), F.count_if(F.col("raw").rlike("^[0-9]+$"))).first()
    if n != distinct:
        raise ValueError(f"raw ids of {column} repeat or are missing")
    if n == numbers:
        return raw.select("raw", F.concat(F.lit(prefix), "raw").alias("id"))
    return positioned(raw, "__o").select("raw", F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("id"))


def row_records(rows: DataFrame, fields: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Stripped fields of rows: blank ones are null, or empty where they are required; other columns stay."""
    told = {f: F.when(F.trim(F.col(f).cast("string")) != "", F.trim(F.col(f).cast("string"))) for f in fields}
    return rows.withColumns({f: F.coalesce(c, F.lit("")) if f in required else c for f, c in told.items()})


def person_pairs(a: DataFrame, b: DataFrame, mapping: DataFrame, raw_id: str = "rec_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Person files of two sources and a mapping (id_a, id_b): records with ids a<raw> and b<raw>, closed-world clusters
    (unmatched records alone) and gold pairs."""
    of = lambda t, p: t.select(F.concat(F.lit(p), F.trim(F.col(raw_id).cast("string"))).alias("id"), F.lit(p).alias("source"), *[c for c in a.columns if c != raw_id])
    records = check_unique(of(a, "a").unionByName(of(b, "b")))
    gold = mapping.select(F.concat(F.lit("a"), F.trim(F.col("id_a").cast("string"))).alias("pair_a"), F.concat(F.lit("b"), F.trim(F.col("id_b").cast("string"))).alias("pair_b")).distinct()
    matched = connected_components(gold, "pair_a", "pair_b")
    return records, complete_partition(matched, records).withColumnRenamed("component", "cluster"), gold


@dataclass(frozen=True)
class Benchmark:
    """A named dataset: what loads (records, gold pairs), and what it is called elsewhere."""

    name: str
    load: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]] | None
    description: str = ""


BENCHMARKS: dict[str, Benchmark] = {}


def register_benchmark(benchmark: Benchmark) -> Benchmark:
    """Add a dataset; a name can be taken once."""
    if BENCHMARKS.setdefault(benchmark.name, benchmark) is not benchmark:
        raise ValueError(f"benchmark {benchmark.name} is taken")
    return benchmark


def load_benchmark(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records and gold pairs of a registered dataset from the files in a folder."""
    if name not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name}; there are {', '.join(sorted(BENCHMARKS))}")
    if BENCHMARKS[name].load is None:
        raise ValueError(f"{name} has to be downloaded by hand")
    return BENCHMARKS[name].load(spark, folder)


def _two_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    read = lambda f: read_csv(spark, f"{folder}/{f}.csv")
    mapping = read("train").unionByName(read("valid")).unionByName(read("test"))
    return linkage(read("tableA"), read("tableB"), mapping)


def _persons(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    read = lambda f: read_csv(spark, f"{folder}/{f}.csv")
    records, _, gold = person_pairs(read("person_a"), read("person_b"), read("perfectMapping"))
    return records, gold


def _restaurants(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    read = lambda f: read_csv(spark, f"{folder}/{f}.csv", quote="'")
    mapping = read_csv(spark, f"{folder}/matches_fodors_zagats.csv").select(F.col("fodors_id").alias("ltable_id"), F.col("zagats_id").alias("rtable_id"))
    return linkage(read("fodors"), read("zagats"), mapping, "f_", "z_")


for _name in ("abt_buy", "amazon_google", "dblp_acm", "dblp_scholar", "walmart_amazon", "wdc_products"):
    register_benchmark(Benchmark(_name, _two_tables, "tableA, tableB, and train, valid and test pairs"))
register_benchmark(Benchmark("febrl_person", _persons, "two person files and a mapping"))
register_benchmark(Benchmark("fodors_zagat", _restaurants, "two restaurant files and their matches"))


def read_groups(spark: SparkSession, names_path: str, groups_path: str) -> tuple[DataFrame, DataFrame]:
    """Dedup dataset of two JSON files: names {id: name} and groups of entity ids; gives (id, name) and (id, cluster)."""
    names = spark.read.text(names_path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.names"), "map<string,string>")).alias("id", "name"))
    groups = spark.read.text(groups_path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.groups"), "array<struct<canonical_name:string,entity_ids:array<string>>>")).alias("cluster", "g"))
    return names, groups.select(F.explode("g.entity_ids").alias("id"), "cluster")


def split_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Labelled pairs (left_id, right_id, label) that both stand in the corpus."""
    ids = records.select("id")
    return pairs.join(ids.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(ids.withColumnRenamed("id", "right_id"), "right_id", "left_semi")


def seen_slices(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test pairs tagged seen, half_seen or unseen by how many of their records stand in training pairs."""
    ids = train.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().withColumn("s", F.lit(1))
    of = lambda side: ids.select(F.col("id").alias(f"{side}_id"), F.col("s").alias(f"__{side}"))
    both = test.join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")
    n = F.coalesce("__left", F.lit(0)) + F.coalesce("__right", F.lit(0))
    return both.withColumn("slice", F.when(n == 2, "seen").when(n == 1, "half_seen").otherwise("unseen")).drop("__left", "__right")


def fingerprint(records: DataFrame) -> str:
    """Order-independent hash of a table: sorted digests of rows, folded through sums of their halves."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)"))
    got = records.select(row.alias("h")).agg(F.count("*"), *[part(k) for k in range(8)]).first()
    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def read_matrix(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, vector) of a matrix in .npy format whose rows belong to ``ids`` (id, pos); rows are read where they are asked for.

    The file is mapped into memory by each task, so it must stand where every executor can read it.
    """
    from kinmatch.storage import ensure_workers

    ensure_workers(spark)

    def read(parts):
        import numpy as np

        m = np.load(path, mmap_mode="r", allow_pickle=False)
        for pdf in parts:
            yield pdf[["id"]].assign(vector=[m[k].astype("float32").tolist() for k in pdf["pos"]])

    return ids.select("id", "pos").mapInPandas(read, f"id {ids.schema['id'].dataType.simpleString()}, vector array<float>")


def vectors_for(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of the asked ids; ids without one have a null."""
    return ids.select("id").join(vectors.select("id", "vector"), "id", "left")
