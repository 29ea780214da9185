"""Shared storage and session helpers.

Intermediate tables are written to the folder that the session names in
``spark.checkpoint.dir``, which every executor can reach, so a lost executor
costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import gc
import os
import uuid
import warnings
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for local sessions that name no shared folder (tests, notebooks).
LOCAL_FALLBACK = "/tmp/checkpoints"
#: Ids that may be broadcast to filter a table; beyond it the filter shuffles.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one only where the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    warnings.warn(f"spark.checkpoint.dir is not set; tables of this local session go to {LOCAL_FALLBACK}", stacklevel=2)
    return f"{LOCAL_FALLBACK}/{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def trim(spark: SparkSession) -> bool:
    """Hand native memory that the driver's JVM has freed back to the system; its hundreds of threads keep it in arenas of
    their own. False where the JVM has no such command (17.0.9 or later, on glibc)."""
    jvm = spark._jvm
    asked = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    try:
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface: the server's own class is not open to calls.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:
        return False
    return True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # shuffle files go once nothing refers to them; without this they stay until the driver's heap is full
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`materialise` wrote and nobody reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small input has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores // 2 else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to twice as many tasks as there are cores, for steps that take long for each row: a small or compact
    file can be one split, or many of which one has all rows."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join on ``key``; ``ids`` is broadcast only if counted at most ``limit`` rows."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, how)


#: Rows from which a key is hot, and the share of all rows that it needs; so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 1000, 1e-5
#: Bytes of right rows of hot keys that are broadcast.
HOT_BYTES = 64 << 20


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", width: Column | None = None) -> DataFrame:
    """Join ``right``, which has one row a key, to ``left``, where one key may hold any share of the rows.

    Rows of hot keys stay where they are and get their right rows by a broadcast (``width``: bytes of
    a right row, summed before); the others are shuffled. Both sides should be stored tables, as they are read twice.
    """
    least = max(HOT_ROWS, int(left.count() * HOT_SHARE))
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(key)
    keys = [tuple(r) for r in hot.collect()]
    if not keys:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(keys, hot.schema)
    of_hot = right.join(F.broadcast(hot), key, "left_semi")
    n, size = of_hot.agg(F.count("*"), F.sum(F.lit(64) if width is None else width)).first()
    if not n or size > HOT_BYTES:
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(of_hot), key, how).unionByName(rest)


#: Python workers: freed memory goes back to the system, as they live as long as the session.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}
#: Arrow batches: rows can be whole documents, so the default of 10,000 is too many.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, with bounded batches."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    for key, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(key, value)
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
