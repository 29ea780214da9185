"""Reversible incremental line dedup: exact reference counts with sharded cuckoo filters before them.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. The
reference table holds, for each key, in how many documents it stands; keys that reach the threshold
also stand in the cuckoo filter of their shard. Inserting or deleting documents adds to or takes
from the counts, and moves only the keys that cross the threshold into or out of the filters, so
deleting what was inserted restores the former state. Applying an index ships the filters, which answer most
probes on the spot; what they let through is checked against the exact table, shipped too up to SHIPPED_KEYS,
else by a shuffle of those lines alone. Beyond FILTERED_KEYS the filters are too large to ship and lines are joined
with the exact table.

Defined cases: a null or empty text is one empty line and stays as it is (null stays null); keys
shorter than ``min_chars`` code points never count; rows that repeat a doc_id are one document in the counts of
one set of documents, rows without a doc_id are documents of their own; a text of any length is split whole; an
empty table gives no rows; other columns pass through, but those named n_lines or n_dropped
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.textkit import as_bytes, mix, with_columns
from kinmatch.storage import ensure_workers, materialise, restrict, spread

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys over the threshold that a shard is made for.
SHARD_KEYS = 100_000
#: Keys over the threshold that are shipped to workers (16 bytes each), and those whose filters are (about 2.5 bytes each).
SHIPPED_KEYS, FILTERED_KEYS = 1_000_000, 20_000_000
SPACE = b" \t\n\v\f\r"
U64 = np.uint64


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; keys are pairs of 64-bit integers."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / 3.4))))
        self.table = np.zeros((buckets, 4), np.uint16) if table is None else table
        self.mask = U64(len(self.table) - 1)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key."""
        print_ = np.maximum(k2.astype(U64) & U64(0xFFFF), U64(1))
        a = mix(k1.astype(U64)) & self.mask
        return print_.astype(np.uint16), a, a ^ (mix(print_) & self.mask)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Whether each key may be in; never False for one that is."""
        p, a, b = self.places(k1, k2)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if the filter is too full; the caller rebuilds it larger from the exact table."""
        state = 0x9E3779B9
        for p, a, b in zip(*self.places(k1, k2), strict=True):
            at = next((x for x in (int(a), int(b)) if (self.table[x] == 0).any()), None)
            at = int(a) if at is None else at
            for _ in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
                state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (state >> 16) & 3
                p, self.table[at, slot] = self.table[at, slot], p
                at = at ^ int(mix(np.array([p], U64))[0] & self.mask)
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove one fingerprint of each key, which must have been inserted."""
        for p, a, b in zip(*self.places(k1, k2), strict=True):
            for x in (int(a), int(b)):
                at = np.flatnonzero(self.table[x] == p)
                if len(at):
                    self.table[x, at[0]] = 0
                    break


def built(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    """A filter of these keys, as large as it takes."""
    size = len(k1)
    while not (f := CuckooFilter(size)).insert(k1, k2):
        size *= 2
    return f


def line_keys(raw: bytes, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of a text, 128-bit keys of them as rows of two integers, and which keys are long enough."""
    lines = raw.split(b"\n")
    keys = [x.strip(SPACE) for x in raw.lower().split(b"\n")]
    held = np.array([bool(k) if min_chars <= 1 else len(k.decode("utf-8", "surrogatepass")) >= min_chars for k in keys])
    return lines, np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), "<i8").reshape(-1, 2), held


def _keys(parts: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    """Distinct keys of each document; keys met again in the batch are added up at once."""
    for pdf in parts:
        seen = []
        for raw in as_bytes(pdf["text"]):
            _, keys, held = line_keys(raw, min_chars)
            seen.append(np.unique(keys[held], axis=0) if held.sum() > 1 else keys[held])
        keys, n = np.unique(np.concatenate(seen), axis=0, return_counts=True) if seen else (np.zeros((0, 2), np.int64), [])
        yield pd.DataFrame({"k1": keys[:, 0], "k2": keys[:, 1], "refs": n})


def _keys_of(parts: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    """Distinct keys of each row, with its doc_id."""
    for pdf in parts:
        for doc_id, raw in zip(pdf["doc_id"], as_bytes(pdf["text"]), strict=True):
            _, keys, held = line_keys(raw, min_chars)
            keys = np.unique(keys[held], axis=0)
            yield pd.DataFrame({"doc_id": [doc_id] * len(keys), "k1": keys[:, 0], "k2": keys[:, 1]})


@dataclass
class LineIndex:
    """Reference counts (k1, k2, refs) of all keys, and filters (shard, n_keys, bits) of the frequent ones."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        """Index of a first set of documents."""
        refs = materialise(_counted(docs, min_chars), "line_refs")
        frequent = refs.where(F.col("refs") >= min_docs)
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        return cls(refs, materialise(_new_filters(frequent, shards), "line_filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Index with further documents."""
        return self._moved(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Index without documents that were inserted; undoes :meth:`insert`."""
        return self._moved(docs, -1)

    def _moved(self, docs: DataFrame, sign: int) -> LineIndex:
        more = _counted(docs, self.min_chars).select("k1", "k2", (F.col("refs") * sign).alias("more"))
        both = self.refs.join(more, ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("refs", F.lit(0)).alias("was"), F.coalesce("more", F.lit(0)).alias("more"))
        both = materialise(both.withColumn("refs", F.col("was") + F.col("more")), "line_refs")
        over, before = F.col("refs") >= self.min_docs, F.col("was") >= self.min_docs
        crossed = both.where(over != before).select("k1", "k2", F.when(over, 1).otherwise(-1).alias("move"))
        crossed = crossed.withColumn("shard", _shard(self.shards))
        key = "shard"
        moved = self.filters.groupBy(key).cogroup(crossed.groupBy(key)).applyInPandas(_move, self.filters.schema)
        refs = both.where("refs > 0").select("k1", "k2", "refs")
        filters = materialise(moved, "line_filters")
        if filters.where("bits is null").limit(1).count():  # one ran full: all are made anew from the exact table
            frequent = refs.where(F.col("refs") >= self.min_docs)
            shards = max(1, -(-frequent.count() // SHARD_KEYS))
            return LineIndex(refs, materialise(_new_filters(frequent, shards), "line_filters"), shards, self.min_docs, self.min_chars)
        return LineIndex(refs, filters, self.shards, self.min_docs, self.min_chars)

    def apply(self, docs: DataFrame) -> DataFrame:
        """Documents without the lines whose key is frequent; n_lines counts before, n_dropped what went."""
        spark = docs.sparkSession
        frequent = self.refs.where(F.col("refs") >= self.min_docs).select("k1", "k2")
        n = frequent.limit(SHIPPED_KEYS + 1).count()
        added = "text string, n_lines long, n_dropped long"
        if n <= SHIPPED_KEYS:
            rows = frequent.toPandas()
            tables = {int(r.shard): np.frombuffer(r.bits, np.uint16).reshape(-1, 4) for r in self.filters.collect()}
            shipped = spark.sparkContext.broadcast((np.sort(_exact(rows["k1"].to_numpy(), rows["k2"].to_numpy())), tables, self.shards))
            return with_columns(docs, partial(_drop, shipped=shipped, min_chars=self.min_chars), added)
        filters = None
        if frequent.limit(FILTERED_KEYS + 1).count() <= FILTERED_KEYS:
            filters = spark.sparkContext.broadcast(({int(r.shard): np.frombuffer(r.bits, np.uint16).reshape(-1, 4) for r in self.filters.toLocalIterator()}, self.shards))
        own = [x + "_" * max(map(len, docs.columns)) for x in ("text_id", "line_keys", "gone")]  # longer than any name there is
        probe = with_columns(docs, partial(_probe, shipped=filters, min_chars=self.min_chars, names=own[:2]), f"{own[0]} binary, {own[1]} array<struct<k1:bigint,k2:bigint>>")
        lines = probe.dropDuplicates([own[0]]).select(own[0], F.explode(own[1]).alias("k")).select(own[0], "k.k1", "k.k2").distinct()
        gone = lines.join(frequent, ["k1", "k2"]).groupBy(own[0]).agg(F.collect_list(F.struct("k1", "k2")).alias(own[2]))
        joined = probe.drop(own[1]).join(gone, own[0], "left")
        ensure_workers(spark)
        fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_lines long", "n_dropped long"])
        return joined.mapInPandas(partial(_drop_joined, names=[f.name for f in fields], gone_name=own[2], min_chars=self.min_chars), schema)


def _counted(docs: DataFrame, min_chars: int) -> DataFrame:
    """In how many documents each key stands."""
    ensure_workers(docs.sparkSession)
    add_up = lambda rows: spread(rows.select("text")).mapInPandas(partial(_keys, min_chars=min_chars), "k1 long, k2 long, refs long")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return add_up(docs).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))
    repeated = materialise(repeated, "repeated_ids")
    of_one = restrict(docs.select("doc_id", "text"), repeated, "doc_id").mapInPandas(partial(_keys_of, min_chars=min_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long")
    of_one = of_one.distinct().select("k1", "k2", F.lit(1).cast("long").alias("refs"))
    return add_up(restrict(docs.select("doc_id", "text"), repeated, "doc_id", "left_anti")).union(of_one).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")  # k1 is a hash already


def _new_filters(frequent: DataFrame, shards: int) -> DataFrame:
    every = frequent.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    keyed = frequent.withColumn("shard", _shard(shards))
    return every.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(_make, "shard int, n_keys long, bits binary")


def _make(shard: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    f = built(keys["k1"].to_numpy(np.int64), keys["k2"].to_numpy(np.int64))
    return pd.DataFrame({"shard": shard["shard"], "n_keys": len(keys), "bits": [f.table.tobytes()]})


def _move(held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter(0, np.frombuffer(held["bits"][0], np.uint16).reshape(-1, 4).copy())
    out, into = (moves[moves["move"] == x] for x in (-1, 1))
    f.delete(out["k1"].to_numpy(np.int64), out["k2"].to_numpy(np.int64))
    fits = f.insert(into["k1"].to_numpy(np.int64), into["k2"].to_numpy(np.int64))
    return pd.DataFrame({"shard": held["shard"], "n_keys": held["n_keys"] + len(into) - len(out), "bits": [f.table.tobytes() if fits else None]})


EXACT = np.dtype([("k1", "<i8"), ("k2", "<i8")])


def _exact(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    out = np.empty(len(k1), EXACT)
    out["k1"], out["k2"] = k1, k2
    return out


def _in_filters(keys: np.ndarray, tables: dict, shards: int) -> np.ndarray:
    found = np.zeros(len(keys), bool)
    own = np.mod(keys[:, 0], shards)
    for shard, table in tables.items():
        ask = own == shard
        found[ask] = CuckooFilter(0, table).has(keys[ask, 0], keys[ask, 1])
    return found


def _drop(texts: list, shipped, min_chars: int) -> dict:
    exact, tables, shards = shipped.value
    split = [line_keys(b"" if t is None else t.encode("utf-8", "surrogatepass"), min_chars) for t in texts]
    gone = np.zeros(0, bool)
    if split:
        keys, held = np.concatenate([s[1] for s in split]), np.concatenate([s[2] for s in split])
        gone = held & _in_filters(keys, tables, shards)
        at = np.flatnonzero(gone)
        asked = _exact(keys[at, 0], keys[at, 1])
        place = np.searchsorted(exact, asked)
        gone[at] = (place < len(exact)) & (exact[np.minimum(place, max(0, len(exact) - 1))] == asked) if len(exact) else False
    out, n_lines, n_dropped, first = [], [], [], 0
    for text, (lines, _, _) in zip(texts, split, strict=True):
        g = gone[first : first + len(lines)]
        first += len(lines)
        n_lines.append(len(lines))
        n_dropped.append(int(g.sum()))
        out.append(b"\n".join([x for x, y in zip(lines, g, strict=True) if not y]).decode("utf-8", "surrogatepass") if n_dropped[-1] else text)
    return {"text": out, "n_lines": n_lines, "n_dropped": n_dropped}


def _probe(texts: list, shipped, min_chars: int, names: list[str]) -> dict:
    """A text's digest, and those of its keys that may be frequent."""
    ids, keys = [], []
    for t in texts:
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        _, k, held = line_keys(raw, min_chars)
        ids.append(xxhash.xxh3_128_digest(raw))
        k = k[held]
        if shipped is not None and len(k):
            k = k[_in_filters(k, *shipped.value)]
        keys.append([{"k1": int(a), "k2": int(b)} for a, b in k])
    return dict(zip(names, (ids, keys), strict=True))


def _drop_joined(parts: Iterator[pd.DataFrame], names: list[str], gone_name: str, min_chars: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(pdf["text"], pdf[gone_name], strict=True):
            lines, keys, held = line_keys(b"" if text is None else text.encode("utf-8", "surrogatepass"), min_chars)
            frequent = {(int(g["k1"]), int(g["k2"])) for g in (gone if gone is not None else [])}
            keep = [x for x, (a, b), h in zip(lines, keys.tolist(), held, strict=True) if not (h and (a, b) in frequent)]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(keep))
            texts.append(b"\n".join(keep).decode("utf-8", "surrogatepass") if n_dropped[-1] else text)
        yield pdf[names].assign(text=texts, n_lines=n_lines, n_dropped=n_dropped)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index ``docs`` and apply the index to them."""
    return LineIndex.build(docs, min_docs, min_chars).apply(spread(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents leave every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op7_line_dedup": r"""
with lines as (
  select doc_id, u.line as line, u.pos as pos from (
    select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) as u from documents)),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
}
