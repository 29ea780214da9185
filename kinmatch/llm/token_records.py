"""Token ids as length-delimited, checksummed binary records with a separate offset index.

Record: u64 payload length, u32 masked checksum of those 8 bytes, payload, u32 masked
checksum of the payload. Payload: i64 doc_id, u8 null flag, u8 bytes an id (2 or 4),
u64 number of ids, ids; all little-endian. Checksum: CRC-32 rotated right by 15 bits plus
0xA282EAD8, so that a checksum stored inside checked data does not weaken it. Index: for each
record u64 offset and u64 bytes, so a reader can fetch records in any order.

Defined cases: a null or empty text is the single end id; a null doc_id sorts first and
reads back as null; repeated ids keep one record for each row, ordered by text; a text of any length is
one record, encoded at once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import tokens
from kinmatch.storage import ensure_workers, materialise, new_path

HEAD, PAYLOAD, FOOT, ENTRY = struct.Struct("<QI"), struct.Struct("<qBBQ"), struct.Struct("<I"), struct.Struct("<QQ")
MANIFEST = "shard long, records_file string, index_file string, n_records long, n_tokens long, n_file_bytes long"
#: Bytes read from a shard at once.
READ_BYTES = 1 << 22
#: Bytes of text that a shard is made for.
SHARD_BYTES = 256 << 20


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop's names of S3 are Arrow's s3."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def masked_crc(data: bytes) -> int:
    """CRC-32 of ``data``, rotated and shifted."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One framed record."""
    size = struct.pack("<Q", len(payload))
    return size + FOOT.pack(masked_crc(size)) + payload + FOOT.pack(masked_crc(payload))


def index_entry(offset: int, record: bytes) -> bytes:
    """Where a record starts and how many bytes it has."""
    return ENTRY.pack(offset, len(record))


def pack_ids(doc_id: int | None, ids: bytes) -> bytes:
    """Payload of a document; ``ids`` are little-endian u32 bytes, stored in two bytes each where they fit."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return PAYLOAD.pack(doc_id or 0, doc_id is None, width, len(wide)) + wide.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and its ids as little-endian u32 bytes."""
    doc_id, null, width, n = PAYLOAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", n, PAYLOAD.size).astype("<u4").tobytes()


def unframe(record: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one starts; raises if a checksum differs."""
    size, check = HEAD.unpack_from(record, at)
    if masked_crc(bytes(record[at : at + 8])) != check:
        raise ValueError(f"length checksum differs at {at}")
    begin = at + HEAD.size
    payload = bytes(record[begin : begin + size])
    if masked_crc(payload) != FOOT.unpack_from(record, begin + size)[0]:
        raise ValueError(f"payload checksum differs at {at}")
    return payload, begin + size + FOOT.size


def write_records(docs: DataFrame, tokenizer: str = tokens.TOKENIZER_FILE, shards: int | None = None) -> DataFrame:
    """Write one shard for each range of doc_id; returns the manifest, a row for each shard.

    Shards are as many as the session's shuffle partitions, or more where the texts fill more. A task writes under a name of its own, and only the names that successful tasks return
    are in the manifest, so retried and speculative tasks leave nothing behind that is read.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    if shards is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = new_path(spark, "records")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, enc = TaskContext.get().partitionId(), tokens.encoder(tokenizer)
        store, root = _located(folder)
        store.create_dir(root)
        own = uuid.uuid4().hex[:8]
        names = [f"{folder}/shard-{shard:06d}-{own}.{x}" for x in ("records", "index")]
        n, total, at, files = 0, 0, 0, []
        for pdf in parts:
            if not files:
                files = [store.open_output_stream(_located(x)[1]) for x in names]
            out, index = [], []
            for doc_id, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                ids = enc.encode(text)
                out.append(record := frame(pack_ids(None if pd.isna(doc_id) else int(doc_id), ids)))
                index.append(index_entry(at, record))
                at += len(record)
                n += 1
                total += len(ids) // 4
            files[0].write(b"".join(out))
            files[1].write(b"".join(index))
        enc.forget()
        for f in files:
            f.close()
        if n:
            yield pd.DataFrame([[shard, *names, n, total, at]], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select("doc_id", "text").repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return materialise(rows.mapInPandas(write, MANIFEST), "manifest")


def scan_shard(records_file: str) -> Iterator[tuple[int | None, bytes]]:
    """Every (doc_id, ids) of a shard in order, verified, a few megabytes at a time."""
    store, path = _located(records_file)
    with store.open_input_stream(path) as f:
        held = b""
        while more := f.read(READ_BYTES):
            held += more
            at = 0
            while len(held) - at >= HEAD.size and len(held) - at >= HEAD.size + HEAD.unpack_from(held, at)[0] + FOOT.size:
                payload, at = unframe(memoryview(held), at)
                yield unpack_ids(payload)
            held = held[at:]
        if held:
            raise ValueError(f"{records_file} ends inside a record")


def read_shuffled(records_file: str, index_file: str, seed: int) -> Iterator[tuple[int | None, bytes]]:
    """The shard's records in a seeded random order, each fetched through the offset index."""
    store, path = _located(index_file)
    with store.open_input_stream(path) as f:
        entries = list(ENTRY.iter_unpack(f.read()))
    random.Random(seed).shuffle(entries)
    store, path = _located(records_file)
    with store.open_input_file(path) as f:
        for offset, size in entries:
            yield unpack_ids(unframe(f.read_at(size, offset))[0])


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read back from the files.

    What comes to the driver is the manifest, a row for each shard.
    """
    ensure_workers(spark)
    shards = sorted(tuple(r) for r in manifest.select("shard", "records_file", "n_tokens").collect())
    base = np.concatenate(([0], np.cumsum([s[2] for s in shards]))).astype(int).tolist()
    files = [s[1] for s in shards]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in pdf["id"]:
                at, rows = base[k], []
                for doc_id, ids in scan_shard(files[k]):
                    rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                    at += len(ids) // 4
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write records and index in doc_id order, and read the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(spark, write_records(docs))
