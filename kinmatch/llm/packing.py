"""Bounded-space online packing of tokenised documents into windows of fixed length.

Each partition keeps ``open_windows`` windows open. A piece goes to the window that it
leaves the least room in; when none has room, the fullest window is filled by a cut (if its
room is at least ``min_cut`` ids) and emitted. Whole windows' worth of a long document are
emitted at once. The windows left open at the end travel with their ids and are packed again by
groups of FAN_IN partitions, round after round, until one group is left; its last window is
cut at powers of two, which need no padding.

Defined cases: a null or empty text is one end id; a null doc_id is packed as null; repeated
rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import tokens
from kinmatch.storage import ensure_workers, materialise, spread

WINDOW, OPEN_WINDOWS, MIN_CUT = 2048, 32, 8
#: Partitions whose leftovers one task of a merging round packs.
FAN_IN = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """Open windows of one partition. A piece: (doc_id, start, doc_tokens, ids as u32 bytes)."""

    def __init__(self, window: int, open_windows: int, min_cut: int):
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.room: list[tuple[int, int]] = []  # (ids of room, key), ascending
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def _emit(self, key: int) -> list[tuple]:
        return self.held.pop(key)

    def add(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> Iterator[list[tuple]]:
        """Place one run of ids; yields the windows that it completes."""
        whole = 4 * self.window
        at = 0
        while len(ids) - at >= whole:
            yield [(doc_id, start + at // 4, doc_tokens, ids[at : at + whole])]
            at += whole
        while at < len(ids):
            n = (len(ids) - at) // 4
            k = bisect_left(self.room, (n, -1))
            if k == len(self.room) and len(self.room) >= self.most:
                room, key = self.room.pop(0)  # the fullest
                if room >= self.min_cut:
                    self.held[key].append((doc_id, start + at // 4, doc_tokens, ids[at : at + 4 * room]))
                    at += 4 * room
                yield self._emit(key)
                continue
            if k < len(self.room):
                room, key = self.room.pop(k)
            else:
                room, key = self.window, self.opened
                self.opened += 1
                self.held[key] = []
            self.held[key].append((doc_id, start + at // 4, doc_tokens, ids[at:]))
            at = len(ids)
            if room == n:
                yield self._emit(key)
            else:
                insort(self.room, (room - n, key))

    def rest(self) -> Iterator[list[tuple]]:
        """The windows still open, fullest first."""
        for _, key in self.room:
            yield self.held[key]
        self.room, self.held = [], {}


def stream(windows: Iterator[list[tuple]], window: int) -> Iterator[list[tuple]]:
    """Join windows end to end and cut at ``window`` ids; the last one is cut at powers of two."""
    pieces, used = [], 0
    for doc_id, start, doc_tokens, ids in (p for w in windows for p in w):
        while ids:
            part = ids[: 4 * (window - used)]
            pieces.append((doc_id, start, doc_tokens, part))
            start, ids, used = start + len(part) // 4, ids[len(part) :], used + len(part) // 4
            if used == window:
                yield pieces
                pieces, used = [], 0
    while used:
        take, size = [], 1 << (used.bit_length() - 1)
        room = size
        while room:
            doc_id, start, doc_tokens, ids = pieces.pop(0)
            part = ids[: 4 * room]
            take.append((doc_id, start, doc_tokens, part))
            room -= len(part) // 4
            if len(part) < len(ids):
                pieces.insert(0, (doc_id, start + len(part) // 4, doc_tokens, ids[len(part) :]))
        used -= size
        yield take


def _rows(windows: Iterator[list[tuple]], first: int, part: int, keep: bool) -> Iterator[tuple]:
    """Rows of windows with consecutive sequence ids; ``keep``: leftovers, whose ids go on with them."""
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, -1 if keep else first + n, offset, part, ids if keep else None
            offset += len(ids) // 4


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(docs: DataFrame, tokenizer: str = tokens.TOKENIZER_FILE, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ensure_workers(spark)

    def first_round(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, enc, packer, n = TaskContext.get().partitionId(), tokens.encoder(tokenizer), Packer(window, open_windows, min_cut), 0
        for pdf in parts:
            done = []
            for doc_id, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                ids = enc.encode(text)
                done += packer.add(None if pd.isna(doc_id) else int(doc_id), 0, len(ids) // 4, ids)
            yield _table(list(_rows(iter(done), (part << 32) + n, part, False)))
            n += len(done)
        enc.forget()
        yield _table(list(_rows(packer.rest(), 0, part, True)))

    def merge_round(level: int, last: bool):
        def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer, n, group = Packer(window, open_windows, min_cut), 0, None
            for pdf in parts:
                done = []
                for r in pdf.itertuples(index=False):
                    group = int(r.grp)
                    done += packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), int(r.doc_tokens), r.ids)
                if group is not None:
                    yield _table(list(_rows(iter(done), (level << 56) + (group << 32) + n, group, False)))
                n += len(done)
            if group is not None:
                left = packer.rest()
                yield _table(list(_rows(stream(left, window), (level << 56) + (group << 32) + n, group, False) if last else _rows(left, 0, group, True)))

        return merge

    out = materialise(spread(docs.select("doc_id", "text")).mapInPandas(first_round, SCHEMA), "pieces")
    results, level = [out.where("sequence_id >= 0")], 0
    while True:
        left = out.where("sequence_id < 0")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        groups = parts // FAN_IN + 1
        left = left.withColumn("grp", F.floor(F.col("part") / FAN_IN))
        # Groups go to partitions by range, so that each task holds one group's bounded leftovers.
        left = left.repartitionByRange(groups, "grp").sortWithinPartitions("grp", "part", "doc_id", "start") if groups > 1 else left.coalesce(1).sortWithinPartitions("part", "doc_id", "start")
        out = materialise(left.mapInPandas(merge_round(level, groups == 1), SCHEMA), "pieces")
        results.append(out.where("sequence_id >= 0"))
        if groups == 1:
            break
    whole = results[0]
    for more in results[1:]:
        whole = whole.union(more)
    return whole.drop("part", "ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2,048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
