"""Removal of repeated byte strings by suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes over it also starts earlier. Sorting every suffix of a corpus costs
many times its size, so the corpus is first reduced without loss: of every window of LENGTH bytes the
smallest hash of ANCHOR bytes is its anchor, which depends on the window alone, and consecutive windows with one
anchor are a run. Windows can only be equal if their anchors are. Runs whose anchor occurs once
are done; runs equal as a whole to an earlier one are repeats; what remains are the first runs
of anchors that occur in several contexts. Their text is suffix-sorted:

1. positions are sampled by the difference cover {1, 2} modulo 3, and triples of symbols of eight bytes
   at them are sorted and named in order, by their bytes;
2. triples of those names are sorted and named again, which orders sampled suffixes by 72 bytes; a name of the
   first kind behind it and the last bytes make LENGTH, so the recursion ends there;
3. all suffixes are merged by the few bytes before the cover and the names behind them, as any two
   positions have a common shift into the cover;
4. neighbours with equal prefixes form a group, whose first start stays while the others are repeats.

Segments are worked on in packs. Every order is made by one shuffle of its keys, to ranges whose bounds come of a
sample, and names go back to their packs in arrays. A key that fills whole ranges is dealt over them, so a passage
that a third of the corpus holds is no hot key there.

Defined cases: a null text has no bytes and an empty one is like it; rows that repeat an id and text are
one document; texts under one id are ordered by hash; a null doc_id comes last; texts under LENGTH bytes
lose nothing; long texts are worked on in overlapping pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm.textkit import BYTE_CODE, U64, _power, as_bytes, mix
from kinmatch.storage import discard, ensure_workers, materialise, restrict, spread

LENGTH, ANCHOR = 100, 32
#: Windows that a long text is looked at at once, and bytes of short ones; positions take 21 bits.
PASS_WINDOWS = PASS_BYTES = 1 << 20
LAST = 2**63 - 1
#: Windows of a block, by their distance to the anchor; bytes of a symbol; bytes behind the names.
BLOCK, SYMBOL, TAIL = 8, 8, 4
#: Bytes that names of the first and of the second kind stand for.
TRIPLE, NINE = 3 * SYMBOL, 9 * SYMBOL
#: Bytes of segments that are worked on at once, and windows of one piece of a long segment.
PACK_BYTES, PIECE = 1 << 19, 1 << 18
#: Bits of a key's place in its pack, and of its rank in its range; names that are held before they go back to their packs.
PLACE_BITS, RANK_BITS, NAMES_HELD = 24, 40, 1 << 20
#: Most ranges of an order; keys sampled for each; packs that the sample is taken of, if there are as many.
RANGES, SAMPLE, SAMPLED_PACKS = 1 << 14, 16, 24
KEY = "x long, y long, z long"


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number, first byte, bytes) of the texts, long ones in overlapping pieces, in groups of PASS_BYTES."""
    group, size = [], 0
    for k, raw in enumerate(texts):
        for at in range(0, max(0, len(raw) - LENGTH + 1), PASS_WINDOWS):
            piece = raw[at : at + PASS_WINDOWS + LENGTH - 1]
            if group and size + len(piece) > PASS_BYTES:
                yield group
                group, size = [], 0
            group.append((k, at, piece))
            size += len(piece)
    if group:
        yield group


def spans_of(texts: list[bytes], block: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans of windows with equal anchor: (text, key, hash of the span's text, first window, number of windows).

    Without ``block`` the key is the anchor's hash. With it, spans also end where the distance to the anchor
    enters another block of that many windows, and the key is the hash of the bytes that all windows of
    the whole block share, wherever the span is cut off.
    """
    for group in _groups(texts):
        sizes = np.array([len(p) for _, _, p in group])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        a = np.frombuffer(b"".join([p for _, _, p in group]), np.uint8)
        n, up, down = len(a), _power(len(a) + 1, False), _power(len(a) + 1, True)
        total = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[a] * up[:n], out=total[1:])
        grams = n - ANCHOR + 1
        h = mix((total[ANCHOR:] - total[:grams]) * down[:grams])
        low = (h & ~U64((1 << 21) - 1)) | np.arange(grams, dtype=U64)
        width, span = LENGTH - ANCHOR + 1, 1
        while span * 2 <= width:
            low, span = np.minimum(low[: len(low) - span], low[span:]), span * 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        anchor = (low & U64((1 << 21) - 1)).astype(np.int64)
        inside = np.ones(n + 1, np.int8)  # windows that end in their text
        windows = sizes - LENGTH + 1
        for b, w, s in zip(begins.tolist(), windows.tolist(), sizes.tolist(), strict=True):
            inside[b + w : b + s] = 0
        at = np.flatnonzero(inside[: len(anchor)])
        where = anchor[at]
        cut = where[1:] != where[:-1]
        cut |= at[1:] != at[:-1] + 1
        if block:
            q = (where - at) // block
            cut |= q[1:] != q[:-1]
        first = np.flatnonzero(np.concatenate(([True], cut)))
        count = np.diff(np.concatenate((first, [len(at)])))
        start, m = at[first], where[first]
        key = h[m]
        if block:
            q = q[first]
            begin, end = m - q * block, m - q * block - block + 1 + LENGTH
            key = mix(mix((total[end] - total[begin]) * down[begin]) ^ mix(q.astype(U64) + U64(7)) ^ key)
        whole = (total[start + count + LENGTH - 1] - total[start]) * down[start]
        whole = mix(whole ^ mix((count * 256 + (m - start)).astype(U64)))
        owner = np.searchsorted(begins, start, "right") - 1
        text, offset = np.array([k for k, _, _ in group]), np.array([o for _, o, _ in group])
        yield text[owner], key.astype(np.int64), whole.astype(np.int64), start - begins[owner] + offset[owner], count


# Spans of windows are (doc, first window, number of windows); ``at`` holds first << 24 | number.


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        raw = as_bytes(pdf["text"])
        d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in raw]), "<i8").reshape(-1, 2)
        yield pdf[["doc_id", "mark"]].assign(d1=d[:, 0], d2=d[:, 1], n_bytes=[len(x) for x in raw])


SPANS = "key long, whole long, doc long, at long, known boolean"


def _span_rows(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """Spans of one pass; all but the first of equal ones are known to be repeats, and get keys of their own."""
    import pyarrow as pa

    known = np.zeros(len(key), bool)
    order = np.argsort(whole)
    same = ~_starts(whole[order])
    some = order[same | np.append(same[1:], False)]
    some = some[np.lexsort((at[some], doc[some], whole[some], key[some]))]
    known[some] = ~_starts(key[some], whole[some])
    key = np.where(known, mix(mix(doc.astype(U64)) ^ at.astype(U64)).view(np.int64), key)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, whole, doc, at, known)], names=["key", "whole", "doc", "at", "known"])


def _run_rows(parts):
    for batch in parts:
        docs = batch.column("doc").to_numpy()
        for text, key, whole, first, n in spans_of(as_bytes(batch.column("text").to_pylist())):
            yield _span_rows(key, whole, docs[text], first << 24 | n)


def _segments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of adjoining spans of windows, with the LENGTH - 1 bytes behind them."""
    for pdf in parts:
        rows = []
        for doc, spans, raw in zip(pdf["doc"], pdf["spans"], pdf["bytes"], strict=True):
            for first, n in _joined(spans):
                rows.append((doc, first, n, bytes(raw[first : first + n + LENGTH - 1])))
        yield pd.DataFrame(rows, columns=["doc", "first", "n", "bytes"])


def _joined(spans) -> list[tuple[int, int]]:
    """Adjoining and overlapping spans of windows as one."""
    out: list[list[int]] = []
    for at in sorted(int(x) for x in spans):
        first, n = at >> 24, at & 0xFFFFFF
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n - out[-1][0])
        else:
            out.append([first, n])
    return [(a, b) for a, b in out]


def _block_rows(parts):
    for batch in parts:
        docs, base = batch.column("doc").to_numpy(), batch.column("first").to_numpy()
        for text, key, whole, first, n in spans_of(batch.column("bytes").to_pylist(), BLOCK):
            yield _span_rows(key, whole, docs[text], (base[text] + first) << 24 | n)


def _judge(rows: DataFrame, name: str) -> DataFrame:
    """Of spans of windows with a key and a hash of the whole: ``again`` if an equal one comes earlier; first
    ones of keys that have several wholes are open, and all others are left out. Of what a pass found equal only the
    first comes under its key, so a passage of many documents is met there once for each pass and not for each document."""
    of_key, of_whole = Window.partitionBy("key", "known"), Window.partitionBy("key", "known", "whole").orderBy("doc", "at")
    marked = rows.repartition("key").withColumn("nth", F.row_number().over(of_whole))
    marked = marked.withColumn("x", F.min("whole").over(of_key)).withColumn("y", F.max("whole").over(of_key))
    return materialise(marked.where("known or nth > 1 or x <> y").select("doc", "at", F.expr("known or nth > 1").alias("again")), name)


def _cut(open_spans: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Segments of the texts (doc, bytes, base) at open spans."""
    spans = open_spans.groupBy("doc").agg(F.collect_list("at").alias("spans"))
    return materialise(spans.join(texts, "doc").mapInPandas(_segments, "doc long, first long, n long, bytes binary"), name)


def _numbered_from(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """0 .. size-1 of every segment in one row: (segment, number, where each segment begins)."""
    begins = np.concatenate(([0], np.cumsum(sizes)))
    segment = np.repeat(np.arange(len(sizes)), sizes)
    return segment, np.arange(begins[-1]) - begins[segment], begins


def _sampled(first: np.ndarray, n: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) in the cover {1, 2} modulo 3 of the segments' windows, and up to ``reach`` triples behind, in order."""
    segment, place, _ = _numbered_from(n + 2 + reach * TRIPLE)
    kept = np.zeros(len(place), bool)
    for k in range(reach + 1):
        kept |= (place >= k * TRIPLE) & (place < n[segment] + 2 + k * TRIPLE)
    kept &= (place + first[segment]) % 3 != 0
    return segment[kept], place[kept]


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in rows of about PACK_BYTES: (doc, first, n) of each one after the other, and all bytes. Long ones come in overlapping pieces."""
    rows, size = [], 0
    for pdf in parts:
        for doc, first, n, raw in zip(pdf["doc"], pdf["first"], pdf["n"], pdf["bytes"], strict=True):
            for at in range(0, n, PIECE):
                m = min(PIECE, n - at)
                rows.append((doc, first + at, m, bytes(raw[at : at + m + LENGTH - 1])))
                size += m + LENGTH - 1
                if size >= PACK_BYTES:
                    yield _pack(rows)
                    rows, size = [], 0
    if rows:
        yield _pack(rows)


PACKED = "segments binary, bytes binary"


def _pack(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"segments": [np.array([r[:3] for r in rows], np.int64).tobytes()], "bytes": [b"".join([r[3] for r in rows])]})


#: A key is three numbers whose order is that of the bytes they stand for; then come its row's other columns.
Columns = tuple[np.ndarray, ...]


def _segments_of(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, first, n of a pack's segments, and where each begins in the bytes."""
    doc, first, n = np.frombuffer(pack["segments"], np.int64).reshape(-1, 3).T
    return doc, first, n, np.concatenate(([0], np.cumsum(n + LENGTH - 1)))


def _where(pack: dict, n: int) -> np.ndarray:
    return pack["pack"] << PLACE_BITS | np.arange(n)


def _triples(pack: dict) -> Columns:
    """Three symbols at every sampled place."""
    _, first, n, begins = _segments_of(pack)
    raw = pack["bytes"]
    symbol = np.empty(len(raw) - SYMBOL + 1, U64)
    for k in range(SYMBOL):
        symbol[k::SYMBOL] = np.frombuffer(raw, ">u8", (len(raw) - k) // SYMBOL, k)
    symbol = (symbol ^ U64(1 << 63)).view(np.int64)
    segment, place = _sampled(first, n, 3)
    at = begins[segment] + place
    return *(symbol[at + k * SYMBOL] for k in range(3)), _where(pack, len(at))


def _named(pack: dict) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first kind at the places of all segments laid end to end, and where each segment begins."""
    _, first, n, _ = _segments_of(pack)
    segment, place = _sampled(first, n, 3)
    row = np.concatenate(([0], np.cumsum(n + 2 + NINE)))
    name = np.zeros(row[-1], np.int64)
    name[row[segment] + place] = np.frombuffer(pack["names"], np.int64)
    return name, row


def _nines(pack: dict) -> Columns:
    """Three names at every sampled place that begins a window's part in the cover."""
    name, row = _named(pack)
    _, first, n, _ = _segments_of(pack)
    segment, place = _sampled(first, n)
    at = row[segment] + place
    return *(name[at + k * TRIPLE] for k in range(3)), _where(pack, len(at))


FORMS = ((0, 1), (0, 2), (1, 2))  # residues that a form of key compares
SHIFT = {(0, 1): 1, (0, 2): 2, (1, 2): 0}  # from a window into the cover, in each form


def _suffixes(pack: dict) -> Columns:
    """Keys of all windows in the forms of their residue: two names, bytes before the cover and last bytes; doc, window."""
    doc, first, n, begins = _segments_of(pack)
    a = np.frombuffer(pack["bytes"], np.uint8).astype(np.int64)
    name, row = _named(pack)
    nine = np.zeros(row[-1], np.int64)
    segment, place = _sampled(first, n)
    nine[row[segment] + place] = np.frombuffer(pack["nines"], np.int64)
    segment, i, _ = _numbered_from(n)
    byte, window = begins[segment] + i, first[segment] + i
    tail = sum(a[byte + LENGTH - TAIL + k] << (8 * (TAIL - 1 - k)) for k in range(TAIL))
    out = []
    for form, residues in enumerate(FORMS):
        at = np.flatnonzero(np.isin(window % 3, residues))
        o = SHIFT[residues]
        head = sum((a[byte[at] + k] << (8 * (o - 1 - k)) for k in range(o)), np.zeros(len(at), np.int64))
        to = row[segment[at]] + i[at] + o
        # Form, head and tail are one number; names compare NINE + TRIPLE bytes behind the head.
        out.append((nine[to], name[to + NINE], form << 48 | head << 32 | tail[at], doc[segment[at]], window[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Ranges:
    """Ranges of the order of keys, about equal in rows, by a sample of the keys.

    A key that fills whole ranges has them for itself: its rows are dealt over them, and ``home`` is the first of them.
    """

    def __init__(self, sample: np.ndarray, n: int):
        order = np.lexsort((sample[:, 2], sample[:, 1], sample[:, 0]))
        self.bounds = sample[order[np.arange(1, n) * len(sample) // n]] if len(sample) else sample
        self.text = self._text(*self.bounds.T)
        own = np.concatenate(([False], self.text[1:] == self.text[:-1], [False]))
        self.own = own[: len(self.bounds) + 1]  # range k ends with bound k
        self.home = np.arange(len(self.own))
        for k in range(1, len(self.own)):
            if self.own[k] and self.own[k - 1] and self.text[k] == self.text[k - 1]:
                self.home[k] = self.home[k - 1]

    @staticmethod
    def _text(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Keys as bytes in the same order."""
        return (np.stack((x, y, z), axis=1).view(U64) ^ U64(1 << 63)).astype(">u8").view("S24").ravel()

    def of(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        first = np.ascontiguousarray(self.bounds[:, 0])
        out, end = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        close = np.flatnonzero(out < end)
        text = self._text(x[close], y[close], z[close])
        low, high = np.searchsorted(self.text, text, "left"), np.searchsorted(self.text, text, "right")
        out[close] = low + np.where(high - low > 1, 1 + close % np.maximum(high - low - 1, 1), 0)
        return out.astype(np.int32)


def _arrays(batch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]


def _dealt(packs: DataFrame, make: Callable[[dict], Columns], rest: str) -> tuple[DataFrame, Ranges]:
    """Rows (range, x, y, z, ``rest``) that ``make`` has for the packs, all of a range in one task, one range after the other."""
    import pyarrow as pa

    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(RANGES, 4 * tasks)
    count, size = packs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(1))).first()
    every = max(1, count // SAMPLED_PACKS)
    share = SAMPLE * n * every / size

    def sample(parts):
        for batch in parts:
            for pack in batch.to_pylist():
                key = np.stack(make(pack)[:3], axis=1)
                k = np.random.default_rng(pack["pack"]).integers(0, len(key), math.ceil(share * len(pack["bytes"])))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(key[k].T)], names=["x", "y", "z"])

    some = packs.where(F.pmod(F.xxhash64("pack"), F.lit(every)) == 0).mapInArrow(sample, KEY).toArrow()
    ranges = Ranges(np.stack([some.column(c).to_numpy().astype(np.int64) for c in "xyz"], axis=1), n)
    schema = f"range int, {KEY}, {rest}"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(parts):
        for batch in parts:
            for pack in batch.to_pylist():
                made = make(pack)
                made = [ranges.of(*made[:3]), *made]
                for k in range(0, len(made[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k : k + 50_000])) for x in made], names=names)

    return packs.mapInArrow(rows, schema).repartition(tasks, "range").sortWithinPartitions("range"), ranges


def _by_range(parts) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of every range, without its number."""
    held, now = [], -1
    for batch in parts:
        number, *columns = _arrays(batch)
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and number[a] != now:
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = int(number[a])
            held.append([x[a:b] for x in columns])
    if held:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Rows of sorted columns that differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _with_names(packs: DataFrame, make: Callable[[dict], Columns], column: str) -> DataFrame:
    """Sort the keys of the packs and name them by their places in the order; ``column`` has the names of a pack's keys."""
    import pyarrow as pa

    dealt, ranges = _dealt(packs, make, "place long")

    def pieces(held: list[Columns]):
        place, name = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(place)
        place, name = place[order], name[order]
        pack, k = place >> PLACE_BITS, (place & ((1 << PLACE_BITS) - 1)).astype(np.int32)
        cuts = [*np.flatnonzero(_starts(pack)).tolist(), len(pack)]
        cuts = list(zip(cuts, cuts[1:], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array(pack[[a for a, _ in cuts]]), pa.array([k[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([name[a:b].tobytes() for a, b in cuts], pa.binary())], names=["pack", "k", "name"])

    def named(parts):
        held, size = [], 0
        for number, (x, y, z, place) in _by_range(parts):
            order = np.lexsort((z, y, x))
            name = np.cumsum(_starts(x[order], y[order], z[order])) - 1
            held.append((place[order], int(ranges.home[number]) << RANK_BITS | name))
            size += len(order)
            if size > NAMES_HELD:
                yield from pieces(held)
                held, size = [], 0
        if held:
            yield from pieces(held)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            whole = []
            for some in pdf["pieces"]:
                k, name = (np.frombuffer(b"".join([bytes(p[c]) for p in some]), kind) for c, kind in (("k", np.int32), ("name", np.int64)))
                out = np.empty(len(k), np.int64)
                out[k] = name
                whole.append(out.tobytes())
            yield pdf.drop(columns="pieces").assign(**{column: whole})

    of = dealt.mapInArrow(named, "pack long, k binary, name binary").groupBy("pack").agg(F.collect_list(F.struct("k", "name")).alias("pieces"))
    kept = ", ".join(f"{c} {t}" for c, t in packs.dtypes)
    return materialise(packs.join(of, "pack").mapInPandas(put, f"{kept}, {column} binary".replace("bigint", "long")), column)


def sorted_repeats(segments: DataFrame) -> DataFrame:
    """(doc, at) of windows of ``segments`` (doc, first, n, bytes) that start again later, by suffix sorting."""
    return _sorted(segments.mapInPandas(_packed, PACKED))


def _sorted(packs: DataFrame) -> DataFrame:
    number = F.shiftleft(F.spark_partition_id().cast("long"), 18) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    packs = materialise(packs.select(number.alias("pack"), "segments", "bytes"), "packs")
    ones = _with_names(packs, _triples, "names")
    discard(packs)
    twos = _with_names(ones, _nines, "nines")
    discard(ones)
    dealt, ranges = _dealt(twos, _suffixes, "doc long, window long")

    def repeats(parts):
        """Windows whose neighbour before them in the order has the same prefix; of ranges that one key has for itself also the first."""
        import pyarrow as pa

        for number, (x, y, z, doc, window) in _by_range(parts):
            order = np.lexsort((window, doc, z, y, x))
            same = ~_starts(x[order], y[order], z[order])
            home = np.full(len(order), -1)
            if ranges.own[number]:
                home[~same], same[:] = ranges.home[number], True
            at = order[same]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(window[at] << 24 | 1), pa.array(home[same])], names=["doc", "at", "home"])

    found = materialise(dealt.mapInArrow(repeats, "doc long, at long, home long"), "repeats")
    discard(twos)
    firsts = found.where("home >= 0").withColumn("nth", F.row_number().over(Window.partitionBy("home").orderBy("doc", "at")))
    return found.where("home < 0").select("doc", "at").union(firsts.where("nth > 1").select("doc", "at"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, text), doc in the order of ids, and rows (doc_id, doc, d1, d2, n_bytes)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sized = materialise(spread(texts).mapInPandas(_digests, "doc_id long, mark long, d1 long, d2 long, n_bytes long"), "sizes")
    key = F.coalesce("doc_id", F.lit(LAST))
    if not sized.groupBy(key).agg(F.countDistinct("mark").alias("n")).where("n > 1").limit(1).count():
        return texts.select(key.alias("doc"), "text"), sized.withColumn("doc", key)
    order = sized.select(key.alias("key"), "mark").distinct().repartitionByRange("key", "mark").sortWithinPartitions("key", "mark")
    order = materialise(order.select("key", "mark", F.monotonically_increasing_id().alias("doc")), "order")
    put = lambda t: t.withColumn("key", key).join(order, ["key", "mark"]).drop("key")
    return put(texts).select("doc", "text"), put(sized)


def _kept(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        kept, removed = [], []
        for spans, text in zip(pdf["spans"], as_bytes(pdf["text"]), strict=True):
            out, at, gone = [], 0, []
            for first, n in _joined_bytes(spans):
                out.append(text[at:first])
                at = first + n
                gone.append({"start": first, "length": n})
            kept.append(b"".join([*out, text[at:]]))
            removed.append(gone)
        yield pd.DataFrame({"doc": pdf["doc"], "kept": kept, "removed": removed})


def _joined_bytes(spans) -> list[tuple[int, int]]:
    """Runs of bytes that spans of windows cover."""
    out: list[list[int]] = []
    for at in sorted(int(x) for x in spans):
        first, end = at >> 24, (at >> 24) + (at & 0xFFFFFF) + LENGTH - 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b - a) for a, b in out]


RESULT = "doc long, kept binary, removed array<struct<start:bigint,length:bigint>>"


def dedup_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc, n_bytes, copy: all of it is gone) and texts (doc, kept, removed spans of bytes)."""
    spark = docs.sparkSession
    ensure_workers(spark)
    texts, sized = _numbered(docs)
    rep = sized.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    rows = sized.join(rep, ["d1", "d2"]).select("doc_id", "doc", "n_bytes", ((F.col("doc") != F.col("rep")) & (F.col("n_bytes") >= LENGTH)).alias("copy"), (F.col("doc") != F.col("rep")).alias("other"))
    rows = materialise(rows, "rows")
    copies = rows.where("copy").select("doc").distinct()
    own = restrict(texts, copies, "doc", "left_anti")
    if rows.where("not copy").groupBy("doc").count().where("count > 1").limit(1).count():
        own = materialise(own.dropDuplicates(["doc"]), "own")  # else a document would be its own copy

    runs = _judge(spread(own).mapInArrow(_run_rows, SPANS), "runs")
    open_runs = runs.where("not again")
    cut_from = restrict(own, open_runs.select("doc").distinct(), "doc").select("doc", F.col("text").cast("binary").alias("bytes"))
    segments = _cut(open_runs, cut_from, "segments")
    blocks = _judge(segments.mapInArrow(_block_rows, SPANS), "blocks")
    sorted_ = _sorted(_narrow(blocks.where("not again"), segments))
    discard(segments)

    again = runs.where("again").select("doc", "at").union(blocks.where("again").select("doc", "at")).union(sorted_)
    spans = materialise(again.groupBy("doc").agg(F.collect_list("at").alias("spans")), "spans")
    ids = spans.select("doc")
    cut = restrict(own, ids, "doc").join(spans, "doc").mapInPandas(_kept, RESULT)
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    whole = restrict(own, ids, "doc", "left_anti").select("doc", F.col("text").cast("binary").alias("kept"), none.alias("removed"))
    return rows.drop("other"), cut.union(whole)


def _narrow(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Packs of the segments of open blocks, cut from the segments they came of; one Python worker does both."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, spans_, pieces in zip(pdf["doc"], pdf["spans"], pdf["pieces"], strict=True):
                pieces = sorted((int(p["first"]), int(p["n"]), bytes(p["bytes"])) for p in pieces)
                k = 0
                for first, n in _joined(spans_):
                    while pieces[k][0] + pieces[k][1] <= first:
                        k += 1
                    at = first - pieces[k][0]
                    rows.append((doc, first, n, pieces[k][2][at : at + n + LENGTH - 1]))
            yield pd.DataFrame(rows, columns=["doc", "first", "n", "bytes"])

    of = spans.groupBy("doc").agg(F.collect_list("at").alias("spans"))
    pieces = segments.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "bytes")).alias("pieces"))
    return of.join(pieces, "doc").mapInPandas(lambda parts: _packed(cut(parts)), PACKED)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier leave every document."""
    rows, texts = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = texts.select("doc", F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"]), F.lit(0)).alias("gone"), F.size("removed").cast("long").alias("spans"), F.sha2("kept", 256).alias("sha"))
    out = rows.join(told, "doc", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.col("gone")).alias("n_removed"), F.when(F.col("copy"), 1).otherwise(F.col("spans")).cast("long").alias("n_spans"), F.when(F.col("copy"), nothing).otherwise(F.col("sha")).alias("kept_sha256"))
