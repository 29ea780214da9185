"""MPEG audio media columns: a frame walker that resynchronises, and a lossless payload store.

Reading: an ID3v2 tag (2.2 to 2.4, extended headers and unsynchronisation included) and an ID3v1 tag are read and
passed over, frame headers (MPEG 1, 2 and 2.5, layers I to III, free format too) are followed one to the next, and
where a header is wanting the reader looks for the next sync whose frame is followed by another one of the same
version, layer and sampling rate, or by the end. A Xing, Info or VBRI table in the first frame is parsed, not counted
as sound, and compared with the frames found. The CRC-16 of protected frames is verified: header and side information in layer
III, header and bit allocation in layer I, these and the scale-factor selection in layer II. Duration is exact: samples over
sampling rate, per stream; seek offsets are the bytes where frames start.

Storing: a payload is carried in layer III frames as ancillary data. Side information is
all zero, which decodes as silence; each frame is protected; after the side information stand two
bytes with the number of payload bytes, then those bytes, then zeros. The frames take the smallest
bit rate that holds their part, so the stream has a variable rate and starts with a Xing table.

Defined cases: a null text is an empty one; an empty payload is one unit of zeros; bytes that hold
no frame give zero frames and duration; a null stream has no bytes; a text of any length is one stream of as many frames as
it takes; an empty table gives no rows; repeated rows give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm.textkit import as_bytes
from kinmatch.storage import ensure_workers, materialise, spread

#: Fixed values of the format: kbit/s by bit-rate index, for MPEG 1 layers I, II, III and for
#: MPEG 2 and 2.5 layer I and layers II and III; sampling rates of MPEG 1.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = (44100, 48000, 32000)
UNIT = 64
#: Payload bytes of a full frame of the store (320 kbit/s at 32 kHz, mono).
FRAME_PAYLOAD = 1408
XING_FLAGS = 0x7  # frames, bytes and seek table
#: Bytes within which a frame of free format ends.
FREE_LONGEST = 1 << 13


@dataclass(frozen=True)
class Header:
    """One frame header; ``size`` in bytes, ``side`` of side information (layer III)."""

    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    rate: int
    sampling: int
    mono: bool
    size: int
    samples: int
    side: int
    bound: int  # subband from which two channels share their allocation (32: none)

    def alike(self, other: Header) -> bool:
        """Whether both can be frames of one stream."""
        return (self.version, self.layer, self.sampling) == (other.version, other.layer, other.sampling)


@lru_cache(maxsize=4096)
def header(word: bytes, free: int = 0) -> Header | None:
    """The header in four bytes, or None; ``free``: bytes of an unpadded frame where the rate is free."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    rate, sampling = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or rate == 15 or (rate == 0 and not free) or sampling == 3 or word[3] & 3 == 2:
        return None
    hertz = SAMPLING[sampling] // {1: 1, 2: 2, 25: 4}[version]
    kbit = RATES[1 if version == 1 else 2, layer][rate]
    padding, mono = word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    if rate == 0:
        size = free + padding * (4 if layer == 1 else 1)
    else:
        size = (12000 * kbit // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hertz + padding
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else 9 if mono else 17
    return Header(version, layer, not word[1] & 1, kbit, hertz, mono, size, samples, side, bound)


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, starting from ones."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first ``bits`` bits."""
    c = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> (7 - k % 8) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def allocation_widths(h: Header) -> list[int]:
    """Bits of each subband's allocation in a layer II frame, fixed by the format's tables."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    kbit = (h.rate or 384) // (1 if h.mono else 2)
    if kbit < 56:
        return [4] * 2 + [3] * (10 if h.sampling == 32000 else 6)
    return ([4] * 11 + [3] * 12 + [2] * 7)[: 30 if kbit >= 96 and h.sampling != 48000 else 27]


def checked_bits(h: Header, body: bytes) -> int:
    """Bits behind header and checksum that the checksum covers; ``body`` starts there."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 * channels if h.mono else 32 + min(32, h.bound))
    word, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0")), 0, 0
    for band, width in enumerate(allocation_widths(h)):
        for _ in range(channels if band < h.bound else 1):
            allocated = word >> (512 - at - width) & (1 << width) - 1
            at += width
            chosen += (channels if band >= h.bound else 1) * (allocated > 0)
    return at + 2 * chosen


def crc_good(frame: bytes, h: Header) -> bool:
    """Whether a protected frame's checksum is right."""
    bits = checked_bits(h, frame[6:])
    data = frame[2:4] + frame[6 : 6 + -(-bits // 8)]
    return len(data) * 8 >= 16 + bits and crc16_bits(data, 16 + bits) == int.from_bytes(frame[4:6])


@dataclass
class Stream:
    """What a walk over a stream found; ``samples`` by sampling rate."""

    tags: dict[str, bytes] = field(default_factory=dict)
    id3v1: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    table_at: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: dict[int, int] = field(default_factory=dict)
    rates: dict[int, int] = field(default_factory=dict)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes passed over to resynchronise

    @property
    def duration(self) -> Fraction:
        return sum((Fraction(n, hz) for hz, n in self.samples.items()), Fraction(0))

    def table_agrees(self) -> bool | None:
        """Whether the variable-bitrate table tells of the frames found; None without a table."""
        if not self.table:
            return None
        n, toc = len(self.offsets), self.table.get("toc", [])
        whole = (self.offsets[-1] + self.sizes[-1] if n else self.table_at) - self.table_at
        good = self.table.get("frames", n) == n and (n == 0 or abs(self.table.get("bytes", whole) - whole) <= max(self.sizes))
        if good and n and toc and self.table["kind"] == "VBRI":  # bytes of so many frames each
            step = self.table["step"]
            ends = np.array([*self.offsets, self.offsets[-1] + self.sizes[-1]])[np.minimum(np.arange(len(toc) + 1) * step, n)]
            return bool((np.abs(np.diff(ends) - toc)[:-1] <= max(self.sizes) + self.table["scale"]).all())
        if good and n and toc:  # 256ths of the stream at each hundredth of the frames
            at = np.array(self.offsets)[np.arange(100) * n // 100] - self.table_at
            return bool((np.abs(at - np.array(toc) * whole / 256) <= whole / 256 + 2 * max(self.sizes)).all())
        return good


def _seven(raw: bytes) -> int:
    """A number in the low seven bits of each byte."""
    return sum(b << 7 * k for k, b in enumerate(reversed(raw)))


def parse_id3v2(data: bytes) -> tuple[dict[str, bytes], int]:
    """Frames of an ID3v2.2 to 2.4 tag at the start, and the tag's length (0: there is none)."""
    if len(data) < 10 or data[:3] != b"ID3" or any(b & 0x80 for b in data[6:10]):
        return {}, 0
    version, flags, size = data[3], data[5], _seven(data[6:10])
    body, out, at = data[10 : 10 + size], {}, 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = 4 + int.from_bytes(body[:4]) if version == 3 else _seven(body[:4])
    name, width = (3, 3) if version == 2 else (4, 4)
    head = name + width + (0 if version == 2 else 2)
    while version in (2, 3, 4) and at + head <= len(body) and body[at]:
        n = _seven(body[at + name : at + name + width]) if version == 4 else int.from_bytes(body[at + name : at + name + width])
        out[body[at : at + name].decode("latin-1")] = body[at + head : at + head + n]
        at += head + n
    return out, 10 + size + (10 if version == 4 and flags & 0x10 else 0)


def parse_id3v1(data: bytes) -> dict[str, str]:
    """Fields of an ID3v1 tag at the end, or nothing."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    t = data[-128:]
    out = {k: t[i:j].split(b"\0")[0].decode("latin-1").strip() for k, i, j in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))}
    if t[125] == 0 and t[126]:
        out["track"] = str(t[126])
    return {k: v for k, v in out.items() if v} | {"genre": str(t[127])}


def free_size(data: bytes, at: int, end: int) -> int:
    """Bytes of an unpadded frame of free format at ``at``, by the next two headers like it; 0: there are none."""
    like = lambda x: data[x : x + 2] == data[at : at + 2] and x + 4 <= end and (data[x + 2] ^ data[at + 2]) & 0xFC == 0
    slot, then = 4 if header(data[at : at + 4], 1).layer == 1 else 1, at + 24
    while 0 <= (then := data.find(data[at : at + 2], then, min(end, at + FREE_LONGEST))):
        size = then - at - slot * (data[at + 2] >> 1 & 1)
        after = then + size + slot * (data[then + 2] >> 1 & 1) if then + 4 <= end else end
        if like(then) and (after == end or like(after)):
            return size
        then += 1
    return 0


def parse_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table of a frame, or nothing."""
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, out, p = struct.unpack(">I", frame[at + 4 : at + 8])[0], {"kind": kind.decode()}, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                out[name] = struct.unpack(">I", frame[p : p + 4])[0]
                p += 4
        if flags & 4 and p + 100 <= len(frame):
            out["toc"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, step = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width]) * scale for k in range(entries) if 62 + (k + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "scale": scale, "step": max(1, step)}
    return {}


def walk(data: bytes) -> Stream:
    """Follow the frames of a whole stream."""
    out = Stream(id3v1=parse_id3v1(data))
    out.tags, at = parse_id3v2(data)
    end = len(data) - 128 if out.id3v1 else len(data)
    first, synced, free = True, True, 0
    while at + 4 <= end:
        word = data[at : at + 4]
        h = header(word, free)
        if h is None and not free and header(word, 1) and (free := free_size(data, at, end)):
            h = header(word, free)
        follows = h and at + h.size <= end
        if follows and not synced and at + h.size != end:
            then = header(data[at + h.size : at + h.size + 4], free)
            follows = then and h.alike(then)
        if not follows:
            then = data.find(b"\xff", at + 1, end)
            then = end if then < 0 else then
            out.skipped += then - at
            at, synced, free = then, False, 0
            continue
        synced = True
        if h.protected:
            good = crc_good(data[at : at + h.size], h)
            out.crc_ok, out.crc_bad = out.crc_ok + good, out.crc_bad + (not good)
        if first and h.layer == 3 and (table := parse_table(data[at : at + h.size], h)):
            out.table, out.table_at = table, at
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.samples[h.sampling] = out.samples.get(h.sampling, 0) + h.samples
            out.rates[h.rate] = out.rates.get(h.rate, 0) + 1
        first = False
        at += h.size
    out.skipped += max(0, end - at)
    return out


@lru_cache(maxsize=64)
def _opening(rate: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a store frame, and the frame's size."""
    word = bytes([0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return word + crc16(word[2:] + side).to_bytes(2) + side, header(word).size


def _frame(part: bytes) -> bytes:
    rate = next(r for r in range(1, 15) if _opening(r)[1] >= 25 + len(part))
    opening, size = _opening(rate)
    return (opening + len(part).to_bytes(2) + part).ljust(size, b"\0")


def store(payload: bytes) -> bytes:
    """A stream that carries ``payload``."""
    frames = [_frame(payload[k : k + FRAME_PAYLOAD]) for k in range(0, len(payload), FRAME_PAYLOAD)]
    ends = np.cumsum([len(f) for f in frames])
    table, size = _opening(1)  # the smallest frame holds the table
    total = size + int(ends[-1])
    toc = bytes(min(255, 256 * int(ends[k * len(frames) // 100 - 1] if k * len(frames) // 100 else 0) // total) for k in range(100))
    table += b"Xing" + struct.pack(">III", XING_FLAGS, len(frames), total) + toc
    note = b"\0store\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    head = b"ID3\x03\0\0" + bytes([len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127])
    return b"".join([head, tag, table.ljust(size, b"\0"), *frames])


def load(data: bytes, stream: Stream) -> bytes:
    """The payload that a stored stream carries, by the frame offsets of its walk."""
    out = []
    for at in stream.offsets:
        begin = at + 23
        n = int.from_bytes(data[begin : begin + 2])
        out.append(data[begin + 2 : begin + 2 + n])
    payload = b"".join(out)
    told = stream.tags.get("TXXX", b"").rpartition(b"\0")[2]
    if stream.crc_bad or stream.skipped or told != str(len(payload)).encode() or not stream.table_agrees():
        raise ValueError("the stored stream is damaged")
    return payload


def _store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        raw = as_bytes(pdf["text"])
        media = [store(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(x) for x in raw], "media": media})


def store_texts(docs: DataFrame) -> DataFrame:
    """Table (doc_id, n_bytes, media) of the texts as streams, written to shared storage."""
    ensure_workers(docs.sparkSession)
    return materialise(spread(docs.select("doc_id", "text")).mapInPandas(_store, "doc_id long, n_bytes long, media binary"), "media")


PROBE = "tags array<string>, id3v1 map<string,string>, vbr_table string, vbr_agrees boolean, n_frames long, n_crc_ok long, n_crc_bad long, n_skipped long, duration_samples map<int,long>, duration_seconds double, seek_offsets array<long>"


def _probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        s = [walk(bytes(m) if m is not None else b"") for m in pdf["media"]]
        found = pd.DataFrame({"tags": [sorted(x.tags) for x in s], "id3v1": [x.id3v1 for x in s], "vbr_table": [x.table.get("kind") for x in s], "vbr_agrees": [x.table_agrees() for x in s], "n_frames": [len(x.offsets) for x in s], "n_crc_ok": [x.crc_ok for x in s], "n_crc_bad": [x.crc_bad for x in s], "n_skipped": [x.skipped for x in s], "duration_samples": [x.samples for x in s], "duration_seconds": [float(x.duration) for x in s], "seek_offsets": [x.offsets for x in s]})
        yield pd.concat([pdf["doc_id"].reset_index(drop=True), found], axis=1)


def probe(media: DataFrame) -> DataFrame:
    """Tags, tables, checksums, exact durations and seek offsets of a column ``media``."""
    ensure_workers(media.sparkSession)
    return media.select("doc_id", "media").mapInPandas(_probe, "doc_id long, " + PROBE)


def feature(s: Stream, payload: bytes) -> str:
    """Frames, exact duration, bit rates and seek offsets of a stored stream, as text."""
    d, seek = s.duration, zlib.crc32(np.array(s.offsets, "<u8").tobytes())
    return f"frames={len(s.offsets)};seconds={d.numerator}/{d.denominator};rates={','.join(f'{k}x{v}' for k, v in sorted(s.rates.items()))};table={s.table.get('kind')};crc_ok={s.crc_ok};seek={seek:08x}"


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for media in pdf["media"]:
            media = bytes(media)
            s = walk(media)
            payload = load(media, s)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(s, payload)))
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all texts as MPEG audio, read the stored bytes back and describe them."""
    media = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spread(media).mapInPandas(_digest, DIGEST)
