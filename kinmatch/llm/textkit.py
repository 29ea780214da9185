"""Vectorised word, shingle and digest helpers shared by the operators.

All of them work on batches of whole texts, so that the cost of a numpy call is
shared by many short documents; a very long text is simply a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

U64 = np.uint64
#: Bytes of text worked on at once.
CHUNK_BYTES = 1 << 20
#: Bytes that separate words: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_UNBASE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _power(n: int, inverse: bool) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        out = np.full(size, _UNBASE if inverse else _BASE, dtype=U64)
        out[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(out)
    return have[:n]


def _runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], IS_SPACE[a], [True])).view(np.int8)))
    return a, edge[0::2], edge[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``raw`` and the byte where it starts."""
    a, starts, ends = _runs(raw)
    if not len(starts):
        return np.zeros(0, U64), starts
    total = np.zeros(len(a) + 1, U64)
    np.cumsum(BYTE_CODE[a] * _power(len(a), False), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(len(a), True)[starts] + (ends - starts).astype(U64)), starts


def batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts in groups of about CHUNK_BYTES."""
    group, size = [], 0
    for raw in texts:
        if group and size + len(raw) > CHUNK_BYTES:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield group


def as_bytes(column: pd.Series, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text; null is empty. Lower-casing touches A-Z only."""
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column]
    return [x.lower() for x in raw] if lower else raw


def shingle_sets(group: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text: (flat hashes, offsets), ascending in each text.

    A text with fewer words than ``words`` has its whole sequence as one shingle;
    one without words has none.
    """
    sizes = np.array([len(x) + 1 for x in group], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    h, starts = word_hashes(b"\n".join(group))
    first = np.searchsorted(starts, begins)  # of each text among all words
    count = np.diff(first)
    m = len(h)
    value = np.zeros(m, U64)
    for k in range(words):  # a text's last words lack followers; they are cut off below
        value[: m - k] = value[: m - k] * _BASE + h[k:]
    value = mix(value + U64(words))
    out, offsets = [], np.zeros(len(group) + 1, np.int64)
    for i, n in enumerate(count):
        at = first[i]
        if n >= words:
            s = np.sort(value[at : at + n - words + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            whole = U64(int(n))
            for x in h[at : at + n]:
                whole = mix(np.array([whole], U64) * _BASE + x)[0]
            s = np.array([whole], U64)
        else:
            s = np.zeros(0, U64)
        out.append(s)
        offsets[i + 1] = offsets[i] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), offsets


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed integers; the order does not matter."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=U64).astype(np.int64)), int(mix(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64).astype(np.int64))


def with_columns(df, derive, added: str, text: str = "text", done=None):
    """Append (or replace) columns that ``derive(texts) -> {name: values}`` computes from whole texts.

    ``done()`` is called at the end of a task, as workers outlive it with all they keep. All other columns pass through Arrow unchanged; columns of ``df`` that bear an added
    name are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    from kinmatch.storage import ensure_workers

    ensure_workers(df.sparkSession)
    new = {f.name: f for f in _parse_datatype_string(added).fields}
    fields = [new.get(f.name, f) for f in df.schema.fields] + [f for n, f in new.items() if n not in df.columns]
    types = {n: to_arrow_type(f.dataType) for n, f in new.items()}
    names = [f.name for f in fields]

    def run(parts):
        for batch in parts:
            values = derive(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(values[n], type=types[n]) if n in types else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)
        if done is not None:
            done()

    return df.mapInArrow(run, StructType(fields))
