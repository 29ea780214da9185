"""N-gram Jaccard self-join of documents as a blocked sparse product with size bounds, and its components.

Rows of the incidence matrix are documents (equal sets are one row), columns are distinct word n-grams.
With similarity of at least t a row of n columns has at least ceil(t n) columns in common with its partner,
so it lacks at most n - ceil(t n) of them. The product is made in blocks of columns:

1. Columns are counted by blocks of their hashes, and rows add up what they hold that no other row holds.
   Rows with more of it than they may lack are discarded, first by a part of the columns, then by all
   columns of the rows left. A row's batch sends a column that several of its rows hold only once.
2. What is left is stored once, encoded. Its columns are put in order, the rarest first. Linked rows have
   a column in common that is among the first n - ceil(t n) + 1 of the larger row and the first
   n - ceil(2 t n / (1 + t)) + 1 of the smaller, and only rows that do become pairs; a
   frequent column is met only by rows that hardly have others.
3. Pairs with sizes and 512-bit parity signatures (which never overstate a difference) within the bound are
   multiplied: overlaps are accumulated block of columns after block for all pairs of a batch at
   once, and pairs whose overlap so far and columns to come fall short are discarded after each block.

Of each column, every row first meets one hub, another one in each round; linked ones form components, and
only rows of different components meet further, in the end all of them, frequent columns split over
tasks. So groups of copies are not expanded into pairs, and no link between components is lost.

Defined cases: null and empty texts have size 0 and link with nothing; fewer words than n are one
n-gram; a text of any length is one row; rows without a doc_id are linked like others and come last in the order of
ids (component null if no id is reachable); rows that repeat an id with other texts are rows of their own;
ids are below 2**63 - 1; an empty table gives no rows; other columns pass through ``dedup``, whatever their names, and are
ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm.textkit import U64, as_bytes, batches, mix, shingle_sets, with_columns
from kinmatch.operators.cluster import connected_components
from kinmatch.storage import BROADCAST_IDS, discard, ensure_workers, lookup, materialise, restrict, spread

#: Words of an n-gram and percent of similarity, unless a contract names others.
WORDS, PERCENT = 5, 80
SIGNATURE_BITS = 512
WORDS64 = SIGNATURE_BITS // 64
#: Rounds of stars before the rows of different components meet one by one.
ROUNDS = 2
#: Column blocks of the exact product; columns counted in one block of the first step.
PRODUCT_BLOCKS, BLOCK_COLUMNS = 8, 500_000
#: Tags that a task adds up before it hands them on.
HELD_TAGS = 500_000
#: Bits of a column that are counted; more rows than there are make a column look shared at most.
COLUMN_BITS = 48
#: A column is frequent if it is met this often in a batch, and by this many rows or this share of them in all.
IN_BATCH, IN_ALL, SHARE_OF_ALL = 8, 1000, 1 / 500
#: Rows of a column that one task compares with all others of it.
SPLIT_ROWS = 500
#: Stands for a null doc_id.
LAST = 2**63 - 1


def lacking(n: np.ndarray, percent: int) -> np.ndarray:
    """Columns of a row of ``n`` from which a linked row holds one at least."""
    return n + percent * n // -100 + 1


def need(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Overlap from which two rows of these sizes link."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def signature(s: np.ndarray) -> list[int]:
    """Parity of the number of elements in each of 512 hashed columns, as eight integers."""
    bits = np.bincount((mix(s ^ U64(0x2545F4914F6CDD1D)) % U64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def digests(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each set, whatever the order."""
    total = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat ^ mix(np.array([salt], U64))), out=total[1:])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ np.diff(offsets).astype(U64)).astype(np.int64)


def multiply(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a, b) of numbers of ``rows`` (ascending columns) link: the product where pairs stand, by blocks of columns."""
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    block = (flat >> U64(64 - (PRODUCT_BLOCKS - 1).bit_length())).astype(np.int64)
    held = np.bincount(owner * PRODUCT_BLOCKS + block, minlength=len(rows) * PRODUCT_BLOCKS).reshape(len(rows), -1)
    begin = np.concatenate(([0], np.cumsum(size)))
    edge = begin[:-1, None] + np.concatenate((np.zeros((len(rows), 1), np.int64), np.cumsum(held, axis=1)), axis=1)
    rank = np.unique(flat, return_inverse=True)[1]
    entries = owner << 32 | rank  # ascending, as rows and columns in them are
    overlap, least, alive = np.zeros(len(a), np.int64), need(size[a], size[b], percent), np.arange(len(a))
    for k in range(PRODUCT_BLOCKS):
        x, y = a[alive], b[alive]
        count = edge[x, k + 1] - edge[x, k]
        first = np.cumsum(count) - count
        at = np.repeat(edge[x, k] - first, count) + np.arange(count.sum())
        asked = np.repeat(y, count) << 32 | rank[at]
        hit = entries[np.minimum(np.searchsorted(entries, asked), len(entries) - 1)] == asked
        overlap[alive] += np.bincount(np.repeat(np.arange(len(alive)), count), hit, len(alive)).astype(np.int64)
        left = np.minimum(begin[x + 1] - edge[x, k + 1], begin[y + 1] - edge[y, k + 1])
        alive = alive[overlap[alive] + left >= least[alive]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(pdf: pd.DataFrame, words: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat columns, offsets, row) of a batch of texts."""
    flat, sizes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group in batches(as_bytes(pdf["text"], lower=True)):
        f, offsets = shingle_sets(group, words)
        flat.append(f)
        sizes.append(np.diff(offsets))
        rows.append(digests(f, offsets, salt))
    return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(rows)


def _sizes(parts: Iterator[pd.DataFrame], words: int, salt: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        flat, offsets, row = _matrix(pdf, words, salt)
        check = digests(flat, offsets, salt + (1 << 32))
        yield pd.DataFrame({"id": pdf["id"], "n": np.diff(offsets), "row": row, "check": check})


def packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    """Numbers that :func:`packed` was given."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def tags_of(row: np.ndarray, tag: int) -> np.ndarray:
    """The low ``tag`` bytes of rows, but for all ones, which mean several rows."""
    several = U64((1 << 8 * tag) - 1)
    return np.minimum(row.astype(U64) & several, several - U64(1))


ENTRIES = "block int, first long, width int, gaps binary, tags binary, rows binary"


def _entries(parts: Iterator[pd.DataFrame], words: int, salt: int, part: float, blocks: int, tag: int) -> Iterator[pd.DataFrame]:
    """Columns of a batch by blocks, with the low ``tag`` bytes of the one row that holds each (all ones: several do).

    One of the batch's lines also carries its rows: row, size, columns counted that no other row of the batch holds.
    """
    several = (1 << 8 * tag) - 1
    for pdf in parts:
        flat, offsets, row = _matrix(pdf, words, salt)
        size = np.diff(offsets)
        once = np.zeros(len(row), bool)
        once[np.unique(row, return_index=True)[1]] = True
        once &= size > 0
        if not once.any():
            continue
        owner = np.repeat(np.arange(len(row)), size)
        counted = once[owner] & (flat >= U64(0) if part >= 1 else flat < U64(int(part * 2**64)))
        column, owner = flat[counted] >> U64(64 - COLUMN_BITS), owner[counted]
        order = np.argsort(column)
        column, owner = column[order], owner[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(column)), bool), column[1:] != column[:-1])))
        alone = np.diff(np.concatenate((first, [len(column)]))) == 1
        column, owner = column[first], owner[first]
        single = np.bincount(owner[alone], minlength=len(row))
        tags = np.where(alone, tags_of(row[owner], tag), U64(several))
        block = np.minimum((column.astype(np.float64) * (blocks / (part * 2.0**COLUMN_BITS))).astype(np.int64), blocks - 1)
        edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])) if len(block) else [0, 0]
        held = np.stack((row, size, single), axis=1)[once].astype("<i8").tobytes()
        carrier, out = int(row[0]) % (len(edges) - 1), []
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            gaps = np.diff(column[i:j])
            width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
            out.append((int(block[i]) if j > i else 0, int(column[i]) if j > i else 0, width, packed(gaps, width), packed(tags[i:j], tag), held if k == carrier else None))
        yield pd.DataFrame(out, columns=["block", "first", "width", "gaps", "tags", "rows"])


def _counted(lines: list, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags of the columns of a block that several rows hold, with the number of these columns."""
    columns, tags = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for r in lines:
        t = unpacked(bytes(r.tags), tag)
        if len(t):
            columns.append(np.concatenate(([U64(r.first)], U64(r.first) + np.cumsum(unpacked(bytes(r.gaps), r.width)))))
            tags.append(t)
    column, tags = np.concatenate(columns), np.concatenate(tags)
    if not len(column):
        return tags, np.zeros(0, np.int64)
    order = np.argsort(column)
    column, tags = column[order], tags[order]
    first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
    times = np.diff(np.concatenate((first, [len(column)])))  # equal tags may be two rows
    held = np.repeat(times > 1, times) & (tags != U64((1 << 8 * tag) - 1))
    return np.unique(tags[held], return_counts=True)


SHARED = "bucket int, tags binary, shared binary, rows binary"


def _shared(parts: Iterator[pd.DataFrame], tag: int, buckets: int) -> Iterator[pd.DataFrame]:
    """By buckets of tags: what blocks, which come one after another, say of each tag, added up, and the rows that lines carry."""
    tags, shared, rows, lines, at = [], [], [], [], None

    def told() -> pd.DataFrame:
        t, place = np.unique(np.concatenate([np.zeros(0, U64), *tags]), return_inverse=True)
        n = np.bincount(place, np.concatenate([np.zeros(0), *shared]), len(t)).astype(np.int64)
        r = np.concatenate([np.zeros((0, 3), np.int64), *rows])
        of_tag, of_row = ((x % U64(buckets)).astype(np.int64) for x in (t, tags_of(r[:, 0], tag)))
        out = [(k, packed(t[of_tag == k], tag), packed(n[of_tag == k].astype(U64), 4), r[of_row == k].astype("<i8").tobytes()) for k in np.union1d(of_tag, of_row).tolist()]
        for x in (tags, shared, rows):
            x.clear()
        return pd.DataFrame(out, columns=["bucket", "tags", "shared", "rows"])

    def counted() -> None:
        for x, y in zip((tags, shared), _counted(lines, tag), strict=True):
            x.append(y)
        lines.clear()

    for pdf in parts:
        for r in pdf.itertuples():
            if r.block != at and lines:
                counted()
                if sum(map(len, tags)) > HELD_TAGS:
                    yield told()
            at = r.block
            lines.append(r)
            if r.rows is not None:
                rows.append(np.frombuffer(bytes(r.rows), "<i8").reshape(-1, 3))
    counted()
    yield told()


def _left(pdf: pd.DataFrame, percent: int, tag: int) -> pd.DataFrame:
    """Rows of a bucket whose own columns leave room for a link."""
    join = lambda c, width: np.concatenate([np.zeros(0, U64), *[unpacked(bytes(x), width) for x in pdf[c]]])
    tags, place = np.unique(join("tags", tag), return_inverse=True)
    shared = np.bincount(place, join("shared", 4).astype(np.float64), len(tags))
    rows = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(bytes(x), "<i8").reshape(-1, 3) for x in pdf["rows"]]])
    own = tags_of(rows[:, 0], tag)
    at = np.minimum(np.searchsorted(tags, own), max(0, len(tags) - 1))
    met = np.where(tags[at] == own, shared[at], 0) if len(tags) else np.zeros(len(own))
    return pd.DataFrame({"row": np.unique(rows[rows[:, 2] - met < lacking(rows[:, 1], percent), 0])})


def peel(texts: DataFrame, words: int, percent: int, salt: int, part: float, columns: int, n_rows: int) -> DataFrame:
    """Rows (row) of ``texts`` whose columns, among the first ``part`` of all, leave room for a link.

    ``columns`` and ``n_rows`` say how many there are. Rows with equal tags add up what they share,
    which may keep a row but never discards one.
    """
    parallel = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tag = max(2, -(-(max(1, n_rows).bit_length() + 4) // 8))
    blocks = max(4 * parallel, int(columns * part) // BLOCK_COLUMNS + 1)
    entries = texts.mapInPandas(partial(_entries, words=words, salt=salt, part=part, blocks=blocks, tag=tag), ENTRIES)
    shared = entries.repartition(parallel, "block").sortWithinPartitions("block").mapInPandas(partial(_shared, tag=tag, buckets=parallel), SHARED)

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        return _left(pdf, percent, tag)

    return shared.groupBy("bucket").applyInPandas(left, "row long")


def _encoded(parts: Iterator[pd.DataFrame], words: int, salt: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        flat, offsets, row = _matrix(pdf, words, salt)
        sets = [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        out = pd.DataFrame([(r, len(s), s.astype("<u8").tobytes(), *signature(s)) for r, s in zip(row.tolist(), sets, strict=True) if len(s)], columns=["row", "n", "columns", *[f"s{k}" for k in range(WORDS64)]])
        yield out.drop_duplicates("row")


def _often(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        column, n = np.unique(np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(bytes(x), "<u8") for x in pdf["columns"]]]), return_counts=True)
        yield pd.DataFrame({"column": column[n >= IN_BATCH].astype(np.int64), "n": n[n >= IN_BATCH]})


def _split(raw: bytes, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row's rare columns, and its frequent ones in order."""
    s = np.frombuffer(bytes(raw), "<u8")
    if not len(frequent):
        return s, s[:0]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    return s[~often], s[often][np.argsort(place[at[often]])]


def _rare(parts: Iterator[pd.DataFrame], shipped) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for k in range(0, len(pdf), 256):
            part = pdf.iloc[k : k + 256]
            sets = [_split(raw, *shipped.value)[0] for raw in part["columns"]]
            yield pd.DataFrame({"column": np.concatenate(sets).astype(np.int64), "row": np.repeat(part["row"].to_numpy(np.int64), [len(s) for s in sets])})


def _heads(parts: Iterator[pd.DataFrame], percent: int, shipped) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        sets = [_split(raw, *shipped.value) for raw in pdf["columns"]]
        first = lacking(pdf["n"].to_numpy(np.int64), percent)
        n = pdf["n"].to_numpy(np.int64)
        near = n - need(n, n, percent) + 1
        yield pd.DataFrame({"row": pdf["row"], "met": 0, "column": 0, "first": first, "near": near, "rare": [len(r) for r, _ in sets], "often": [o[:k].astype("<i8").tobytes() for (_, o), k in zip(sets, first, strict=True)]})


HEADS = "row long, met int, column long, first int, near int, rare int, often binary"


def _runs(parts: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in pieces that never part rows with an equal ``by``, and where each run of those begins (and the end)."""
    held = []
    for pdf in parts:
        if not len(pdf):
            continue
        value = pdf[by].to_numpy()
        whole = int(np.searchsorted(value, value[-1])) if value[0] != value[-1] else 0
        if held and value[0] != held[-1][by].to_numpy()[-1] or whole:
            cut = whole if value[0] != value[-1] else 0
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
            if len(done):
                yield done, _begins(done[by].to_numpy())
            pdf = pdf.iloc[cut:]
        held.append(pdf)
    if held:
        done = pd.concat(held, ignore_index=True)
        yield done, _begins(done[by].to_numpy())


def _begins(value: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]))


def _met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of columns that several rows hold, every row with their number."""
    for pdf, begins in _runs(parts, "column"):
        times = np.diff(begins)
        met = np.repeat(times, times)
        out = pdf[met > 1].reset_index(drop=True)
        yield out.assign(met=met[met > 1].astype(np.int32), first=None, near=None, rare=None, often=None)


def _firsts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first columns of each row that others hold: its head comes first, then its shared columns, rarest first."""
    for pdf, begins in _runs(parts, "row"):
        column, rows, keys, own, near_by = pdf["column"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), [], [], []
        for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            first, near, rare, often = (pdf[c].iat[i] for c in ("first", "near", "rare", "often"))
            alone = int(rare) - (j - i - 1)
            key = np.concatenate((column[i + 1 : j], np.frombuffer(bytes(often), "<i8")))[: max(0, int(first) - alone)]
            keys.append(key)
            own.append(np.full(len(key), rows[i]))
            near_by.append(np.arange(len(key)) < int(near) - alone)
        yield pd.DataFrame({"key": np.concatenate(keys), "row": np.concatenate(own), "near": np.concatenate(near_by)})


def _multiplied(parts: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        if len(pdf):
            number = {r: k for k, r in enumerate(pd.unique(pd.concat([pdf["a"], pdf["b"]])))}
            rows: list = [None] * len(number)
            for x in ("a", "b"):
                for r, raw in zip(pdf[x], pdf[f"{x}_columns"], strict=True):
                    if rows[number[r]] is None:
                        rows[number[r]] = np.frombuffer(bytes(raw), "<u8")
            yield pdf.loc[multiply(rows, *[pdf[x].map(number).to_numpy(np.int64) for x in ("a", "b")], percent), ["a", "b"]]


def _bounded(percent: int) -> Column:
    """Sizes and signatures of a pair (columns with a_ and b_) allow a link."""
    least = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100.0 + percent) - 1e-9)
    parity = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(WORDS64)), F.lit(0))
    return (F.least("a_n", "b_n") >= least) & (parity <= F.col("a_n") + F.col("b_n") - 2 * least)


def _renamed(df: DataFrame, x: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(x if c == "row" else f"{x}_{c}") for c in df.columns if c not in keep])


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components of the encoded ``rows``."""
    spark = rows.sparkSession
    total = rows.count()
    often = rows.select("columns").mapInPandas(_often, "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    # At most 500 times the mean size of a row: every frequent column takes a 500th of the rows.
    often = often.where(F.col("n") >= max(IN_ALL, total * SHARE_OF_ALL)).toPandas().sort_values(["n", "column"])
    frequent, place = often["column"].to_numpy(np.int64).astype(U64), np.arange(len(often))
    order = np.argsort(frequent)
    shipped = spark.sparkContext.broadcast((frequent[order], place[order]))
    # Rarest columns first. What no other row holds comes before and is no key; what a 500th of the rows holds comes last.
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_by = lambda df, by, *then: df.repartition(parallel, by).sortWithinPartitions(by, *then)
    held = rows.select("row", "columns").mapInPandas(partial(_rare, shipped=shipped), "column long, row long")
    shared = sorted_by(held, "column").mapInPandas(_met, HEADS.replace("row long, met int, column long", "column long, row long, met int"))
    heads = rows.select("row", "n", "columns").mapInPandas(partial(_heads, percent=percent, shipped=shipped), HEADS)
    both = sorted_by(heads.unionByName(shared), "row", "met", "column")
    keys = materialise(both.mapInPandas(_firsts, "key long, row long, near boolean"), "first-columns")
    met = keys.groupBy("key").agg(F.count("*").alias("met"), F.max("near").alias("any")).where("met > 1 and any").select("key")
    told = materialise(lookup(keys, met, "key").withColumn("component", F.col("row")), "first-columns")
    discard(keys)
    sides = rows.drop("columns")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that link; a hub's columns are not shuffled to one task."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        held = restrict(rows.select("row", "columns"), ids, "row")
        both = lookup(pairs, _renamed(held, "a"), "a", width=F.length("a_columns")).join(_renamed(held, "b"), "b")
        return materialise(both.mapInPandas(partial(_multiplied, percent=percent), "a long, b long"), "links")

    def opened(hub: Column) -> DataFrame:
        """Columns where components still meet, each with one of its rows as hub."""
        of = told.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min_by(F.struct("row", "component"), F.struct(~F.col("near"), hub)).alias("hub"))
        return of.where("x <> y").select("key", "hub")

    links = spark.createDataFrame([], "a long, b long")
    for turn in range(ROUNDS):
        star = lookup(told, opened(F.xxhash64("row", F.lit(turn))), "key").where("component <> hub.component")
        star = star.select(F.col("hub.row").alias("a"), F.col("row").alias("b")).distinct()
        if turn == 0:  # most rows need one partner only
            star = star.groupBy("b").agg(F.min("a").alias("a"))
        star = materialise(star.join(_renamed(sides, "a"), "a").join(_renamed(sides, "b"), "b").where(_bounded(percent)).select("a", "b"), "stars")
        found = verified(star)
        discard(star)
        links = links.union(found)
        component = connected_components(links, "a", "b").select(F.col("id").alias("row"), "component")
        now = materialise(told.drop("component").join(component, "row", "left").select("key", "row", "near", F.coalesce("component", "row").alias("component")), "first-columns")
        discard(told)
        told = materialise(lookup(now, opened_keys(now), "key"), "first-columns")
        discard(now)
    # All pairs of rows of different components in what is still open.
    sizes = told.groupBy("key").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("splits"))
    left = materialise(lookup(told, sizes, "key").join(sides, "row"), "open-columns")
    one = _renamed(left, "a", "key", "splits").withColumn("split", F.pmod(F.xxhash64("a"), F.col("splits")).cast("int"))
    other = _renamed(left, "b", "key", "splits").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    ordered = "a_near and a_component <> b_component and (a_n < b_n or a_n = b_n and (a < b or not b_near))"
    pairs = one.join(other, ["key", "split"]).where(ordered).where(_bounded(percent)).select("a", "b").distinct()
    pairs = materialise(pairs, "pairs")
    out = links.union(verified(pairs))
    for table in (told, left, pairs):
        discard(table)
    return out


def opened_keys(told: DataFrame) -> DataFrame:
    """Columns (key) whose rows are of several components."""
    return told.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")


def _settled(texts: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Texts of ``ids`` (or without them), in an order that a repeated task sees again, as what a batch tells of its rows and
    columns belongs together: a scan with a broadcast has one, what was shuffled is stored first."""
    out = spread(restrict(texts, ids, "id", how))
    return out if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else materialise(out, "texts")


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, n, row) of ``docs``, the component (row, component_id) of each matrix row, and the salt of the digests."""
    ensure_workers(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    salt = 0
    while True:  # until no two sets have one digest
        sized = materialise(spread(texts).mapInPandas(partial(_sizes, words=words, salt=salt), "id long, n long, row long, check long"), "sizes")
        held = F.countDistinct("check", "n").alias("sets")
        groups = materialise(sized.groupBy("row").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.min("check").alias("x"), F.max("check").alias("y")), "rows")
        if not groups.where("x <> y").limit(1).count():
            break
        salt += 1
    groups = groups.drop("x", "y")
    n_rows, columns = groups.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One text of each row is worked on: ids all of whose texts are copies of a smaller id's are left out.
    by_id = lookup(sized.select("id", "row"), groups.select("row", "least"), "row").groupBy("id").agg((F.min("row") != F.max("row")).alias("several"), F.min("least").alias("least"))
    copies = by_id.where("not several and id <> least").select("id")
    rows_of = lambda alive: _settled(texts, alive.join(groups, "row").select(F.col("least").alias("id")).distinct())
    part = min(1.0, 2.5 * (100 - percent) / 100)
    alive = materialise(peel(_settled(texts, materialise(copies, "copies"), "left_anti"), words, percent, salt, part, columns, n_rows), "rows-left")
    if part < 1 or alive.count() < n_rows:
        held = alive.join(groups, "row").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        before, alive = alive, materialise(peel(rows_of(alive), words, percent, salt, 1.0, held[1], held[0]), "rows-left")
        discard(before)
    encoded = rows_of(alive).mapInPandas(partial(_encoded, words=words, salt=salt), "row long, n long, columns binary, " + ", ".join(f"s{k} long" for k in range(WORDS64)))
    if sized.count() > n_rows:  # a row may come with several texts
        encoded = encoded.dropDuplicates(["row"])
    encoded = materialise(encoded, "encoded-rows")
    component = connected_components(_links(encoded, percent), "a", "b").select(F.col("id").alias("row"), "component")
    discard(encoded)
    labels = groups.join(component, "row", "left").select("row", "n", "least", F.coalesce("component", "row").alias("component"))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = materialise(labels.join(least, "component").select("row", F.when(F.col("n") > 0, F.col("component_id")).alias("component_id")), "labels")
    discard(groups)
    return sized, labels, salt


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    sized, labels, _ = _labelled(docs, words, percent)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return lookup(sized, labels, "row").select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(known("component_id"), known("id")).alias("component_id"))


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null last), of the smallest digest among its texts."""
    sized, labels, salt = _labelled(docs, words, percent)
    told = materialise(lookup(sized, labels, "row").select("id", "row", "n", "component_id"), "members")
    discard(sized)
    # Ids with one row are decided by their id, all others (and nulls) by id, digest and place among equal rows.
    of_id = told.groupBy("id").agg(F.count("*").alias("texts"), F.min(F.coalesce(F.col("component_id"), F.col("id"))).alias("least"))
    odd = materialise(of_id.where(F.col("texts") > 1).select("id"), "repeated-ids")
    gone = materialise(of_id.where("texts = 1 and id <> least").select("id"), "near-copies")
    names = docs.columns
    own = "__id" + "_" * max(map(len, names))
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    drop = lambda df, ids, how="left_anti": restrict(df, ids.withColumnRenamed("id", own), own, how)
    if not odd.limit(1).count():
        return drop(keyed, gone).select(*[F.col(f"`{c}`") for c in names])
    first = told.where("n > 0").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("x")).select(F.col("x.id").alias("id"), F.col("x.row").alias("row")).withColumn("first", F.lit(True))
    told = told.select("id", "row", "n").distinct().join(first, ["id", "row"], "left").join(odd, "id").select(F.col("id").alias(own), F.col("row").alias(own + "r"), F.coalesce("first", F.col("n") == 0).alias(own + "k"), (F.col("n") == 0).alias(own + "e"))
    sets = lambda ts: {own + "r": _matrix(pd.DataFrame({"text": ts}), words, salt)[2].tolist()}
    repeated = with_columns(drop(keyed, odd, "left_semi"), sets, f"{own}r long").join(told, [own, own + "r"]).where(F.col(own + "k"))
    nth = F.row_number().over(Window.partitionBy(own, own + "r").orderBy(F.xxhash64("text")))
    repeated = repeated.withColumn(own + "n", nth).where(F.col(own + "e") | (F.col(own + "n") == 1))
    pick = [F.col(f"`{c}`") for c in names]
    return drop(drop(keyed, odd), gone).select(*pick).union(repeated.select(*pick))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and similarity 0.9."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
