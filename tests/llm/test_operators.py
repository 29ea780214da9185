"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinmatch.llm import chat_format, decontaminate, language_id, line_dedup, mpeg_audio, ngram_join, packing, registry, suffix_dedup, token_records, tokens

VIEWS = ("documents", "conversations", "pages", "benchmark")


def same(df, sf, sql):
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"create view {v} as select * from '{sf}/{v}.parquet'")
    got, want = df.toPandas(), con.execute(sql).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda t: sorted(map(str, t[cols].astype(object).where(t[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), sf, registry.ORACLE_SQL[name])


# MPEG audio


@given(st.binary(max_size=6000))
@settings(max_examples=40, deadline=None)
def test_payload_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    media = mpeg_audio.store(payload)
    s = mpeg_audio.walk(media)
    assert mpeg_audio.load(media, s) == payload
    assert s.skipped == 0 and s.crc_bad == 0 and s.table["frames"] == len(s.offsets) and s.table["bytes"] == len(media) - s.offsets[0] + mpeg_audio._opening(1)[1]
    assert s.duration == mpeg_audio.Fraction(1152 * len(s.offsets), 32000)


def test_resync_and_damage():
    media = mpeg_audio.store(bytes(range(256)) * 40)
    whole = mpeg_audio.walk(media)
    junk = mpeg_audio.walk(b"\xff\xfb junk \xff" + media[whole.offsets[0] :])
    assert junk.skipped == 9 and len(junk.offsets) == len(whole.offsets)
    hurt = bytearray(media)
    hurt[whole.offsets[1] + 10] ^= 1
    assert mpeg_audio.walk(bytes(hurt)).crc_bad == 1
    cut = mpeg_audio.walk(media + b"TAG" + bytes(125))
    assert len(cut.offsets) == len(whole.offsets) and cut.skipped == 0
    with pytest.raises(ValueError, match="damaged"):
        mpeg_audio.load(bytes(hurt), mpeg_audio.walk(bytes(hurt)))
    assert mpeg_audio.walk(b"nothing here").duration == 0


def test_headers():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz
    assert (h.size, h.samples, h.side, h.protected) == (417, 1152, 32, False)
    assert mpeg_audio.header(bytes([0xFF, 0xF3, 0x90, 0x00])).samples == 576  # MPEG 2
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0xF0, 0x00])) is None


def protected_frame(word, body):
    """A frame of any layer with a checksum worked out bit by bit."""
    h = mpeg_audio.header(word)
    bits = mpeg_audio.checked_bits(h, body)
    c = 0xFFFF
    for bit in ("".join(f"{b:08b}" for b in word[2:4]) + "".join(f"{b:08b}" for b in body))[: 16 + bits]:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ int(bit) else 0)
    return (word + c.to_bytes(2) + body).ljust(h.size, b"\0"), bits


@pytest.mark.parametrize(
    ("word", "bits"),
    [
        (bytes([0xFF, 0xFE, 0x80, 0xC0]), 128),  # layer I, mono: 32 allocations of 4 bits
        (bytes([0xFF, 0xFE, 0x80, 0x40]), 4 * (32 + 4)),  # layer I, joint stereo from subband 4
        (bytes([0xFF, 0xFC, 0xA0, 0xC0]), 11 * 4 + 12 * 3 + 7 * 2),  # layer II, mono, 192 kbit/s, 44.1 kHz, nothing allocated
        (bytes([0xFF, 0xFC, 0x10, 0xC0]), 2 * 4 + 6 * 3),  # layer II, mono, 32 kbit/s
        (bytes([0xFF, 0xF4, 0x80, 0x00]), 2 * (4 * 4 + 7 * 3 + 19 * 2)),  # MPEG 2 layer II, stereo
    ],
)
def test_checksums_of_other_layers(word, bits):
    frame, n = protected_frame(word, bytes(40))
    assert n == bits
    good = mpeg_audio.walk(frame * 3)
    assert (good.crc_ok, good.crc_bad, good.skipped) == (3, 0, 0)
    hurt = bytearray(frame * 3)
    hurt[4] ^= 1
    assert mpeg_audio.walk(bytes(hurt)).crc_bad == 1


def test_scale_factor_selection_is_checked():
    frame, bits = protected_frame(bytes([0xFF, 0xFC, 0x10, 0xC0]), b"\x11" + bytes(30))
    assert bits == 2 * 4 + 6 * 3 + 2 * 2  # two subbands are allocated
    hurt = bytearray(frame)
    hurt[6 + 3] ^= 0x10  # the last of the bits checked
    assert mpeg_audio.crc_good(frame, mpeg_audio.header(frame[:4])) and not mpeg_audio.crc_good(bytes(hurt), mpeg_audio.header(frame[:4]))


def test_free_format_and_resync():
    word = bytes([0xFF, 0xFB, 0x00, 0xC0])
    frames = b"".join((word if k % 3 else bytes([0xFF, 0xFB, 0x02, 0xC0])) + bytes(196 + (k % 3 == 0)) for k in range(7))
    s = mpeg_audio.walk(frames)
    assert (len(s.offsets), s.skipped, s.offsets[:3]) == (7, 0, [0, 201, 401])
    real = b"".join(protected_frame(bytes([0xFF, 0xFA, 0x90, 0xC0]), bytes(20))[0] for _ in range(3))
    decoy = bytes([0xFF, 0xFD, 0x10, 0xC0]).ljust(mpeg_audio.header(bytes([0xFF, 0xFD, 0x10, 0xC0])).size, b"\1")
    assert len(mpeg_audio.walk(b"junk" + decoy + real).offsets) == 3  # a layer II frame before layer III ones is no sync


def test_tags():
    tag = b"ID3\x02\0\0" + bytes([0, 0, 0, 10]) + b"TT2" + bytes([0, 0, 4]) + b"\0abc"
    assert mpeg_audio.parse_id3v2(tag) == ({"TT2": b"\0abc"}, 20)
    tag = b"ID3\x03\0\x40" + bytes([0, 0, 0, 24]) + bytes([0, 0, 0, 6]) + bytes(6) + b"TIT2" + bytes([0, 0, 0, 4, 0, 0]) + b"\0abc"
    assert mpeg_audio.parse_id3v2(tag) == ({"TIT2": b"\0abc"}, 34)
    last = b"TAG" + b"a title".ljust(30, b"\0") + b"someone".ljust(30, b" ") + bytes(30) + b"1999" + bytes(29) + bytes([7, 12])
    assert mpeg_audio.walk(last).id3v1 == {"title": "a title", "artist": "someone", "year": "1999", "track": "7", "genre": "12"}


def test_tables_are_compared():
    media = mpeg_audio.store(bytes(range(256)) * 90)
    s = mpeg_audio.walk(media)
    assert s.table_agrees()
    wrong = bytearray(media)
    wrong[s.table_at + 23 + 16 + 50] ^= 0x7F  # an entry of the seek table
    assert mpeg_audio.walk(bytes(wrong)).table_agrees() is False
    assert mpeg_audio.walk(media[: s.offsets[-1]]).table_agrees() is False
    assert mpeg_audio.walk(media[s.offsets[0] :]).table_agrees() is None


def test_media_query(spark, sf):
    """All columns of the contract, recomputed from the texts; the media are read by the library's own frame sizes only."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = mpeg_audio.op1_mpeg_audio(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mpeg_audio.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        parts = -(-len(payload) // mpeg_audio.FRAME_PAYLOAD)
        assert r.feature.startswith(f"frames={parts};seconds={mpeg_audio.Fraction(1152 * parts, 32000).numerator}/")


# N-gram join


def components_by_brute_force(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_near_copies(spark, words, percent):
    rng, docs = random.Random(words), []
    vocabulary = [f"w{k}" for k in range(400)]
    for base in range(25):
        text = rng.choices(vocabulary, k=rng.choice([2, 5, 9, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, "  ")]
    got = ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_brute_force(docs, words, percent)


def test_product_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 80, 40).astype(np.uint64) * np.uint64(230584300921369395))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 80, 3).astype(np.uint64) * np.uint64(230584300921369395))))
        inter = len(np.intersect1d(a, b))
        assert ngram_join.multiply([a, b], np.array([0]), np.array([1]), 80).tolist() == [100 * inter >= 80 * (len(a) + len(b) - inter)]


def test_product_of_many_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    rows = [np.unique(np.concatenate((base[rng.random(60) < 0.93], rng.integers(0, 2**64, rng.integers(0, 5), dtype=np.uint64)))) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    inter = np.array([len(np.intersect1d(rows[x], rows[y])) for x, y in zip(a, b, strict=True)])
    size = np.array([len(r) for r in rows])
    want = 100 * inter >= 85 * (size[a] + size[b] - inter)
    assert (ngram_join.multiply(rows, a, b, 85) == want).all() and 0 < want.sum() < len(want)


def test_packed_numbers():
    x = np.array([0, 1, 255, 256, 2**24 - 1], np.uint64)
    assert ngram_join.unpacked(ngram_join.packed(x, 3), 3).tolist() == x.tolist()


def test_unrelated_with_a_footer(spark):
    """Documents that share a footer only leave no rows to compare."""
    rng = random.Random(7)
    footer = " ".join(f"footer{k}" for k in range(22))
    docs = [(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(12, 200))) + " " + footer) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    assert ngram_join.peel(df, 3, 90, 0, 1.0, 600 * 120, 600).count() == 0
    assert ngram_join.peel(df, 3, 80, 0, 1.0, 600 * 120, 600).count() == 0


def test_links_without_ids_and_with_repeated_ids(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(3, a, 1), (5, a + " x", 2), (5, b, 3), (None, b + " y", 4), (None, "alone in the world of texts", 5), (None, "alone in the world of texts", 6), (7, "two equal rows of one id", 7), (7, "two equal rows of one id", 8), (9, None, 9), (9, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()), key=str)
    assert got == sorted([(3, 56, 3), (5, 57, 3), (5, 56, 5), (None, 57, 5), (None, 2, None), (None, 2, None), (7, 2, 7), (7, 2, 7), (9, 0, 9), (9, 0, 9)], key=str)
    kept = sorted(r["__id"] for r in ngram_join.dedup(docs).collect())
    assert [x for x in kept if x not in (5, 6, 7, 8)] == [1, 3, 9, 10] and len(kept) == 6


# Suffix dedup


def cut_by_brute_force(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            else:
                seen.add(s)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_repeated_bytes(spark, tmp_path):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choices("ab é", k=n))
    passages = [letters(rng.choice([90, 100, 101, 130, 400])) for _ in range(12)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            k = rng.randrange(len(p))
            parts.append(rng.choice([p, p[:k] + "X" + p[k + 1 :], p[k:], letters(60)]))
        docs.append((i, "".join(parts)))
    docs += [(80, "x" * 1500), (81, "xy" * 700), (82, None), (83, "x" * 99)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == cut_by_brute_force(docs)


def test_a_repeated_row_is_no_copy_of_itself(spark, tmp_path):
    """Rows of one id and text are one document; others are cut by it, and its own rows by nothing but smaller ids."""
    rng = random.Random(7)
    a, b = ("".join(rng.choices("abcd", k=300)) for _ in range(2))
    docs = [(1, a), (2, a[50:200] + b), (3, b[10:]), (4, a), (5, b)]
    twice = spark.createDataFrame(docs * 2, "doc_id long, text string").repartition(3)
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect()
    want = cut_by_brute_force(docs)
    assert len(got) == 10 and {(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got} == set(want.items())


def test_equal_spans_of_a_pass_do_not_meet_under_their_key():
    """A passage of all texts of a pass comes under its keys once; the rest is known, each under a key of its own."""
    rng = random.Random(8)
    passage = bytes(rng.choices(b"abcdef ", k=400))
    texts = [bytes(rng.choices(b"abcdef ", k=20)) + passage for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc": np.arange(300), "text": [t.decode() for t in texts]})
    rows = pd.concat([b.to_pandas() for b in suffix_dedup._run_rows([batch])])
    assert not rows[~rows["known"]].duplicated(["key", "whole"]).any() and not rows[rows["known"]].duplicated("key").any()
    assert not set(rows["key"][rows["known"]]) & set(rows["key"][~rows["known"]])
    at = rows["at"].to_numpy()
    inside = (at >> 24 > 100) & ((at >> 24) + (at & 0xFFFFFF) < 320)  # runs that no text's own bytes cut off
    assert rows["known"].sum() > 300 and set(rows["doc"][~rows["known"] & inside]) == {0}
    assert (at & 0xFFFFFF).sum() == 300 * 321 and not rows.duplicated(["doc", "at"]).any()


def test_difference_cover_order(spark):
    """The suffix sorting alone finds every window that starts again."""
    rng = random.Random(2)
    base = bytes(rng.choices(b"abc", k=300))
    texts = [(d, first, base[k : k + 160 + d]) for d, (first, k) in enumerate([(0, 0), (1, 3), (2, 7), (5, 20), (9, 41), (0, 0)])]
    rows = [(d, f, len(t) - 99, t) for d, f, t in texts]
    got = suffix_dedup.sorted_repeats(spark.createDataFrame(rows, "doc long, first long, n long, bytes binary")).select("doc", F.expr("at >> 24").alias("w")).distinct().collect()
    seen, want = set(), set()
    for d, first, n, t in rows:
        for i in range(n):
            s = t[i : i + 100]
            want |= {(d, first + i)} if s in seen else set()
            seen.add(s)
    assert {(r.doc, r.w) for r in got} == want


def windows_by_brute_force(rows):
    seen, want = set(), set()
    for d, first, n, t in sorted(rows):
        for i in range(n):
            s = t[i : i + 100]
            want |= {(d, first + i)} if s in seen else set()
            seen.add(s)
    return want


def shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_suffix_sort_shuffles_each_key_once(spark):
    """Triples, triples of names and suffixes are dealt out once each; what goes back to the packs is a few rows."""
    rng = random.Random(3)
    rows = [(d, 0, 150, bytes(rng.choices(b"abcd ", k=249))) for d in range(40)]
    n = np.array([r[2] for r in rows])
    keys = len(suffix_dedup._sampled(n * 0, n, 3)[0]) + len(suffix_dedup._sampled(n * 0, n)[0]) + 2 * n.sum()
    df = spark.createDataFrame(rows, "doc long, first long, n long, bytes binary").localCheckpoint()
    before = shuffled_rows(spark)
    assert suffix_dedup.sorted_repeats(df).count() == 0
    assert shuffled_rows(spark) - before < 1.2 * keys


def test_suffix_sort_deals_out_a_key_that_fills_ranges(spark):
    """One string in all places and one of many contexts."""
    rng = random.Random(4)
    some = lambda k: bytes(rng.choices(b"ab\0\xff", k=k))
    passage = some(140)
    texts = [b"x" * 300 for _ in range(40)] + [some(20) + passage + some(20) for _ in range(40)] + [b"\0" * 130, b"\xff" * 130] * 2
    rows = [(d, d % 5, len(t) - 99, t) for d, t in enumerate(texts)]
    got = suffix_dedup.sorted_repeats(spark.createDataFrame(rows, "doc long, first long, n long, bytes binary"))
    assert {(r.doc, r.w) for r in got.select("doc", F.expr("at >> 24").alias("w")).collect()} == windows_by_brute_force(rows)


def test_packs_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 2000)
    rng = random.Random(6)
    rows = [(d, 3 * d, n, bytes(rng.choices(b"ab", k=n + 99))) for d, n in enumerate([1, 64, 65, 500, 2, 3000, 7])]
    want = [(d, first + i, t[i : i + 100]) for d, first, n, t in rows for i in range(n)]
    got, packs = [], list(suffix_dedup._packed(iter([pd.DataFrame(rows, columns=["doc", "first", "n", "bytes"])])))
    for pack in packs:
        pack = pack.iloc[0]
        for doc, first, n, begin in zip(*(x.tolist() for x in suffix_dedup._segments_of(pack)), strict=False):
            got += [(doc, first + i, pack["bytes"][begin + i : begin + i + 100]) for i in range(n)]
    assert got == want and len(packs) > 2


def test_ranges_keep_the_order_and_deal_out_hot_keys():
    rng = np.random.default_rng(5)
    keys = rng.integers(-3, 3, (5000, 3)) << 60
    keys[:2000] = keys[0]
    ranges = suffix_dedup.Ranges(keys[rng.integers(0, 5000, 600)], 20)
    number = ranges.of(*keys.T)
    hot = (keys == keys[0]).all(axis=1)
    assert len(set(number[hot].tolist())) > 4 and np.bincount(number, minlength=20).max() < 1000
    assert len(set(ranges.home[number[hot]].tolist())) == 1 and not set(number[hot].tolist()) & set(number[~hot].tolist())
    order = np.lexsort(keys.T[::-1])
    home = ranges.home[number[order]]
    assert (np.diff(home) >= 0).all()
    same = (np.diff(keys[order], axis=0) == 0).all(axis=1)
    assert (np.diff(home)[same] == 0).all()


# Tokens, packing and records


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_word_cache_is_exact(text):
    enc = tokens.encoder()
    got = np.frombuffer(enc.encode(text), "<u4").tolist()
    assert got == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END_ID]


@pytest.mark.parametrize("text", ["It's <|endoftext|>. x", "<|ENDOFTEXT|> y", "İstanbul ΣΑΣ, don't. éx ́y ≠  z　q", "x\u0085y\x1cz\x0b\x0cw", "'s can't.'s 'll, the',... a.́ b_c."])
def test_word_cache_on_odd_texts(text):
    enc = tokens.encoder()
    assert np.frombuffer(enc.encode(text), "<u4").tolist()[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ALİ,", "KENDİSİ.", "कड़,", "बड़.", "איִ,"])
def test_letters_that_normalising_splits(text):
    enc = tokens.encoder()
    assert np.frombuffer(enc.encode(text), "<u4").tolist()[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_cache_on_mixed_alphabets():
    enc, rng = tokens.encoder(), random.Random(11)
    letters = [*"aEßéÀµªºİıΣςſKÅ", *map(chr, range(0x0958, 0x0960)), *map(chr, range(0xFB1D, 0xFB4F)), *map(chr, range(0x0300, 0x0340)), "\u0915", "\u093c", "\u05d9", "\u05b4", "7", "²", " ", "\n", *tokens.MARKS, "'s", "'ll"]
    for _ in range(30_000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 9)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist()[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def encoded(spark, sf):
    t = Tokenizer.from_file(tokens.TOKENIZER_FILE)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}


def test_records(spark, sf):
    want, at = encoded(spark, sf), 0
    got = {r.doc_id: r for r in token_records.op10_token_records(spark, sf).collect()}
    for i, ids in want.items():
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_index_and_checksums(spark, sf):
    shard = token_records.write_records(spark.read.parquet(f"{sf}/documents.parquet"), shards=2).first()
    straight = list(token_records.scan_shard(shard.records_file))
    assert sorted(straight) == sorted(token_records.read_shuffled(shard.records_file, shard.index_file, 7)) and len(straight) == shard.n_records
    record = bytearray(token_records.frame(b"payload"))
    assert token_records.unframe(bytes(record)) == (b"payload", len(record))
    for k in (0, 14):
        hurt = bytearray(record)
        hurt[k] ^= 1
        with pytest.raises((ValueError, token_records.struct.error)):
            token_records.unframe(bytes(hurt))


def test_packing(spark, sf):
    want, rows = encoded(spark, sf), packing.op4_packing(spark, sf).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(map(len, want.values())) + 2048


def test_open_windows_are_bounded():
    p, rng = packing.Packer(64, 4, 2), random.Random(0)
    total = sum(len(w) > 0 for k in range(500) for w in p.add(k, 0, 9, bytes(4 * rng.randint(1, 60))) if len(p.room) <= 4)
    assert total and len(p.room) <= 4


# Lines


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, (5000, 2))
    f = line_dedup.built(keys[:, 0], keys[:, 1])
    other = rng.integers(-(2**63), 2**63, (20000, 2))
    assert f.has(keys[:, 0], keys[:, 1]).all() and f.has(other[:, 0], other[:, 1]).mean() < 0.01
    f.delete(keys[:2500, 0], keys[:2500, 1])
    assert f.has(keys[2500:, 0], keys[2500:, 1]).all() and f.has(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01


def test_line_index_is_reversible(spark):
    docs = lambda a, b: spark.createDataFrame([(k, f"common line\n own {k}\n{'Rare' if k % 2 else 'x'}") for k in range(a, b)], "doc_id long, text string")
    first = line_dedup.LineIndex.build(docs(0, 8), min_docs=6)
    more = first.insert(docs(8, 30))
    back = more.delete(docs(8, 30))
    rows = lambda i: sorted(map(tuple, i.refs.collect()))
    assert rows(first) == rows(back) != rows(more)
    dropped = lambda i: [r.n_dropped for r in i.apply(docs(0, 4)).orderBy("doc_id").collect()]
    assert dropped(first) == dropped(back) == [1, 1, 1, 1] and dropped(more) == [2, 2, 2, 2]


def test_lines_of_repeated_ids(spark):
    rows = [(1, "a\nb")] * 3 + [(2, "a"), (3, "b\nb"), (None, "a"), (None, "a")]
    index = line_dedup.LineIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert sorted(r.refs for r in index.refs.collect()) == [2, 4]


def test_lines_by_shuffle(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    key = lambda df: sorted((r.doc_id, r.text, r.n_dropped) for r in df.collect())
    shipped = key(line_dedup.dedup_lines(docs, 3))
    monkeypatch.setattr(line_dedup, "SHIPPED_KEYS", 0)
    odd = docs.withColumn("text_id", F.lit("x")).withColumn("gone", F.lit(1))
    got = line_dedup.dedup_lines(odd, 3)
    assert key(got) == shipped and sum(n for _, _, n in shipped) and {(r.text_id, r.gone) for r in got.collect()} == {("x", 1)}
    monkeypatch.setattr(line_dedup, "FILTERED_KEYS", 0)
    assert key(line_dedup.dedup_lines(docs, 3)) == shipped


# Languages


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score")).first()
    assert r.a > 0.97 and r[1] >= 0 and r[2] <= 1


def test_against_plain_kernel_ridge():
    """With every text a landmark, scores are those of kernel ridge regression over plain Python sets."""
    rng = random.Random(8)
    words = {"a": ["ba", "lo", "mi", "ra", "to"], "b": ["sch", "ung", "ein", "ich", "keit"], "c": ["qu", "eux", "ait", "oi", "que"]}
    made = lambda k: " ".join("".join(rng.choices(words[k], k=rng.randint(1, 3))) for _ in range(12))
    langs = [k for k in words for _ in range(8)]
    texts, asked = [made(k) for k in langs], [made(k) for k in words for _ in range(4)]
    model = language_id.fit(texts, langs)
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    padded = lambda t: b" " + t.encode() + b" "
    known = [set().union(*[grams(padded(t), n) for t in texts]) for n in (1, 2, 3)]
    sets = lambda t: [grams(padded(t), n) & known[n - 1] for n in (1, 2, 3)]
    kernel = lambda x, y: sum(w * len(p & q) / (len(p) * len(q)) ** 0.5 for w, p, q in zip(language_id.WEIGHTS, x, y, strict=True))
    own = [sets(t) for t in texts]
    gram = np.array([[kernel(x, y) for y in own] for x in own])
    y = np.array([[1.0 if x == k else -1.0 for k in sorted(words)] for x in langs])
    alpha = np.linalg.solve(gram + language_id.RIDGE * len(texts) * np.eye(len(texts)), y)
    out = np.array([[kernel(sets(t), x) for x in own] for t in asked]) @ alpha
    got_langs, got_scores = language_id.classify(asked, model)
    assert got_langs == [sorted(words)[k] for k in out.argmax(axis=1)] == [k for k in words for _ in range(4)]
    assert got_scores == pytest.approx(np.clip((out.max(axis=1) + 1) / 2, 0, 1), abs=2e-3)


def test_bounds_of_the_fit(monkeypatch):
    monkeypatch.setattr(language_id, "VOCABULARY", 40)
    model = language_id.fit(["abcdefgh" * 3, "hgfedcba xyz"], ["p", "q"], landmarks=1)
    assert all(len(v) <= 40 for v in model["vocabulary"]) and model["landmarks"].shape[1] == 2  # one for each language


def test_kernel_is_presence():
    model = language_id.fit(["abab cd", "xyz xyz"], ["p", "q"])
    f = language_id.features(["abab cd", "abab cd abab cd"], model)
    sets = [set(language_id.ngrams("abab cd")[n].tolist()) for n in range(3)]
    assert f[0] @ f[0] == pytest.approx(sum(w for w, s in zip(language_id.WEIGHTS, sets, strict=True) if s))
    assert ((f[0] > 0) <= (f[1] > 0)).all()
    assert language_id.classify(["xyz", None, "123"], model)[0] == ["q", "und", "und"]


# Chat


def test_layouts(spark):
    texts = ['{"prompt":"a","response":"b"}', '{"instruction":"i","input":"","output":"o"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"messages":[{"role":"system","content":"s"}]}', '{"foo":{"bar":1}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.parse_json("j").alias("record"), F.lit("clash").alias("layout"))
    got = [(r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_format.to_turns(rows).orderBy("id").collect()]
    assert got == [("prompt and response", [("user", "a"), ("assistant", "b")]), ("instruction with input", [("user", "i"), ("assistant", "o")]), ("conversations", [("user", "h"), ("assistant", "g")]), ("messages", [("system", "s")]), (None, [])]


def test_no_record_is_lost(spark):
    texts = [
        '{"messages":[{"role":"user","content":"u","name":"n"},{"role":"assistant","content":"a"}],"id":7}',  # fields that no mapping names
        '{"foo":{"bar":[{"baz":1}]}}',  # an unknown layout
        '{"messages":[]}',
        '{"prompt":"p","completion":"c","my key":1}',
        '{"prompt":"p","completion":"c","system":"s"}',  # an optional part
        '{"prompt":"p","completion":"c","system":null}',
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.lit(0).alias("o"), F.parse_json("j").alias("record"))
    got = {}
    for r in chat_format.format_records(rows, ["id"], "o").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.layout, r.role, r.text))
    assert got == {
        0: [("messages", "user", "u"), ("messages", "assistant", "a")],
        1: [(None, None, None)],
        2: [("messages", None, None)],
        3: [("prompt and completion", "user", "p"), ("prompt and completion", "assistant", "c")],
        4: [("prompt and completion", "system", "s"), ("prompt and completion", "user", "p"), ("prompt and completion", "assistant", "c")],
        5: [("prompt and completion", "user", "p"), ("prompt and completion", "assistant", "c")],
        6: [(None, None, None)],
    }


def test_paths(spark):
    texts = ['{"a":{"b":{"c":[1,{"x":2}]}},"my key":"v","n":[[{"d":1}]],"e":{}}', '{"z":null,"m":[{"p":1},{"q":"s"}]}', "[1]", '"text"']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", chat_format.paths_of(F.parse_json("j")).alias("p")).orderBy("id").collect()
    assert [r.p for r in rows] == [["`my key`", "a.b.c[]", "e", "n[][].d"], ["m[].p", "m[].q", "z"], ["[]"], [""]]


def test_escape_round_trip(spark):
    parts = ["<|end|>", "<\\|end|>", "</s>", "[INST]", "[\\\\/INST]", "<", "|end|>", "\\", "<<SYS>>", "<|turn|>", "é\n", "<|text|>", "$1"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(t, r) for t, r in zip(texts, ["assistant", "us<|text|>er"] * 200, strict=True)], "text string, role string")
    out = chat_format.format_turns(rows).withColumn("p", chat_format.parse_formatted(F.col("formatted"), F.col("loss_span"))).collect()
    for r in out:
        assert (r.p.role, r.p.text, r.p.loss) == (r.role, r.text, r.text if r.role == "assistant" else None)
        assert [r.formatted.count(x) for x in ("<|turn|>", "<|text|>", "<|end|>")] == [1, 1, 1]


# Benchmark


def test_leaks(spark, sf):
    import re

    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d.doc_id, i) for d in docs for i, t in items if t in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, sf).collect()} == want


def test_reparameterised(spark):
    item = "When Alice buys {a} apples and gives {b} of them to Bob then how many of the {a} apples does she still have at home"
    bench = spark.createDataFrame([(1, item.format(a=12, b=5))], "item_id long, text string")
    same_form, broken = item.format(a=30, b=7).replace("Bob", "Carl"), item.format(a=30, b=7).replace("the 30", "the 31")
    docs = spark.createDataFrame([(1, "Well, x. " + same_form), (2, broken), (3, "When nothing of the kind is said at all in here by anyone then it is clean")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find_contamination(docs, bench).collect()] == [1]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]


def test_harder_slots(spark):
    item = "{0} has {1} apples in a basket by the old door and takes away {2} of them so how many are left in the basket for {0}"
    bench = spark.createDataFrame([(1, item.format("McKay", "30", "seven"))], "item_id long, text string")
    docs = [(1, item.format("Maria", "41", "12")), (2, "Well: " + item.format("O'Neil", "twenty-five", "eleven")), (3, item.format("Mary Smith-Jones", "8", "3")), (4, item.replace("{0} has", "Carl has").format("Anna", "8", "3"))]
    got = {r.doc_id for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, min_share=0.9).collect()}
    assert got == {1, 2, 3}


def test_recall_of_reparameterised_items(spark):
    """Of questions with other names, numbers and units, nine in ten are found, and no clean document."""
    rng = random.Random(17)
    names, nouns, verbs, units = ["Ann", "Bo", "Cy McKay", "Dora", "Eve O'Neil", "Finn", "Gus"], ["apples", "pears", "coins", "books", "stamps", "shells"], ["buys", "sells", "finds", "loses", "paints"], ["km", "kg", "hours", "cents"]
    fill = lambda: rng.choices([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], k=rng.randint(12, 30))

    def made():
        words = fill()
        for k in range(rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), f"{{n{k % 2}}} {rng.choice(verbs)} {{v{k % 3}}} {rng.choice([rng.choice(nouns), '{u}'])}")
        return " ".join(words) + "."

    def asked(t):
        a, b = rng.sample(names, 2)
        v = rng.sample([*map(str, range(2, 90)), "seven", "eleven", "thirty"], 3)
        return t.format(n0=a, n1=b, v0=v[0], v1=v[1], v2=v[2], u=rng.choice(units))

    templates = [made() for _ in range(80)]
    bench = spark.createDataFrame([(k, asked(t)) for k, t in enumerate(templates)], "item_id long, text string")
    docs = [(k, f"{' '.join(fill())}. {asked(t)} {' '.join(fill())}") for k, t in enumerate(templates)] + [(1000 + k, asked(made())) for k in range(80)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert sum((k, k) in got for k in range(80)) >= 72 and all(d == i for d, i in got)


def test_clashing_names(spark):
    bench = spark.createDataFrame([(1, "Six little ducks went out")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Six little ducks went out", "a", "b"), (2, "clean", "c", "d")], "doc_id long, text string, __id string, __text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()] == [(2, "clean", "c", "d")]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Six little ducks went out"), (2, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "And so six little ducks went OUT!"), (2, "too short")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()] == [(1, 1)]


def test_contained_item(spark):
    inner = " ".join(f"inner{chr(97 + k)}" for k in range(20))
    outer = " ".join([f"before{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)] + [inner] + [f"after{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)])
    bench = spark.createDataFrame([(1, outer), (2, inner)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + inner + " it was"), (2, outer)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.share) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {(1, 2): (13, 1.0), (2, 1): (93, 1.0), (2, 2): (13, 1.0)}
    assert decontaminate.decontaminate(docs, bench).count() == 0


def test_items_of_one_template(spark):
    item = "she then put {} apples and {} pears in the basket by the door"
    bench = spark.createDataFrame([(1, item.format(3, 3)), (2, item.format(3, 5))], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.format(3, 5)), (2, item.format(3, 3)), (3, item.format(8, 9))], "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench, min_share=1.0).collect()}
    assert whole == {(1, 2), (2, 1), (3, 2)}


def test_item_with_a_window_twice(spark):
    item = "put {0} red apples and {1} green pears in here now then put {2} red apples and {3} green pears in here now"
    bench = spark.createDataFrame([(1, item.format(3, 3, 3, 5))], "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame([(1, item.format(3, 3, 3, 5))], "doc_id long, text string"), bench).collect()
    assert [(r.item_id, r.share) for r in got] == [(1, 1.0)]


def test_items_full_of_numbers(spark):
    items = ["What is 17 times 23?", "Solve 3 x + 5 = 20 for x", "What is 7*8?", "Add 1 2 3 4 5 6 7 8 9 10 11 12 to 13"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    copies = [(k, f"They asked: {t} Nobody knew.") for k, t in enumerate(items)]
    others = [(10, "They asked: What is 17 times 24? Nobody knew."), (11, "Solve 4 x + 5 = 20 for x"), (12, "1 2 3"), (13, "Add 2 3 1 5 4 7 6 9 8 11 10 13 to 12")]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {(k, k): 1.0 for k in range(len(items))}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [10, 11, 12, 13]


def test_foreign_documents_go(spark, sf):
    import corpus_pipeline

    rng = random.Random(3)
    random_letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (40, 400)]
    foreign = ["Это обычный русский текст о погоде и о жизни в большом городе у реки.", "这是一个关于天气和城市生活的普通中文文本，我们住在河边。", "Αυτό είναι ένα συνηθισμένο ελληνικό κείμενο για τη ζωή στην πόλη.", "To jest zwykły polski tekst o pogodzie i o tym, jak żyjemy w wielkim mieście.", *random_letters]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(more), sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if language_id.has_letter(r.text)}
