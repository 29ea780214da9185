"""Every operator and stage on awkward rows and on empty tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinmatch.llm import registry, tokens
from tests.llm.helpers import LONG, ROWS, documents, stored


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("awkward")
    stored(spark, documents(spark), at)
    stored(spark, spark.createDataFrame([(1, None), (2, "One two three four five six seven eight nine ten 11 km.")], "item_id long, text string"), at, "benchmark")
    stored(spark, spark.createDataFrame([(1, None, None, None), (1, 0, "user", "hi </s>"), (None, 1, "assistant", "x"), (2, 0, "assistant", r"<\|end|> and <|end|>"), (2, 0, "assistant", r"<\|end|> and <|end|>")], "conv_id long, turn long, role string, text string"), at, "conversations")
    return stored(spark, spark.createDataFrame([(1, None, "x"), (2, "no url", None), (None, "http://u@A.b.example.com:80/x/y?z", "x"), (3, "http://A.b.example.com/x", "x"), (3, "http://A.b.example.com/x", "x")], "page_id long, url string, html string"), at, "pages")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    stored(spark, documents(spark).limit(0), at)
    stored(spark, spark.createDataFrame([], "item_id long, text string"), at, "benchmark")
    stored(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"), at, "conversations")
    return stored(spark, spark.createDataFrame([], "page_id long, url string, html string"), at, "pages")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_awkward_rows(spark, awkward, name):
    n = registry.QUERIES[name](spark, awkward).count()
    by_row = {"op1", "op2", "op3", "op7", "op9", "op10"}
    if name.split("_")[0] in by_row:
        assert n == len(ROWS)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == (1 if name.startswith("op6") else 0)


def ids_kept(df):
    return sorted(df.select("doc_id").collect(), key=str)


def row_ids(*ids):
    return sorted([(i,) for i in ids], key=str)


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, awkward, empty, step):
    name, stage = corpus_pipeline.STAGES[step]
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    out = stage(spark, docs, awkward)
    nothing = stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty)
    assert nothing.count() == 0
    if step + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == docs.columns == nothing.columns
    got = ids_kept(out)
    if name == "language ID":  # texts without a letter go, and those that share too few n-grams with what was learned
        assert {(i,) for i in (1, 2, 7, 9)}.isdisjoint({tuple(r) for r in got}) and (5,) in got and (6,) in got
    elif name == "line dedup":  # no line stands in ten documents
        assert got == row_ids(*[r[0] for r in ROWS]) and sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in ROWS)
        assert {(r.doc_id, r.n_chars) for r in out.collect()} == {(r[0], len(r[1] or "")) for r in ROWS}
    elif name == "n-gram Jaccard join":  # of 3 and both rows of 4 one stays, and 6 is nearly 5; rows without words stay
        assert got == row_ids(None, 1, 2, 3, 5, 7, 8, 9)
    elif name == "benchmark decontamination":  # no row holds the one item
        assert got == row_ids(*[r[0] for r in ROWS])
    else:
        assert {tuple(r) for r in got} == {(r[0],) for r in ROWS}


def test_ngram_rows(spark, awkward):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in registry.QUERIES["op2_ngram_join"](spark, awkward).collect())
    want = [(1, 0, 1), (2, 0, 2), (3, 7, 3), (4, 7, 3), (4, 7, 3), (5, 9, 5), (6, 10, 5), (None, 4, None), (7, 0, 7), (8, 1, 8), (9, 2, 9)]
    assert got == collections.Counter(want)


def ids_of(text):
    t = Tokenizer.from_file(tokens.TOKENIZER_FILE)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_records_of_awkward_rows(spark, awkward):
    rows, at = registry.QUERIES["op10_token_records"](spark, awkward).orderBy("start").collect(), 0
    texts = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (doc_id, text, _, _) in zip(rows, texts, strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_of_awkward_rows(spark, awkward):
    rows = registry.QUERIES["op4_packing"](spark, awkward).collect()
    by_doc = collections.Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    want = collections.Counter()
    for doc_id, text, _, _ in ROWS:
        want[doc_id] += len(ids_of(text))
    assert by_doc == want
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    whole = ids_of(LONG)
    for r in rows:
        if r.doc_id == 5:
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole)


def test_urls_of_awkward_rows(spark, awkward):
    got = [(r.page_id, r.host, r.n_active, r.blocked, r.categories) for r in registry.QUERIES["op8_url_filter"](spark, awkward).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got) == [(0, "a.b.example.com"), (1, ""), (2, ""), (3, "a.b.example.com"), (3, "a.b.example.com")]
    assert all(r[2:] == (0, False, "") for r in got if r[1] is None)


def test_long_urls_and_clashing_names(spark):
    from kinmatch.llm import url_filter

    long = "http://h.example/" + "/".join(["x"] * 20_000)
    pages = spark.createDataFrame([(1, long, "2024-02-03", "mine"), (2, "http://h.example/y", "2024-02-03", "mine")], "k long, url string, fetched_at string, __url string")
    events = spark.createDataFrame([("prefix", "h.example/x/x", "spam", "add", "2024-01-01")], "kind string, pattern string, category string, action string, listed_on string")
    got = url_filter.filter_urls(pages, events).orderBy("k").collect()
    assert [(r.k, r.n_active, r["__url"]) for r in got] == [(1, 1, "mine"), (2, 0, "mine")]
    assert url_filter.filter_urls(pages, events.limit(0)).where("blocked").count() == 0


def test_media_bytes(spark, awkward):
    for r in registry.QUERIES["op1_mpeg_audio"](spark, awkward).where("doc_id = 1 or doc_id = 2").collect():
        payload = bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (0, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))


def test_suffixes_of_copies(spark, awkward):
    got = {r.doc_id: r for r in registry.QUERIES["op3_suffix_dedup"](spark, awkward).collect()}
    assert got[6].n_bytes == len(LONG) + 4
    assert got[5].n_removed > len(LONG) - 300 and got[8].n_removed == 0  # it repeats itself
    assert got[6].n_removed >= len(LONG) and got[6].n_spans == 1


def test_conversations_read_back(spark, awkward):
    got = {r.conv_id: r for r in registry.QUERIES["op6_chat_format"](spark, awkward).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    twice = r"<\|end|> and <|end|>"
    assert got[2].n_turns == 2 and got[2].loss_sha256 == hashlib.sha256((twice * 2).encode()).hexdigest()
    assert got[1].n_turns == 2 and got[None].n_turns == 1


def test_unknown_language(spark, awkward):
    got = {r.doc_id: r for r in registry.QUERIES["op9_language_id"](spark, awkward).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 7, 9))
    assert got[5].lang_pred == "en"


def test_lines_kept(spark, awkward):
    got = registry.QUERIES["op7_line_dedup"](spark, awkward).where("doc_id = 1").first()
    assert (got.n_lines, got.n_dropped, got.kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())
    assert registry.QUERIES["op7_line_dedup"](spark, awkward).agg(F.sum("n_dropped")).first()[0] == 0
