import random

from colloquy.llm import token_counts as C
from colloquy.llm.common import tokenizer_path

PATH = tokenizer_path(C.VOCABULARY)
#: Pieces that letter case, normal form, white space, apostrophes and special strings could tell apart.
PIECES = ["word", "Élan", "日本語", " ", "\n", "it's", "1234", "...", "\t", "🙂", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "́", "á", "İ", "Σ", "\x1c", "\x85", "\xa0", " ", "가", "ᄀ", "ᅡ", "'s", "'", "ǅ", "ﬁ", "x" * 70, "\x00", "‍", "ß", "﻿", "thing***"]


def library(text):
    return len(C.tokenizer(PATH).encode(text or "", add_special_tokens=False))


def test_counts_equal_the_librarys():
    rng = random.Random(3)
    counts = C.Counts(PATH, C.Lengths({b"word": 1, b"it's": 2}))
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))
        assert counts.count(text.encode()) == library(text), repr(text)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 5)
    counts, text = C.Counts(PATH, C.Lengths({})), " ".join(f"word{i % 37}, x{i}" for i in range(300))
    assert counts.count(text.encode()) == library(text)
    assert len(counts.seen) <= 5


def test_lengths_survive_packing():
    counts = {b"a": 1, "é".encode(): 2, b"long": 300}
    assert C.Lengths(counts).open() == counts and C.Lengths({}).open() == {}


def test_every_row_gives_a_row(spark):
    rows = [(1, "a b a b", 1, 1), (1, "a b a b", 1, 1), (None, "Élan vital", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (4, "many words here " * 9000, 1, 1), (5, "y" * 20000, 1, 1), (6, "a <|endoftext|>b", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, k int")
    got = sorted(C.token_counts(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (k, text, *_) in zip(got, want, strict=True):
        n = library(text)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (k, len((text or "").encode()), n, n > C.LIMIT)
    assert C.token_counts(docs.limit(0)).collect() == []


def test_the_frequent_tier_is_bounded_and_right(spark):
    docs = spark.createDataFrame([(i, f"common, rare{i} w{i % 5}!") for i in range(400)], "doc_id long, text string")
    for rows in (1000, 100):
        known = C.frequent(docs, PATH, rows=rows, top=12).open()
        assert len(known) == 12 and known[b"common,"] == 2 and all(known[w] == library(w.decode()) for w in known)


def test_query_equals_the_library_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in C.op12_token_counts(spark, d).collect():
        assert r.n_tokens == library(texts[r.doc_id])
