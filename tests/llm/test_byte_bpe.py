import random

import pytest

from colloquy.llm import byte_bpe as B
from colloquy.llm.common import tokenizer_path


def cases():
    rng = random.Random(2)
    pieces = ["word ", "Élan ", "日本語", "  ", "\n\n", "it's ", "1234567", "...", "\t", "🙂", "<|endoftext|>", "don't", " x"]
    return [None, "", " ", *("".join(rng.choice(pieces) for _ in range(n)) for n in (1, 5, 40, 300)), "many words here " * 9000, "a" * 3000, " " * 3000]


@pytest.mark.parametrize("run", [lambda df: B.decode(B.encode(df)), B.round_trip])
def test_ids_equal_the_librarys_and_round_trip(spark, run):
    texts = cases()
    enc = B.encoding(tokenizer_path(B.RANKS))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(1, "", 1, 2), (None, "x y", 1, 2)], "doc_id long, text string, ids int, k int")
    rows = run(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "x y" if r.doc_id is None else texts[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want) and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
    assert run(df.limit(0)).collect() == []


def test_safe_pieces_change_no_id():
    enc, rng = B.encoding(tokenizer_path(B.RANKS)), random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "7", "'s", "é", "-", "x1 "]) for _ in range(rng.randrange(80)))
        assert "".join(B.safe_pieces(text, 4)) == text
        assert B.encode_text(enc, text, 4).tolist() == enc.encode_ordinary(text)


def test_decode_takes_bytes_that_are_no_text(spark):
    enc = B.encoding(tokenizer_path(B.RANKS))
    half = enc.encode_single_token(b"\xe3")
    df = spark.createDataFrame([(1, half.to_bytes(4, "little"), 1)], "doc_id long, ids binary, n_tokens long")
    assert bytes(B.decode(df).first().decoded) == b"\xe3"
