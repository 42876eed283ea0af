import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import sstable as S
from colloquy.llm.common import shared_dir, tokenizer_path

TEXTS = [
    None, "", " ", "The cat's  mat!", "ÉCOLE déjà-vu, <|endoftext|> x", "a<|StartOfText|>b", "ΟΔΟΣ. İstanbul é", "x" * 3000, "don't we'LL ''s 12²½ \x85\xa0 tab\tnl\n", "µ ª º ß ÿ \x00\x1c\x7f",
    "日本語のテキスト", "a b " * 2000, "##$$ a.b,c;d'e", "I'D I'm '", "\x1f'S 'Re",
]


def truth(texts):
    tok = Tokenizer.from_file(tokenizer_path(S.VOCABULARY))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_library():
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([*range(256), 0x301, 0x130, 0x3A3])) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts = TEXTS + noise
    got = [np.frombuffer(b, "<u4").tolist() for b in S.Encoder(tokenizer_path(S.VOCABULARY)).encode(texts)]
    assert got == truth(texts)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_shard_round_trip_and_lookup(n):
    out = io.BytesIO()
    w = S.Writer(out, block_bytes=256)
    keys = sorted([-5, *range(0, 2 * n, 2), *([7, 7] if n > 1 else [])]) if n else []
    for k in keys:
        w.add(S.long_key(k), S.pack_ids(np.array([abs(k), 70_000 if k == 4 else 1], "<u4")), 2)
    w.close()
    r = S.Reader(out, out.tell())
    assert [S.key_long(k) for k, _ in r.scan()] == keys and r.n == len(keys) and r.tokens == 2 * len(keys)
    for k in keys:
        found = r.get(S.long_key(k))
        assert len(found) == keys.count(k) and S.unpack_ids(found[0])[0] == abs(k)
    assert r.get(S.long_key(10**9)) == []


def test_keys_must_ascend():
    w = S.Writer(io.BytesIO())
    w.add(S.long_key(2), b"\2")
    with pytest.raises(ValueError):
        w.add(S.long_key(1), b"\2")


def test_documents(spark):
    rows = [(i * 3 % 17 if i else None, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    manifest = S.write_shards(docs, shared_dir(spark, "t"))
    got = [(r.doc_id, r.start, list(np.frombuffer(r.ids, "<u4"))) for r in S.read_shards(manifest).orderBy("start").collect()]
    ids = dict(zip(TEXTS, truth(TEXTS), strict=True))
    assert sorted(((k is not None, k or 0), v) for k, _, v in got) == sorted(((k is not None, k or 0), ids[t] + [2]) for k, t, _ in rows)
    assert [k for k, _, _ in got] == sorted([k for k, _, _ in rows], key=lambda k: (k is not None, k or 0))
    assert [s for _, s, _ in got] == np.cumsum([0] + [len(v) for _, _, v in got])[:-1].tolist()
    hit = S.lookup(manifest, spark.createDataFrame([(9,), (10**6,)], "doc_id long")).collect()
    assert {r.doc_id for r in hit} == {9}
    assert zlib.crc32(hit[0].ids) == spark.createDataFrame([(bytearray(hit[0].ids),)], "b binary").select(F.crc32("b")).first()[0]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.read_shards(S.write_shards(docs, shared_dir(spark, "t"))).collect() == []
