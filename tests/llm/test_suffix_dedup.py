import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import suffix_dedup as S


def truth(docs, window):
    """docs: (key, text) in order; the removed intervals by brute force."""
    seen, out = set(), []
    for k, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, kept))
    return out


def cases(seed, window, n=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcé ") for _ in range(rng.choice([window // 2, window, window + 7, 3 * window]))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(2 * window))) for _ in range(rng.randrange(6))]
        docs.append((i, "".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "z" * 5 * window), (n + 5, "xy" * 2 * window), (n + 6, "z" * (2 * window)), (n + 7, ("q" * 30 + "r") * window)]
    return docs


@pytest.mark.parametrize("window", [20, 100])
@pytest.mark.parametrize("hot", [32, 2])
def test_equals_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(S, "HOT", hot)
    docs = cases(window, window)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, kept int, d int").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in S.dedup(df, window=window).collect())
    assert got == truth(docs, window)


def test_repeated_and_null_keys(spark):
    docs = cases(3, 20, 12)
    rows = [*docs, docs[5], (5, docs[7][1] + "tail"), (None, docs[4][1]), (None, docs[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r.t: r.h for r in df.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted({(k, t or "") for k, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
    want = {(k, t): rest for (k, t), (_, *rest) in zip(order, truth(order, 20), strict=True)}
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in S.dedup(df, window=20).collect()]
    assert sorted(got, key=str) == sorted([(k, *want[k, t or ""]) for k, t in rows], key=str)


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_by_group_keeps_groups_whole():
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = [pa.record_batch([pa.array(keys[a : a + 7]), pa.array(keys[a : a + 7] % 3)], ["a", "b"]) for a in range(0, 500, 7)]
    parts = [t["a"].to_numpy() for t in S.by_group(iter(batches), 2, 20)]
    assert np.concatenate(parts).tolist() == keys.tolist() and len(parts) > 5
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
