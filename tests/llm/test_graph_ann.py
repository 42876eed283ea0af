import math

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import graph_ann as A


def truth(rows, queries, k):
    n = max({len(v) for _, v in rows}, key=[len(v) for _, v in rows].count)
    rows = [(i, np.array(v, float)) for i, v in rows if len(v) == n and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, v in rows:
        if q in queries:
            out[q] = sorted((math.sqrt(((w - v) ** 2).sum()), i) for i, w in rows if i != q)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, query_id int, id int").repartition(4)


def test_vectors_far_from_zero_are_told_apart():
    x = np.random.default_rng(9).normal(0, 1, (3000, 32))
    for shift in (0.0, 1000.0, 1e6):
        graph, asked = A.Graph(x + shift), x[:300] + shift
        exact = np.argsort(((x[:300, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
        found = graph.search(asked, A.BEAM)[0][:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), exact.tolist(), strict=True)]) >= 0.95


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 7)
    monkeypatch.setattr(A, "GROUP", 2)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 24))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.3, 24)).tolist()) for i in range(3000)]
    want = truth(rows, set(range(0, 3000, 50)), 10)
    got: dict = {}
    for r in A.nearest(frame(spark, rows), F.col("id") % 50 == 0, shard=800).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(x) == 10 and x == sorted(x) for x in got.values())
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    exact = dict.fromkeys(want)
    for q in want:
        exact[q] = {i: s for s, i in want[q]}
        assert all(abs(s - exact[q][i]) < 1e-12 for s, i in got[q] if i in exact[q])


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30, [0.0, 2.0]), (31, [0.0, 0.0]), (32, [float("nan"), 1.0]), (33, [float("inf"), 1.0]), (34, [1.0, 2.0, 3.0])]
    df = frame(spark, rows).union(spark.createDataFrame([(35, None, 1, 2), (36, [None, 1.0], 1, 2)], "vec_id long, embedding array<double>, query_id int, id int"))
    got = A.nearest(df, F.col("id").isin(0, 5, 30, 31, 35), k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        *((0, k, k, 0.0) for k in (1, 2, 3, 4)), *((5, k + 1, k, 0.0) for k in range(4)), *((30, k + 1, k, math.sqrt(5.0)) for k in range(4)),
    ]


def test_fewer_candidates_than_k_and_empty(spark):
    df = frame(spark, [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 4.0])])
    assert [(r.vec_id, r.score) for r in A.nearest(df, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1.0), (2, 3.0)]
    assert A.nearest(df.limit(0), F.col("id") == 0).collect() == []
    assert A.nearest(frame(spark, [(0, [1.0])]), F.col("id") == 0).collect() == []


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4000).tolist()) for i in range(60)]
    got = [(r.query_id, r.vec_id) for r in A.nearest(frame(spark, rows), F.col("id") % 20 == 0, k=3, shard=30).orderBy("query_id", "rank").collect()]
    want = truth(rows, {0, 20, 40}, 3)
    assert got == [(q, i) for q in sorted(want) for _, i in want[q]]
