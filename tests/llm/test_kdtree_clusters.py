import hashlib
import random

import numpy as np
import pytest

from colloquy.llm import kdtree_clusters as K


def plain(vectors, k, rounds, seed=K.SEED):
    """Lloyd's rounds over all points, in Python's integers."""
    x = [[int(np.floor(K.SCALE * c)) for c in v] for _, v in vectors]
    key = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v, n) for n, (i, v) in enumerate(vectors) if i is not None)
    z = [x[n] for *_, n in key[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(z))

    for _ in range(rounds):
        of = [nearest(p)[1] for p in x]
        z = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [p for p, c in zip(x, of, strict=True) if c == j]) else z[j] for j in range(len(z))]
    return [nearest(p)[::-1] for p in x], z


@pytest.mark.parametrize("spread", [0.001, 1.0, 3000.0])
def test_filtering_equals_plain_rounds(spark, monkeypatch, spread):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "LEAF", 4)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 5 * spread) for _ in range(4)] for _ in range(4)]
    points = [(i if i % 9 else None, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(300)]
    points += points[:40] + [(7, [0.0] * 4), (8, [0.0] * 4)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(3)
    want, z = plain(points, 5, 4)
    got = K.clustered(df, k=5, rounds=4, dim=4).collect()
    total = sum(d for _, d in want)
    assert sorted(((r.vec_id or -1), r.cluster, r.distance) for r in got) == sorted((i or -1, c, d) for (i, _), (c, d) in zip(points, want, strict=True))
    assert all(r.inertia == total and list(r.centroid) == z[r.cluster] and r.cluster_inertia == sum(d for c, d in want if c == r.cluster) for r in got)


def test_trees_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (200, 3)) + c for c in (0, 100, -100)])
    order = K.build(points)
    assert sorted(order.tolist()) == list(range(600))
    tree = K.Tree(points[order])
    z = np.array([[0, 0, 0], [100, 100, 100], [-100, -100, -100], [0, 0, 0]])
    far = ((tree.points[:, None] - z) ** 2).sum(2)
    cluster, distance = tree.assigned(z)
    assert (cluster == far.argmin(1)).all() and (distance == far.min(1)).all()
    assert sum(int((e - s).sum()) for s, e, total, _ in tree.filtered(z[:3]) if total is not None) > 300
    sums = tree.sums(z)
    assert sums[:, 0].tolist() == np.bincount(cluster, minlength=4).tolist()
    assert (K.Tree(tree.points, K.unpacked(K.packed(tree.nodes)).reshape(-1, 3, 3)).sums(z) == sums).all()


def test_vectors_that_take_no_part_and_small_tables(spark):
    ok = [1.0, -0.0001]
    rows = [(1, ok, 1), (2, None, 1), (3, [1.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (None, ok, 1), (1, ok, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    got = K.clustered(df, dim=2).collect()
    assert sorted((r.vec_id or 0, r.cluster, r.distance, list(r.centroid)) for r in got) == [(0, 0, 0, [1024, -1]), (1, 0, 0, [1024, -1]), (1, 0, 0, [1024, -1])]
    assert K.clustered(df.where("vec_id is null"), dim=2).collect() == []
    assert K.clustered(df.limit(0), dim=2).collect() == []
    with pytest.raises(Exception, match="a component exceeds"):
        K.clustered(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()
