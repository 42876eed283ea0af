"""Centroid clustering by kd-tree filtering, in exact integers.

Vectors of `DIM` finite components become integers floor(SCALE * x). Tasks build a kd-tree over each
`BLOCK` of them and write it: points in the tree's order, and of each node its box, count and sum. A round
reads the trees and the centroids (K rows of DIM integers, in the closure) and, level by level, drops of
each node the centroids that another beats strictly at every point of its box; a node with one centroid
left is counted whole, and the points of leaves are compared with those that are left. What a task sends
on is K sums, so a round shuffles and collects K * (DIM + 1) numbers whatever the table holds.

Vectors that are null, of another length, or hold null or non-finite components are left out. A component
whose integer exceeds LARGEST ends the job with an error, as squared distances could leave a long. Rows
are points of their own, also with equal or null keys; a null key can't start a centroid. With fewer than
K candidates there are as many centroids; without any, the result is empty. Ties of distance go to the
smaller centroid, ties of the start's hashes to the smaller vector. Other columns are dropped, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import remove, table, written

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
#: Points of a tree and of a leaf.
BLOCK, LEAF = 4096, 16
LARGEST = 1 << 26


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of each component, x as double."""
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST / SCALE}")
    return x.astype(np.int64).reshape(-1, dim)


def levels_of(n: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level: every level halves the nodes of the one before, down to leaves of LEAF points."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > LEAF:
        b = out[-1]
        out.append(np.insert(b, np.arange(1, len(b)), (b[:-1] + b[1:]) // 2))
    return out


def build(points: np.ndarray) -> np.ndarray:
    """The order of the points in the tree: each node is halved at the median of its widest dimension."""
    order, bounds = np.arange(len(points)), levels_of(len(points))
    for upper, lower in zip(bounds, bounds[1:], strict=False):
        for a, m, b in zip(upper[:-1].tolist(), lower[1::2].tolist(), upper[1:].tolist(), strict=True):
            if b - a > 1:
                mine = points[order[a:b]]
                widest = int(np.argmax(mine.max(0) - mine.min(0)))
                order[a:b] = order[a:b][np.argpartition(mine[:, widest], m - a)]
    return order


class Tree:
    """A kd-tree of points in its order: boxes and sums by level."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray | None = None):
        self.points, self.bounds = points, levels_of(len(points))
        self.nodes = self.summaries() if nodes is None else nodes  # (nodes of all levels, low | high | sum, DIM)

    def summaries(self) -> np.ndarray:
        found = []
        for b in reversed(self.bounds):
            if not found:
                parts = [f.reduceat(self.points, b[:-1], axis=0) for f in (np.minimum, np.maximum, np.add)]
                found.append(np.stack(parts, 1))
            else:
                left, right = found[-1][::2], found[-1][1::2]
                found.append(np.stack([np.minimum(left[:, 0], right[:, 0]), np.maximum(left[:, 1], right[:, 1]), left[:, 2] + right[:, 2]], 1))
        return np.concatenate(found[::-1])

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
        """(start, end, sum or None, candidates) of nodes whose points have one candidate, and of leaves with more."""
        k = len(centroids)
        left, at = np.array([0]), 0  # the level's open nodes
        open_ = np.ones((1, k), bool)
        for level, b in enumerate(self.bounds):
            low, high, total = (self.nodes[at + left, i] for i in range(3))
            middle = low + high
            far = ((2 * centroids[None] - middle[:, None]) ** 2).sum(2)
            best = np.where(open_, far, np.iinfo(np.int64).max).argmin(1)
            u = centroids[None] - centroids[best][:, None]
            corner = np.where(u > 0, high[:, None], low[:, None])  # the box's point that favours the other most
            open_ = open_ & ((u * (centroids[None] + centroids[best][:, None] - 2 * corner)).sum(2) <= 0)
            one = open_.sum(1) == 1
            yield b[left[one]], b[left[one] + 1], total[one], open_[one]
            if level == len(self.bounds) - 1:
                yield b[left[~one]], b[left[~one] + 1], None, open_[~one]
            at += len(b) - 1
            left = np.repeat(2 * left[~one], 2)
            left[1::2] += 1
            open_ = np.repeat(open_[~one], 2, axis=0)

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every point."""
        out = np.empty(len(self.points), np.int32)
        for start, end, _, open_ in self.filtered(centroids):
            at, node = places(start, end)
            out[at] = open_.argmax(1)[node] if _ is not None else self.nearest(at, open_[node], centroids)
        return out, ((self.points - centroids[out]) ** 2).sum(1)

    def nearest(self, at: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        far = np.full(open_.shape, np.iinfo(np.int64).max)
        for c, z in enumerate(centroids):
            of = open_[:, c]
            far[of, c] = ((self.points[at[of]] - z) ** 2).sum(1)
        return far.argmin(1)

    def sums(self, centroids: np.ndarray) -> np.ndarray:
        """(count | sum) of each cluster."""
        out = np.zeros((len(centroids), 1 + self.points.shape[1]), np.int64)
        for start, end, total, open_ in self.filtered(centroids):
            if total is not None:
                c = open_.argmax(1)
                np.add.at(out[:, 0], c, end - start)
                np.add.at(out[:, 1:], c, total)
            else:
                at, node = places(start, end)
                c = self.nearest(at, open_[node], centroids)
                np.add.at(out[:, 0], c, 1)
                np.add.at(out[:, 1:], c, self.points[at])
        return out


def places(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(start - (np.cumsum(n) - n), n), of


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest of three widths; the first byte tells which."""
    top = int(np.abs(x).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind[2].encode() + x.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i" + raw[:1].decode(), offset=1).astype(np.int64)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(k, v) of the vectors that take part, v as doubles."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dim) & sound)


def trees(points: DataFrame, dim: int = DIM) -> DataFrame:
    """(keys, points, nodes): a kd-tree over each BLOCK points of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            x = integers(rows.column(1).combine_chunks(), dim)
            order = build(x)
            t = Tree(x[order])
            keys = rows.column(0).combine_chunks().take(pa.array(order))
            keys = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), keys)
            return pa.record_batch([keys, pa.array([packed(t.points)], pa.binary()), pa.array([packed(t.nodes)], pa.binary())], ["keys", "points", "nodes"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                at, n = at + part.num_rows, n + part.num_rows
                held.append(part)
                if n == BLOCK:
                    yield tree(held)
                    held, n = [], 0
        if n:
            yield tree(held)

    key = T.ArrayType(points.schema["k"].dataType)
    return points.mapInArrow(run, T.StructType([T.StructField("keys", key), T.StructField("points", T.BinaryType()), T.StructField("nodes", T.BinaryType())]))


def opened(points: bytes, nodes: bytes, dim: int) -> Tree:
    return Tree(unpacked(points).reshape(-1, dim), unpacked(nodes).reshape(-1, 3, dim))


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor(sum / count) of their points; those without stay."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), 1 + dim), np.int64)
        for batch in batches:
            for points, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += opened(points, nodes, dim).sums(centroids)
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = forest.select("points", "nodes").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = [list(map(int, c)) for c in centroids]
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # K * (DIM + 1) rows
        sums.setdefault(r.cluster, {})[r.at] = int(r.x)
    for c, x in sums.items():
        if x[0]:
            out[c] = [x[i] // x[0] for i in range(1, dim + 1)]
    return np.array(out, np.int64)


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part."""
    points = usable(vectors, key, vector, dim)
    rank = F.sha2(F.concat(F.lit(seed), F.col("k").cast("string")), 256)
    first = points.where("k is not null").select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([np.floor(SCALE * np.array(r.v)) for r in first], np.int64).reshape(-1, dim)
    spark, kind = vectors.sparkSession, points.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    forest = written(trees(points if len(centroids) else points.limit(0), dim), "kdtree-forest")
    for _ in range(rounds if len(centroids) else 0):
        after = moved(forest, centroids)
        if (after == centroids).all():
            break  # further rounds repeat this one
        centroids = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance = opened(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), dim).assigned(centroids)
                yield pa.record_batch([batch.column(0).slice(i, 1).flatten(), pa.array(cluster), pa.array(distance)], ["k", "cluster", "distance"])

    each = written(forest.mapInArrow(run, schema), "kdtree-assigned")
    remove(forest)
    per = each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    both = per.agg(F.sum("s").cast("long").alias("inertia"), F.collect_list(F.struct("cluster", F.col("s").cast("long").alias("cluster_inertia"))).alias("of")).select("inertia", F.inline("of"))
    where = spark.createDataFrame([(c, x) for c, x in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    facts = both.join(F.broadcast(where), "cluster")  # K rows
    return each.join(F.broadcast(facts), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _round(i: int) -> str:
    """SQL of one round: assignments by the centroids c{i}, and the next centroids."""
    floor_ = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return f"""
a{i} AS MATERIALIZED (SELECT r, v, c FROM (SELECT r, v, c, row_number() OVER (PARTITION BY r ORDER BY list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c) AS k FROM pts, c{i}) WHERE k = 1),
m{i} AS MATERIALIZED (SELECT c, list({floor_} ORDER BY d) AS z FROM (SELECT c, d, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS d FROM a{i}) GROUP BY c, d) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.z, c{i}.z) AS z FROM c{i} LEFT JOIN m{i} USING (c))"""


SQL = f"""
WITH pts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT sha256('{SEED}' || vec_id) AS h, v FROM pts WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})),
{",".join(_round(i) for i in range(ROUNDS))},
d AS MATERIALIZED (
    SELECT r, vec_id, c, q, z FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q, c) AS k
    FROM (SELECT r, vec_id, c, z, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS q FROM pts, c{ROUNDS})) WHERE k = 1
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(q AS BIGINT) AS distance, CAST(sum(q) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(q) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM d
"""
