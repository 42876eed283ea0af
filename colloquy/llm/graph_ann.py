"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one point of a graph. Points are dealt to shards of bounded size by their hash; a
shard's graph is built in two passes: greedy searches from the medoid propose neighbours, pruning
with a relaxed distance (alpha) keeps diverse edges, and reverse edges are pruned alike. Graphs are built
once and written to the shared folder, a row each. Queries stream past them in blocks: a task holds
one graph and at most GROUP blocks of queries, whose number is that of stated queries. A query's beam search visits every shard; the nearest of all shards are
ranked by exact distances in double precision.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose
length differs from the most frequent length; long vectors are taken whole, SHARD of them to a task. Ties
go to the smaller vec_id. An identifier that occurs twice counts as two rows; a query leaves out only rows
with its own identifier. Other columns are dropped, so their names cannot clash. Empty tables give an empty
result; with fewer candidates than k, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import table, written

#: Points of a shard, at most about; edges of a point; beams of building and searching; relaxation.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 16_384, 32, 48, 96, 1.2
#: Queries of a block, and blocks that a task takes past a graph.
BLOCK, GROUP = 512, 256


class Graph:
    """A directed graph over the rows of `points`."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3):
        self.hold(points)
        n = len(self.points)
        self.degree = min(degree, max(1, n - 1))
        rng = np.random.default_rng(seed)
        self.edges = rng.integers(0, n, (n, self.degree)).astype(np.int32) if n else np.zeros((0, 1), np.int32)
        self.medoid = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        for a in (1.0, alpha) if n > 1 else ():
            order = rng.permutation(n)
            size = 64
            while len(order):  # batches grow as the graph gets better
                self._insert(order[:size], beam, a)
                order, size = order[size:], min(1024, size * 2)

    def hold(self, points: np.ndarray) -> None:
        """Points are kept as their offsets from the mean, whose squares single precision can tell apart."""
        self.mean = np.asarray(points, np.float64).mean(0) if len(points) else np.zeros(points.shape[1:])
        self.points = np.ascontiguousarray(points - self.mean, np.float32)
        self.norms = (self.points**2).sum(1)

    @classmethod
    def of(cls, points: np.ndarray, edges: np.ndarray, medoid: int) -> Graph:
        """A graph that was built before."""
        graph = cls.__new__(cls)
        graph.hold(points)
        graph.edges, graph.degree, graph.medoid = edges, edges.shape[1], medoid
        return graph

    def _distances(self, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return qn[:, None] + self.norms[ids] - 2 * np.einsum("bd,bkd->bk", q, self.points[ids])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of each query's beam, nearest first; -1 and infinity where it has fewer."""
        return self._search(np.ascontiguousarray(q - self.mean, np.float32), beam)

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), len(self.points)
        beam = min(beam, n)
        qn = (q**2).sum(1)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)
        start = np.full((b, 1), self.medoid)
        ids[:, 0], dist[:, 0], done[:, 0] = self.medoid, self._distances(q, qn, start)[:, 0], False
        seen[:, self.medoid] = True
        active = rows
        while len(active):
            first = np.where(done[active], np.inf, dist[active])
            at = first.argmin(1)
            go = np.isfinite(first[np.arange(len(active)), at])
            active, at = active[go], at[go]
            if not len(active):
                break
            done[active, at] = True
            near = self.edges[ids[active, at]].astype(np.int64)
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            d = np.where(new, self._distances(q[active], qn[active], near), np.inf)
            srt = np.sort(np.where(new, near, n), 1)  # an edge may occur twice
            if (srt[:, 1:] == srt[:, :-1])[srt[:, 1:] < n].any():
                order = np.argsort(near, 1, kind="stable")
                s = np.take_along_axis(near, order, 1)
                twice = np.zeros_like(new)
                np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
                d[twice] = np.inf
            all_d = np.concatenate([dist[active], d], 1)
            keep = np.argpartition(all_d, beam - 1, 1)[:, :beam] if all_d.shape[1] > beam else np.tile(np.arange(all_d.shape[1]), (len(active), 1))
            for name, other in ((ids, near), (dist, d), (done, np.zeros_like(new))):
                name[active] = np.take_along_axis(np.concatenate([name[active], other], 1), keep, 1)
            lost = ~np.isfinite(dist[active])
            done[active] |= lost
        ids = np.where(np.isfinite(dist), ids, -1)
        order = np.lexsort((ids, dist), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def prune(self, own: np.ndarray, cand: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each row's candidates: the nearest stays and drops those it makes needless."""
        b, k = cand.shape
        dist = np.where((cand < 0) | (cand == own[:, None]), np.inf, dist)
        order = np.argsort(dist, 1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        dist[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
        pts = self.points[np.maximum(cand, 0)]
        nrm = self.norms[np.maximum(cand, 0)]
        alive = np.isfinite(dist)
        out = np.repeat(own[:, None], self.degree, 1)
        count = np.zeros(b, np.int64)
        rows = np.arange(b)
        for _ in range(self.degree):
            has = alive.any(1)
            if not has.any():
                break
            at = alive.argmax(1)
            r = rows[has]
            a = at[has]
            out[r, count[r]] = cand[r, a]
            count[r] += 1
            alive[r, a] = False
            between = nrm[r] + nrm[r, a][:, None] - 2 * np.einsum("bkd,bd->bk", pts[r], pts[r, a])
            alive[r] &= alpha * alpha * between > dist[r]
        short = count < self.degree  # unused places repeat the first edge
        out[short] = np.where(np.arange(self.degree)[None] < count[short, None], out[short], np.where(count[short] > 0, out[short, 0], self.medoid)[:, None])
        return out.astype(np.int32)

    def _insert(self, batch: np.ndarray, beam: int, alpha: float) -> None:
        ids, dist = self._search(self.points[batch], beam)
        old = self.edges[batch].astype(np.int64)
        cand = np.concatenate([ids, old], 1)
        d = np.concatenate([dist, self._distances(self.points[batch], self.norms[batch], old)], 1)
        order = np.argsort(cand, 1, kind="stable")
        s = np.take_along_axis(cand, order, 1)
        twice = np.zeros(cand.shape, bool)
        np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        d[twice] = np.inf
        self.edges[batch] = self.prune(batch, cand, d, alpha)
        # reverse edges, all of a point's at once
        src = np.repeat(batch, self.degree)
        dst = self.edges[batch].ravel().astype(np.int64)
        pair = np.unique(dst * len(self.points) + src)
        dst, src = pair // len(self.points), pair % len(self.points)
        ok = dst != src
        dst, src = dst[ok], src[ok]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        width = min(int(place.max(initial=0)) + 1, 4 * self.degree)
        for lo in range(0, int(place.max(initial=-1)) + 1, width):
            part = (place >= lo) & (place < lo + width)
            to, row = np.unique(dst[part], return_inverse=True)
            fresh = np.full((len(to), width), -1, np.int64)
            fresh[row, place[part] - lo] = src[part]
            old = self.edges[to].astype(np.int64)
            cand = np.concatenate([old, fresh], 1)
            d = self._distances(self.points[to], self.norms[to], np.maximum(cand, 0))
            d[cand < 0] = np.inf
            order = np.argsort(cand, 1, kind="stable")
            s = np.take_along_axis(cand, order, 1)
            twice = np.zeros(cand.shape, bool)
            np.put_along_axis(twice, order[:, 1:], (s[:, 1:] == s[:, :-1]) & (s[:, 1:] >= 0), 1)
            d[twice] = np.inf
            self.edges[to] = self.prune(to, cand, d, alpha)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


FOUND = "query_id long, vec_id long, score double"
GRAPH = "shard int, ids array<long>, v array<double>, of array<int>, edges binary, medoid int"


def graphs_of(points: DataFrame) -> DataFrame:
    """GRAPH of each shard of (shard, v, ids): its points in id order, all their ids and whose each is, and its edges."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["ids"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        vs = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        graph = Graph(vs)
        of = [at for at, i in enumerate(order) for _ in ids[i]]
        out = [pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([[v for i in order for v in ids[i]]]), pa.array([vs.ravel()]), pa.array([of], pa.list_(pa.int32())), pa.array([graph.edges.tobytes()], pa.binary()), pa.array([graph.medoid], pa.int32())]
        return pa.table(out, ["shard", "ids", "v", "of", "edges", "medoid"])

    return points.select("shard", "v", "ids").groupBy("shard").applyInArrow(run, GRAPH)


def searched(k: int, beam: int):
    """Of a stream of graphs, each followed by blocks of queries: the k nearest of each query in each graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, vs = (row.column(row.schema.get_field_index(c)).flatten().to_numpy() for c in ("ids", "v"))
                at = row["shard"][0].as_py()
                if row["kind"][0].as_py() == 0:
                    of = row["of"].flatten().to_numpy()
                    n = int(of[-1]) + 1
                    base = vs.reshape(n, -1)
                    edges = np.frombuffer(row["edges"][0].as_py(), np.int32).reshape(n, -1)
                    graph, shard, own, first = Graph.of(base, edges, row["medoid"][0].as_py()), at, ids, np.searchsorted(of, np.arange(n + 1))
                    continue
                if graph is None or shard != at:  # a shard that no point was dealt to
                    continue
                asked = vs.reshape(len(ids), -1)
                out = [], [], []
                found, _ = graph.search(asked, beam)
                for q, v, near in zip(ids.tolist(), asked, found, strict=True):
                    near = near[near >= 0]  # the whole beam, in doubles; a point may be the query itself, so k + 1 and all that tie
                    d = np.sqrt(((base[near] - v) ** 2).sum(1))
                    if len(near) > k + 1:
                        close = d <= np.partition(d, k)[k]
                        near, d = near[close], d[close]
                    best = sorted((x, i) for x, r in zip(d.tolist(), near, strict=True) for i in own[first[r] : first[r + 1]].tolist() if i != q)[:k]
                    for x, i in best:
                        out[0].append(q)
                        out[1].append(i)
                        out[2].append(x)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows where the Column `queries` on `id` holds."""
    rows = usable(vectors, key, vector)
    # equal vectors: one point that carries its k + 1 smallest ids, enough for any query and its own row
    w = Window.partitionBy("v").orderBy("id")
    ids = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    points = written(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-points")
    shards = max(1, -(-points.count() // shard))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    graphs = written(graphs_of(dealt), "ann-graphs")
    n_blocks = max(1, rows.where(queries).count() // BLOCK)
    groups = -(-n_blocks // GROUP)
    asked = rows.where(queries).select("id", "v").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    blocks = written(asked.groupBy("block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("v")), "ann-queries")
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % groups).alias("group"), F.lit(1).alias("kind"), "ids", "v")
    held = graphs.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(0).alias("kind"), "ids", "v", "of", "edges", "medoid")
    both = held.unionByName(sent, allowMissingColumns=True).repartition(shards * groups, "shard", "group")
    found = both.sortWithinPartitions("shard", "group", "kind").mapInArrow(searched(k, beam), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
