"""Periodic runs of words, by the tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words that repeats with smallest period q over at least two periods and
MIN_RUN words, and that no neighbouring word extends. Texts are read whole, in the tasks that hold them;
nothing is shuffled. For the stretches of a batch that may hold a run (`stretches`, which loses none):

1. a Lempel-Ziv factorization cuts them into blocks, and comparisons around each block's ends find a set
   of squares that covers the leftmost occurrence of every square (`leftmost_squares`);
2. their ends are marked in the suffix tree, and walks along suffix links, from each mark to the square
   that begins a word later, complete the vocabulary of squares (`Tree.vocabulary`);
3. the leaves under a square's end are its occurrences; those with one period at neighbouring places
   merge into runs (`runs_of`).

Only squares of primitive roots are kept, since those of a power lie in the runs of its root.

A null text has no words, an empty one neither: no run, an empty collapsed text. Repeated rows, repeated
keys and null keys are rows like others; other columns are dropped, so their names can't clash; an empty
table gives an empty result. Runs of one text may overlap: each counts, a word goes once. A worker needs
about a kilobyte for each word of the largest stretch (one text's at least), however long the table is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import chunks, powers, table

MIN_RUN = 12
#: Words whose repetition any run of at least MIN_RUN words shows: it agrees with itself, q words on, in so many places at least.
GRAM = MIN_RUN // 2


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint [start, end) that together hold every run.

    A run of period q agrees with itself at distance q in max(q, GRAM) places, so for any g up to that each
    of its g-grams comes again within q words. For periods in (low, 2 * low], neighbouring occurrences of a
    (low + 1)-gram at most 2 * low apart therefore cover the run. Grams are compared by hashes: a collision
    only adds a stretch.
    """
    n = len(ids)
    if n < MIN_RUN:
        return []
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:n], out=total[1:])
    cover, low, high = np.zeros(n + 1, np.int64), 0, GRAM
    while low < n // 2:
        g = max(GRAM, low + 1)
        h = (total[g:] - total[: n + 1 - g]) * down[: n + 1 - g]
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            break
        a, b = order[:-1][same], order[1:][same]
        near = b - a <= high
        np.add.at(cover, a[near], 1)
        np.add.at(cover, b[near] + g, -1)
        low, high = high, 2 * high
    inside = np.concatenate([[0], np.cumsum(cover)[:n] > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= MIN_RUN]


class Factors:
    """Ranks of all windows of 2**l words: the suffix array, and how far two places agree."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.levels, rank, width = [], np.unique(s, return_inverse=True)[1].astype(np.int64), 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if n == 0 or int(rank.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            width *= 2
        self.rank = rank
        self.sa = np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, i <> j."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i + got, j + got
            fits = np.maximum(a, b) < self.n
            r = self.levels[level]
            got += (fits & (r[np.where(fits, a, 0)] == r[np.where(fits, b, 0)])).astype(np.int64) << level
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to i and j, these included."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - got - (1 << level) + 1, j - got - (1 << level) + 1
            fits = np.minimum(a, b) >= 0
            r = self.levels[level]
            got += (fits & (r[np.where(fits, a, 0)] == r[np.where(fits, b, 0)])).astype(np.int64) << level
        return got


def blocks(f: Factors, lcp: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest prefix of the rest that begins earlier too, or one word."""
    n = f.n
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours in the suffix array among earlier places
    shared = lcp.tolist() + [0]
    rank, longest = f.rank.tolist(), [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b, with_a, with_b = before[r], after[r], shared[r], shared[after[r]]
        longest[i] = max(with_a, with_b)
        if b < n:
            before[b] = a
        if a >= 0:
            after[a] = b
        shared[b] = min(with_a, with_b)
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += longest[at] or 1
    return np.array(starts, np.int64)


def leftmost_squares(f: Factors, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares such that every square's leftmost occurrence is one, or lies to the right in a row of them.

    The middle of a leftmost square lies in some block. Either it begins there and passes the block's end,
    or it begins before the block, and its second half ends in the next block at the latest.
    """
    ends = np.append(starts[1:], f.n)
    size = ends - starts
    found = []

    def around(at: np.ndarray, other: np.ndarray, k: np.ndarray, left: np.ndarray, need_left: bool) -> None:
        ok = (at < f.n) & (other < f.n)
        at, other, k, left = at[ok], other[ok], k[ok], left[ok]
        right = f.forward(at, other)
        ok = right > 0
        at, other, k, left, right = at[ok], other[ok], k[ok], left[ok], right[ok]
        back = f.backward(at - 1, other - 1)
        ok = (right + back >= k) & ((back > 0) | (not need_left))
        found.append((np.maximum(left - back, left - k + 1)[ok], k[ok]))

    def each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.repeat(np.arange(len(counts)), counts)
        return b, np.arange(len(b)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    b, k = each(size)
    around(ends[b], ends[b] - k, k, ends[b] - k, False)
    b, k = each(size + np.append(size[1:], 0))
    around(starts[b], starts[b] + k, k, starts[b], True)
    start, k = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(start * (f.n + 1) + (f.n - k))  # by start, longest first
    return both // (f.n + 1), f.n - both % (f.n + 1)


def primitive(f: Factors, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of each square (start, k) is no power of a shorter one."""
    ok, rest, p = np.ones(len(k), bool), k.copy(), 2
    top = int(k.max(initial=1))
    while p <= top:
        prime = p if p * p <= top else 0  # beyond the root of the largest, what is left of a period is prime itself
        d = np.where(rest % p == 0, p, 0) if prime else np.where(rest > 1, rest, 0)
        at = np.flatnonzero((d > 0) & ok)
        short = k[at] // d[at]
        ok[at] = f.forward(start[at], start[at] + short) < 2 * k[at] - short
        if not prime:
            break
        while (more := rest % p == 0).any():
            rest[more] //= p
        p += 1
    return ok


class Tree:
    """The suffix tree of a sequence whose last word is unique; nodes 0..n-1 are leaves by rank, n is the root."""

    def __init__(self, s: np.ndarray, f: Factors, lcp: np.ndarray):
        n = f.n
        self.s, self.sa = s.tolist(), f.sa.tolist()
        self.rank = f.rank.tolist()
        lengths = lcp.tolist()
        parent, depth, low, least = [n] * n, [n - i for i in self.sa], list(range(n)), list(self.sa)
        high = list(range(n))
        for x, first in ((parent, -1), (depth, 0), (low, 0), (least, 0), (high, n - 1)):
            x.append(first)
        stack, node_at = [n], [n] * n
        for r in range(1, n + 1):
            length, last, begin = lengths[r] if r < n else 0, r - 1, r - 1
            while depth[stack[-1]] > length:
                v = stack.pop()
                high[v], parent[last] = r - 1, v
                if least[last] < least[v]:
                    least[v] = least[last]
                last, begin = v, low[v]
            if depth[stack[-1]] < length:
                stack.append(len(parent))
                parent.append(n)
                depth.append(length)
                low.append(begin)
                high.append(n - 1)
                least.append(least[last])
            top = stack[-1]
            parent[last] = top
            if least[last] < least[top]:
                least[top] = least[last]
            if r < n:
                node_at[r] = top
        self.parent, self.depth, self.low, self.high, self.least = parent, depth, low, high, least
        self.words = int(s.max()) + 1
        to = np.delete(np.arange(len(parent)), n)
        up = np.array(parent)[to]
        first = s[f.sa[np.array(low)[to]] + np.array(depth)[up]]
        self.child = dict(zip((up * self.words + first).tolist(), to.tolist(), strict=True))
        self.link = self.links(np.array(node_at), lcp, f)

    def links(self, node_at: np.ndarray, lcp: np.ndarray, f: Factors) -> list[int]:
        """Suffix links of inner nodes: two suffixes that part at a node part, without their first word, at its link."""
        n = f.n
        link = np.full(len(self.parent), n)
        place = np.full(len(self.parent), 0)
        place[node_at[1:]] = np.arange(1, n)  # a place in the suffix array where the node's suffixes part
        nodes = np.flatnonzero((np.array(self.depth) > 0) & (np.arange(len(place)) > n))
        at = place[nodes]
        a, b = f.rank[f.sa[at - 1] + 1] + 1, f.rank[f.sa[at] + 1]
        # where lcp is least between them, by a sparse table of places
        best, span = [np.arange(n)], b - a + 1
        while (1 << len(best)) <= int(span.max(initial=1)):
            x, half = best[-1], 1 << (len(best) - 1)
            y = np.append(x[half:], x[n - half :])
            best.append(np.where(lcp[y] < lcp[x], y, x))
        if len(nodes):
            level = np.frexp(span.astype(float))[1] - 1
            table_ = np.stack(best)
            left, right = table_[level, a], table_[level, b - (1 << level) + 1]
            link[nodes] = node_at[np.where(lcp[right] < lcp[left], right, left)]
        return link.tolist()

    def marks(self, start: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
        """(node, period) of squares (by start, longest first): the edge into the node holds the square's end.

        A leaf's squares are placed on its way up, as long as it is the leftmost leaf below.
        """
        out, at, starts, ks = [], 0, start.tolist(), k.tolist()
        while at < len(starts):
            i, v = starts[at], self.rank[starts[at]]
            while at < len(starts) and starts[at] == i:
                if self.least[v] != i:
                    at += 1  # further left there is the same square
                elif 2 * ks[at] > self.depth[self.parent[v]]:
                    out.append((v, ks[at]))
                    at += 1
                else:
                    v = self.parent[v]
        return out

    def vocabulary(self, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """All squares reached from the marks by suffix links: of x w x w that of w x w x, while it occurs."""
        s, sa, depth, parent, low, child, link, words = self.s, self.sa, self.depth, self.parent, self.low, self.child, self.link, self.words
        seen = set(marks)
        out = list(seen)
        for v, k in marks:
            while True:
                i, length = sa[low[v]], 2 * k - 1
                u = w = link[parent[v]]
                while depth[w] < length:
                    u = w
                    w = child[u * words + s[i + 1 + depth[u]]]
                if depth[w] == length:
                    w = child.get(w * words + s[i])
                    if w is None:
                        break
                elif s[sa[low[w]] + length] != s[i]:
                    break
                if (w, k) in seen:
                    break
                seen.add((w, k))
                out.append((w, k))
                v = w
        return out


def runs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods or more in a sequence of small integers."""
    s = np.append(s, s.max(initial=-1) + 1)
    f = Factors(s)
    lcp = np.zeros(f.n, np.int64)
    lcp[1:] = f.forward(f.sa[:-1], f.sa[1:])
    start, k = leftmost_squares(f, blocks(f, lcp))
    keep = primitive(f, start, k)
    start, k = start[keep], k[keep]
    if not len(start):
        return start, start, start
    tree = Tree(s, f, lcp)
    nodes = tree.vocabulary(tree.marks(start, k))
    v, k = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
    low = np.array(tree.low)[v]
    n = np.array(tree.high)[v] - low + 1
    rank = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    found = np.sort(np.repeat(k, n) * (f.n + 1) + f.sa[rank])  # by period, then place
    head = np.flatnonzero(np.append(True, np.diff(found) != 1))
    tail = np.append(head[1:], len(found)) - 1
    start, k = found[head] % (f.n + 1), found[head] // (f.n + 1)
    return start, found[tail] - found[head] + 2 * k, k


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text's words, by start and period; stretches of all texts go into one tree."""
    parts, of, begin = [], [], []
    for no, words in enumerate(texts):
        kinds = dict.fromkeys(words)
        if len(words) - len(kinds) < GRAM:
            continue  # a run repeats so many words at least
        number = dict(zip(kinds, range(len(kinds)), strict=True))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        for a, b in stretches(ids):
            parts.append(ids[a:b])
            of.append(no)
            begin.append(a)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if parts:
        top = 1 + max(int(p.max()) for p in parts)
        s = np.concatenate([x for i, p in enumerate(parts) for x in (p, [top + i])])  # a word that occurs once ends each stretch
        offset = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        start, length, period = runs_of(np.unique(s, return_inverse=True)[1].astype(np.int64))
        long = length >= np.maximum(MIN_RUN, 2 * period)
        start, length, period = start[long], length[long], period[long]
        part = np.searchsorted(offset, start, "right") - 1
        for p, a, n, q in zip(part.tolist(), (start - offset[part]).tolist(), length.tolist(), period.tolist(), strict=True):
            out[of[p]].append((begin[p] + a, n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs are (start, length, period), by start and period.

    Words are what ASCII white space parts. `prepare`, if given, maps a key and its words to those to read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in chunks(b, 1)):
            texts = [(t or b"").split() for t in part.column(1).to_pylist()]  # bytes are split at ASCII white space
            if prepare:
                texts = [prepare(k, w) for k, w in zip(part.column(0).to_pylist(), texts, strict=True)]
            runs = runs_of_texts(texts)
            each = [x for r in runs for x in r]
            values = pa.StructArray.from_arrays([pa.array([x[i] for x in each], pa.int64()) for i in range(3)], ["start", "length", "period"])
            offsets = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
            left = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).view(pa.string())
            yield pa.record_batch([part.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), left], ["k", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([T.StructField("k", kind), T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: in one document of ten, by its id's crc32, the words from some place on repeat. A null id plants nothing."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each row of `periodic_runs`: the number of runs, the longest (ties: smallest start, then period) and digests."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    out = runs.withColumn("best", best)
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return out.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), prepare=planted))
