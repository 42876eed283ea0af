"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text is its set of five-word shingles (a text of fewer words: one shingle of all). Texts with
equal sets are one node. A node has a label of LONGEST MinHash values in each of TREES trees. The join
starts from nodes that share whole labels, and shortens the matched prefixes level by level until the
links found, weighed by the chance of finding a link of their similarity, tell that the target recall is
reached; the recall is thus measured on the data, and only data with many links near the threshold go deep.

1. Sorted by tree and prefix, nodes that share a prefix are neighbours. Of them, those whose signatures
   agree in NEAR of 128 places at least are joined; a pair at the threshold fails that in one of 500,000
   cases, and texts that only share a common passage don't pass it, however many there are.
2. Clusters are the components of these. Within a cluster the sets themselves decide: every pair is
   counted, so what the forest connects is exact (up to 64-bit hashes of shingles). Large clusters, and
   large groups of neighbours, are compared block by block.

No pair is emitted: a task counts each node's links and returns its counts and the smallest node it is
linked to. Classes are the connected components of the links.

Equal texts are always linked, also those without a word. Null texts have a class of their own. Long
texts are taken whole, one at a time. Rows with one doc_id count as rows of their own; class_id is the
smallest doc_id of the class (null if it has none). Links at exactly the threshold count. Other columns
are dropped, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import common
from colloquy.llm.common import ASCII_LOWER, ASCII_UPPER, WORD, chunks, powers, remove, table, written
from colloquy.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Trees, values of a label, and the recall at which prefixes are shortened no more.
TREES, LONGEST, RECALL = 32, 6, 0.99999
#: Values of each tree in the signature, and how many of all must agree.
TOLD, NEAR = 4, 80
#: Neighbours that one call compares by signatures; pairs it compares at a time.
NEIGHBOURS, PAIRS = 8192, 100_000
#: Nodes, and shingles of theirs, that one call compares; larger clusters are cut into blocks of half of it.
TOGETHER, SHINGLES = 3000, 2_000_000
#: Steps of similarity, from the threshold to 1, that links are counted by.
STEPS = 20

BASE = np.uint64(common.BASE)
#: Bytes of words, lower-cased; 0 elsewhere. All bytes of non-ASCII characters belong to words.
WORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def chance(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """That two sets share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recall_of(found: np.ndarray, depth: int, threshold: float = THRESHOLD) -> float:
    """The recall at `depth` that links, counted by steps of similarity, tell of; 1 where there is none."""
    low = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    return float(found.sum() / (found / chance(low, depth)).sum()) if found.sum() else 1.0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of powers spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): 64-bit hashes of all texts' shingles, repeats included, and where each text's begin."""
    raw = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
    n = 1 << max(16, int(raw.size).bit_length())
    up, down = powers(n)
    b = WORD_BYTES[raw]
    inside = b > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    sums = np.cumsum(b * up[: raw.size], dtype=np.uint64)
    words = mix((sums[ends - 1] - sums[starts - 1]) * down[starts])
    sizes = np.array([len(t or b"") + 1 for t in texts])
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes + 1)  # each text's first word
    count = np.diff(np.r_[first, len(words)])
    made = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    at = np.cumsum(made) - made
    place = np.repeat(first - at, made) + np.arange(made.sum())
    left = np.repeat(first + count, made) - place
    total = np.zeros(len(place), np.uint64)
    padded = np.r_[words, np.zeros(WORDS, np.uint64)]
    for k in range(WORDS):
        total = total * BASE + np.where(left > k, padded[place + k], np.uint64(0))
    return mix(total), at


@functools.cache
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """(sets, n) MinHash values of the sets that begin at `begin`, none of them empty."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(begin)), np.uint32)
    v, w = np.empty_like(h), np.empty_like(h)
    for row, m in zip(out, multipliers(n), strict=True):
        np.multiply(h, m, out=v)
        np.right_shift(v, np.uint32(15), out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, np.uint32(0x85EBCA6B), out=v)
        np.minimum.reduceat(v, begin, out=row)
    return out.T


def forest(texts: list[bytes | None]) -> tuple[list[bytes | None], list[bytes | None], list[bytes | None], np.ndarray]:
    """(digest of each text's shingle set, its labels tree by tree, its signature, number of its shingles)."""
    hashes, at = shingles(texts)
    ends = np.r_[at[1:], len(hashes)]
    full = np.flatnonzero(ends > at)
    labels, signs, digests = [None] * len(texts), [None] * len(texts), []
    if len(full):
        values = minhashes(hashes, at[full], TREES * LONGEST).reshape(len(full), TREES, LONGEST)
        values ^= values >> np.uint32(16)
        for i, label, sign in zip(full.tolist(), values.astype(">u2"), values[:, :, :TOLD].astype(np.uint8), strict=True):
            labels[i], signs[i] = label.tobytes(), sign.tobytes()
    for text, a, e in zip(texts, at.tolist(), ends.tolist(), strict=True):
        digests.append(None if text is None else xxhash.xxh3_128_digest(np.unique(hashes[a:e]).tobytes() if e > a else b"\0" + text))
    return digests, labels, signs, ends - at


def counted(texts: list[bytes], group: np.ndarray, copies: np.ndarray, threshold: float = THRESHOLD, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked texts, linked rows, first text that links lead to) of each text within its group, exactly; links by STEPS.

    across: if given, only pairs with different values count.
    """
    n = len(texts)
    sets = []
    for at in range(0, n, 64):
        h, begin = shingles(texts[at : at + 64])
        sets += [np.unique(x) for x in np.split(h, begin[1:])]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    key = np.concatenate(sets) ^ mix(np.repeat(group, size).astype(np.uint64) + BASE) if n else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    length = np.diff(np.r_[first, len(key)])
    shared = np.repeat(length > 1, length)
    # postings of shared shingles; for each text, the postings it is in
    post, of = np.repeat(first, length)[shared], owner[shared]
    many = np.repeat(length, length)[shared]
    by = np.argsort(of, kind="stable")
    post, of, many = post[by], of[by], many[by]
    ends = np.searchsorted(of, np.arange(n), "right")
    texts_n, rows_n, root, steps = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), np.zeros(STEPS, np.int64)
    begin = 0
    for i in range(n):
        p, m = post[begin : ends[i]], many[begin : ends[i]]
        begin = ends[i]
        if not len(p):
            continue
        others = owner[np.repeat(p - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        both = np.bincount(others, minlength=n) if n <= 2 * TOGETHER else None
        if both is None:
            ids, c = np.unique(others, return_counts=True)
        else:
            ids = np.flatnonzero(both)
            c = both[ids]
        ok = (ids != i) & (c >= threshold * (size[i] + size[ids] - c) - 1e-9)
        if across is not None:
            ok &= across[ids] != across[i]
        ids, c = ids[ok], c[ok]
        if len(ids):
            alike = c / (size[i] + size[ids] - c)
            steps += np.bincount(np.clip((alike - threshold) / (1 - threshold) * STEPS, 0, STEPS - 1).astype(int), minlength=STEPS)
            texts_n[i], rows_n[i] = len(ids), copies[ids].sum()
            roots = np.unique(root[np.r_[i, ids]])
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    return texts_n, rows_n, root, steps


def nodes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, node, labels, sign, n shingles) of each row; labels and sign are null where the text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2, 1 << 18):
                digests, labels, signs, n = forest(part.column(2).cast(pa.binary()).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in (digests, labels, signs)), pa.array(n, pa.int64())], ["k", "h", "node", "labels", "sign", "n"])

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("h", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("node", "labels", "sign")), T.StructField("n", T.LongType())])
    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, schema)


def joined(group: np.ndarray, sign: np.ndarray, near: int) -> np.ndarray:
    """For each row the first row of its group that pairs of near signatures lead to; rows of a group follow each other."""
    n = len(group)
    root = np.arange(n)
    ends = np.searchsorted(group, group, "right")
    later = ends - np.arange(n) - 1
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), PAIRS, "right")) + at)
        m = later[at:stop]
        i = np.repeat(np.arange(at, stop), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        ok = (sign[i] == sign[j]).sum(1) >= near
        pairs = np.unique(np.c_[root[i[ok]], root[j[ok]]], axis=0)
        if len(pairs):
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for a, b in pairs.tolist():
                a, b = sorted((top(a), top(b)))
                if a != b:
                    up[b] = a
            lo = group.searchsorted(group[at])
            hi = ends[stop - 1]
            part = root[lo:hi]
            moved = np.isin(part, list(up))
            part[moved] = [top(x) for x in part[moved].tolist()]
        at = stop
    return root


def neighbours(placed: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b): edges that connect the nodes of each (place, block, other) with near signatures, one a node at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)], 1)
            if not len(keys):
                continue
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            cuts = np.r_[0, new] if last is not None and (keys[0] != last).any() else new
            if held and len(cuts) and size + cuts[-1] >= NEIGHBOURS:
                yield edges([*held, batch.slice(0, int(cuts[-1]))])
                held, size, batch = [], 0, batch.slice(int(cuts[-1]))
            held.append(batch)
            size, last = size + batch.num_rows, keys[-1]
        if held:
            yield edges(held)

    def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        keys = np.stack([rows[c].to_numpy() for c in ("place", "block", "other")], 1)
        group = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(len(group), -1)
        root = joined(group, sign, near)
        away = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([rows["node"].take(pa.array(x)).combine_chunks() for x in (away, root[away])], ["a", "b"])

    dealt = placed.repartition("place", "block", "other").sortWithinPartitions("place", "block", "other", "node")
    return dealt.select("place", "block", "other", "node", "sign").mapInArrow(run, "a binary, b binary")


def clusters_of(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, root): the nodes that share a prefix of `depth` values, and a near signature, by connected component."""
    label = f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(labels, {2 * LONGEST} * t + 1, {2 * depth})))"
    places = nodes.where("labels is not null").select("node", F.explode(F.expr(label)).alias("place"))
    # most places have one node: only what shares one gets its signature
    some = places.withColumn("size", F.count("*").over(Window.partitionBy("place"))).where("size > 1")
    blocks = F.when(F.col("size") <= NEIGHBOURS, 1).otherwise(F.ceil(2 * F.col("size") / NEIGHBOURS)).cast("int")
    placed = some.join(nodes.select("node", "sign"), "node").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.least("mine", "with")).withColumn("other", F.greatest("mine", "with"))
    edges = written(neighbours(placed), "ngram-edges")
    out = components(edges)
    remove(edges)
    return out


LINKS = "node binary, low binary, n_texts long, n_rows long, steps array<long>"


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """LINKS of (cluster, block, other, node, copies, t): a cluster's block against itself or another block.

    Rows of a (cluster, block, other) lie together, in order; several small clusters share a call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows = held_bytes = 0
        for batch in batches:
            for part in chunks(batch, 6):
                keys = list(zip(*(part.column(c).to_pylist() for c in (0, 1, 2)), strict=True))
                at = 0
                while at < len(keys):
                    end = at + 1
                    while end < len(keys) and keys[end] == keys[at]:
                        end += 1
                    if held and (held_rows >= 256 or held_bytes >= 1 << 21) and keys[at] != held_key:
                        yield links(pa.Table.from_batches(held))
                        held, held_rows, held_bytes = [], 0, 0
                    held.append(part.slice(at, end - at))
                    held_rows += end - at
                    held_bytes += sum(len(x or "") for x in part.column(6).slice(at, end - at).to_pylist())
                    held_key, at = keys[at], end
        if held:
            yield links(pa.Table.from_batches(held))

    def links(rows: pa.Table) -> pa.RecordBatch:
        places = list(zip(*(rows[c].to_pylist() for c in ("cluster", "block", "other", "node")), strict=True))
        rows = rows.take([i for i, x in enumerate(places) if not i or x != places[i - 1]])  # repeated rows
        block, other = rows["block"].to_numpy(), rows["other"].to_numpy()
        keys = list(zip(rows["cluster"].to_pylist(), block.tolist(), other.tolist(), strict=True))
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        group = np.array([number[k] for k in keys])
        mine = rows["mine"].to_numpy()
        node = rows["node"].to_pylist()
        # a block against another: only pairs across count; within a block they count in its own call
        across = np.where(block != other, mine, np.arange(len(keys)) + (1 << 40))
        n_texts, n_rows, root, steps = counted(rows["t"].cast(pa.binary()).to_pylist(), group, rows["copies"].to_numpy(), threshold, across)
        steps = pa.array([steps if not i else None for i in range(len(node))], pa.list_(pa.int64()))  # the call's, on its first row
        return pa.record_batch([pa.array(node, pa.binary()), pa.array([node[i] for i in root], pa.binary()), pa.array(n_texts), pa.array(n_rows), steps], ["node", "low", "n_texts", "n_rows", "steps"])

    return members.select("cluster", "block", "other", "mine", "node", "copies", "t").mapInArrow(run, LINKS)


def links_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """LINKS between nodes that share a prefix of `depth` values in some tree, written."""
    clusters = written(clusters_of(nodes, depth), "ngram-clusters")
    named = clusters.join(nodes.select("node", "copies", "n", "r.k", "r.h"), "node")
    load = F.greatest(F.count("*") / TOGETHER, F.sum("n") / SHINGLES)
    sizes = named.groupBy("root").agg(F.when(load <= 1, 1).otherwise(F.ceil(2 * load)).cast("int").alias("blocks"))
    members = named.join(sizes, "root").withColumn("kk", F.coalesce(F.col("k").cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("kk"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    with_text = members.join(texts, ["kk", "h"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself and every other; small clusters are one block
    met = with_text.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("root").alias("cluster"), F.least("mine", "with").alias("block"), F.greatest("mine", "with").alias("other"), "mine", "node", "copies", "t"
    )
    dealt = met.repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other", "node")
    links = written(verified(dealt), "ngram-links")
    remove(clusters)
    return links


def linked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes_of the rows, its different nodes, LINKS): prefixes are shortened until RECALL."""
    rows = written(nodes_of(docs, key, text), "ngram-nodes")
    kept = F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("h").alias("h"))).alias("r")
    nodes = written(rows.where("node is not null").groupBy("node").agg(kept, F.count("*").alias("copies"), *(F.min(c).alias(c) for c in ("labels", "sign", "n"))), "ngram-sets")
    for depth in range(LONGEST, 0, -1):
        links = links_of(docs, nodes, key, text, depth)
        found = links.agg(*(F.sum(F.get("steps", F.lit(i))).alias(f"s{i}") for i in range(STEPS))).first()
        if recall_of(np.array([x or 0 for x in found], float), depth) >= RECALL:
            break
        if depth > 1:
            remove(links)
    return rows, nodes, links


def classes_of(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    return components(links.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs`, with all its columns, of each class of equal or similar texts; rows without a text stay.

    It is the row with the smallest key, and of those the one with the smallest hash of its text; rows without
    a key come last. Of rows that agree in both, one stays. Columns may have any names.
    """
    rows, nodes, links = linked(docs, key, text)
    roots = classes_of(links)
    of = nodes.select("node", "r").join(roots, "node", "left")
    first = of.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r")).select(F.col("r.k").alias("kk"), F.col("r.h").alias("hh"))
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).isNull().alias("none"))
    kept = whole.where("not none").join(first, F.col("k").eqNullSafe(F.col("kk")) & (F.col("h") == F.col("hh")), "left_semi").dropDuplicates(["k", "h"])
    return kept.select("row").union(whole.where("none").select("row")).select("row.*")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_linked_texts, n_copies) of every row of `docs`.

    n_links counts the other rows whose texts are equal or similar, n_linked_texts the different texts
    that are similar, n_copies the rows with the same shingle set, the row itself included.
    """
    rows, nodes, links = linked(docs, key, text)
    counts = links.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_rows").alias("n_rows"))
    roots = classes_of(links)
    of = nodes.select("node", "copies", F.col("r.k").alias("k")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = of.groupBy("root").agg(F.min("k").alias("class_id"))
    known = of.join(classes, "root").join(counts, "node", "left").select("node", "class_id", "copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    out = rows.select("k", "h", "node").join(known, "node", "left")
    one = F.lit(1).cast("long")
    return out.select(
        F.col("k").alias(key), F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("copies", one) - 1 + F.coalesce("n_rows", F.lit(0))).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_linked_texts"), F.coalesce("copies", one).alias("n_copies"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


_WORDS = f"coalesce(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD}'), [])"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
sets AS (
    SELECT doc_id, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([array_to_string(w[p : p + {WORDS - 1}], ' ') FOR p IN range(1, len(w) - {WORDS - 2})])) END AS s FROM d
),
keyed AS (SELECT doc_id, s, CASE WHEN text IS NULL THEN 'null ' || doc_id WHEN len(s) = 0 THEN 'text ' || text ELSE 'set ' || sha256(array_to_string(s, chr(10))) END AS k FROM sets),
nodes AS (SELECT k, min(doc_id) AS id, count(*) AS copies, any_value(len(s)) AS n FROM keyed GROUP BY k),
items AS (SELECT DISTINCT id, n, unnest(s) AS x FROM keyed JOIN nodes USING (k)),
links AS (
    SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id
    GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9
),
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT l.a AS id, count(*) AS n_texts, sum(copies) AS n_rows FROM links l JOIN nodes ON nodes.id = l.b GROUP BY l.a)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(n_rows, 0) AS BIGINT) AS n_links, coalesce(n_texts, 0) AS n_linked_texts, copies AS n_copies
FROM keyed JOIN nodes USING (k) JOIN classes USING (id) LEFT JOIN counts USING (id)
"""
