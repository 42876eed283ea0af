"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes; equal groups are exactly the repeated windows. The passes
go from the most significant digit on, and a pass keeps only suffixes that are not yet alone:

1. Anchor. A window's first digit is the smallest hash of its GRAM-byte strings, which equal windows
   have at equal offsets. Consecutive windows share it, so only one row per run of windows is shuffled.
   Frequent strings (`frequent`) come after all others, whatever their hash: a window has one as its
   anchor only if it holds nothing else, so what surrounds a common passage is told apart at once.
2. Run. Runs with equal anchors are told apart by the hash of all their bytes. Of equal runs all but
   the first are repeated throughout and need no further pass, so long repeats cost a row per run.
3. Bytes. Where different runs share an anchor, their windows are sorted by eight bytes at a time, most
   significant first, in numpy; groups of one drop out; those left after WINDOW bytes are equal.

Equal runs of a task are combined before they are shuffled, and frequent anchors' runs are dealt by their
own hash too. No other string makes up more than 1 in 2**SHARE of all, and EACH in each COMBINED bytes. Within an anchor, runs of equal
64-bit hashes count as equal.

Bytes of a window that occurred before (in a smaller doc_id, or earlier in the document) are removed;
what counts is the input, not what is left. Null texts are empty. Long texts are taken whole: a task reads
them one at a time. Rows with one doc_id and different texts are ordered by the texts' hashes, null doc_ids
come first, and repeated rows count as one document and get equal results; keys of any type that has an
order will do. Other columns are dropped, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import BASE, chunks, powers, remove, table, written

WINDOW, GRAM = 100, 16
#: Text that a task combines equal runs over, and that it counts strings over; counts from EACH on are told.
COMBINED, EACH = 1 << 23, 16
#: A string is frequent that occurs so often, and as one in 2**SHARE of all, so 2**SHARE at most are.
HOT, SHARE, SALTS = 256, 20, 64
#: Bytes of runs that pass 3 sorts at a time.
SORTED = 1 << 20

BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


class Frequent:
    """Hashes of frequent strings, with a bit map that answers most lookups."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self.mask = np.uint64((1 << max(16, len(self.sorted).bit_length() + 4)) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)
        self.some[self.sorted & self.mask] = True

    def mark(self, h: np.ndarray) -> np.ndarray:
        """`h` in 63 bits, the top bit set for frequent ones."""
        out = h >> np.uint64(1)
        if len(self.sorted):
            at = np.flatnonzero(self.some[h & self.mask])
            place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            out[at[self.sorted[place] == h[at]]] |= np.uint64(1 << 63)
        return out


def grams_of(raw: np.ndarray, gram: int) -> np.ndarray:
    h, have = BYTES[raw], 1
    while 2 * have <= gram:
        h = h[:-have] * np.uint64(pow(BASE, have, 1 << 64)) + h[have:]
        have *= 2
    if gram > have:
        h = h[: len(h) - (gram - have)] * np.uint64(pow(BASE, gram - have, 1 << 64)) + h[gram - have :]
    return mix(h)


def anchored(h: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each window, text of each window, whether a run begins there); windows stay within a text."""
    low = sliding_min(h, window - gram + 1)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    ok = np.arange(len(low)) + window <= ends[of]
    return low, of, np.r_[True, (low[1:] != low[:-1]) | (of[1:] != of[:-1])] & ok


def runs(texts: list[bytes], window: int = WINDOW, frequent: Frequent | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset, anchor, content) of every run of windows that share their anchor.

    offset: of the anchor's first occurrence in the first window. Texts follow each other in one buffer;
    windows that would reach into the next text are left out.
    """
    gram = min(GRAM, window)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if raw.size < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    h = (frequent or Frequent(np.zeros(0))).mark(grams_of(raw, gram))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    low, of, new = anchored(h, sizes, window, gram)
    start = np.flatnonzero(new)
    # a run ends before the next one and where windows stop fitting
    fit = np.maximum(ends[of[start]] - window + 1, 0)
    stop = np.minimum(np.r_[start[1:], len(low)], fit)
    grams = window - gram + 1

    def offsets(start: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(start), np.int64), np.arange(len(start))
        for k in range(grams):
            hit = h[start[left] + k] == low[start[left]]
            out[left[hit]] = k
            left = left[~hit]
            if not len(left):
                break
        return out

    offset = offsets(start)
    # an anchor that occurs again, as in periodic text: windows of a run share its first occurrence too
    if (many := np.flatnonzero(stop - start > offset + 1)).size:
        parts = []
        for i in many.tolist():
            at = np.arange(start[i], stop[i])
            places = start[i] + np.flatnonzero(h[start[i] : stop[i] + grams - 1] == low[start[i]])
            first = places[np.searchsorted(places, at)]
            parts.append(at[np.r_[True, first[1:] != first[:-1]]])
        ends_of = np.concatenate([np.r_[x[1:], stop[i]] for x, i in zip(parts, many.tolist(), strict=True)])
        keep = np.ones(len(start), bool)
        keep[many] = False
        start, stop = np.r_[start[keep], np.concatenate(parts)], np.r_[stop[keep], ends_of]
        offset = offsets(start)
    n = stop - start
    up, down = powers(1 << max(16, int(raw.size + 1).bit_length()))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: raw.size], dtype=np.uint64)]
    content = mix((sums[stop + window - 1] - sums[start]) * down[start] + (n * 256 + offset).astype(np.uint64) * np.uint64(BASE))
    begin = ends - sizes
    return of[start], start - begin[of[start]], n, offset, low[start], content


def pack(start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start << 16 | n << 8 | offset


ANCHORS = "again boolean, g long, r long, d long, at long"


def frequent_of(texts: DataFrame, window: int, hot: int = HOT, share: int = SHARE) -> Frequent:
    """Strings of GRAM bytes that occur at least `hot` times and as one in 2**share of all.

    A task counts all strings of COMBINED bytes at a time, by buckets first, and tells those with EACH or more.
    """
    gram = min(GRAM, window)
    buckets = np.uint64((1 << 22) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            h = np.concatenate(held)
            each = min(EACH, hot)
            place = (h & buckets).astype(np.int64)
            g, n = np.unique(h[np.bincount(place, minlength=int(buckets) + 1)[place] >= each], return_counts=True)
            g, n = g[n >= each], n[n >= each]
            return pa.record_batch([pa.array(np.r_[g.view(np.int64), 0]), pa.array(np.r_[n, len(h)]), pa.array(np.r_[np.zeros(len(g), bool), True])], ["g", "n", "total"])

        for batch in batches:
            for part in chunks(batch, 0, 1 << 18):
                raw = np.frombuffer(b"".join(part.column(0).cast(pa.binary()).to_pylist()), np.uint8)
                if raw.size >= gram:
                    held.append(grams_of(raw, gram))
                size += raw.size
                if size >= COMBINED:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    found = written(texts.select("t").mapInArrow(run, "g long, n long, total boolean").groupBy("g", "total").agg(F.sum("n").alias("n")).where(F.col("total") | (F.col("n") >= hot)), "suffix-frequent")
    total = found.where("total").first()
    least = max(hot, (total.n if total else 0) >> share)
    rows = found.where(~F.col("total") & (F.col("n") >= least)).select("g").toArrow()
    remove(found)
    return Frequent(rows["g"].to_numpy().view(np.uint64))


def anchors_of(texts: DataFrame, window: int, frequent: Frequent) -> DataFrame:
    """ANCHORS of (d, t): one row a run; again: it repeats another of its task. Negative g: a frequent string."""

    def combined(held: list) -> pa.RecordBatch:
        g, r, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, d, r, g))
        g, r, d, at = g[order], r[order], d[order], at[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
        return pa.record_batch([pa.array(x) for x in (~first, g.view(np.int64), r.view(np.int64), d, at)], ["again", "g", "r", "d", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, 1, 1 << 18):
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                of, start, n, offset, g, r = runs(raw, window, frequent)
                if len(g):
                    held.append((g, r, part.column(0).to_numpy()[of], pack(start, n, offset)))
                size += sum(map(len, raw))
                if size >= COMBINED and held:
                    yield combined(held)
                    held, size = [], 0
        if held:
            yield combined(held)

    return texts.select("d", "t").mapInArrow(run, ANCHORS)


def by_group(batches: Iterator[pa.RecordBatch], keys: int, enough, size_of=lambda b: b.num_rows) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted stream: rows equal in the first `keys` columns stay together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        same = held and all(h.column(k)[-1].as_py() == batch.column(k)[0].as_py() for h in held[-1:] for k in range(keys))
        cut = (int(new[-1]) if len(new) else 0) if same or len(new) else 0
        if held and not same and not len(new):
            if size >= enough:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        elif len(new) and size + size_of(batch) >= enough:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += size_of(batch)
    if held:
        yield pa.Table.from_batches(held)


FOUND = "removed boolean, g long, d long, at long"


def compared(anchors: DataFrame) -> DataFrame:
    """FOUND of runs: those that repeat an earlier run, and first ones that share an anchor with others.

    The rows of an anchor stream past: of those read so far only the first is held, until another run shows up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, alone = None, None  # the last row's (g, r), and the only different run of its anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            again = batch.column(0).to_numpy(zero_copy_only=False)
            g, r, d, at = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            old = last is not None and g[0] == last[0]
            fresh = np.r_[not old, g[1:] != g[:-1]]
            first = (fresh | np.r_[not (old and r[0] == last[1]), r[1:] != r[:-1]]) & ~again
            group = np.cumsum(fresh)  # 0: the group of the last batch's end
            kinds = np.bincount(group[first], minlength=group[-1] + 1)
            more = kinds > 1
            if old:
                more[0] = alone is None or kinds[0] > 0
            keep = ~first | more[group] | (g < 0)
            out = [x[keep] for x in (~first, g, d, at)]
            if old and alone is not None and more[0]:
                out = [np.r_[a, x] for a, x in zip(alone, out, strict=True)]
            if group[-1] > 0 or not old:
                alone = None
                held = np.flatnonzero(first & (group == group[-1]))  # the last group may go on
                if not more[group[-1]] and len(held) and g[-1] >= 0:
                    alone = (False, g[held[0]], d[held[0]], at[held[0]])
            elif more[0]:
                alone = None
            last = (g[-1], r[-1])
            yield pa.record_batch([pa.array(out[0].astype(bool)), *(pa.array(x) for x in out[1:])], ["removed", "g", "d", "at"])

    # what repeats a run of its task needs no other row: it goes by its document, behind the others of its anchor
    rows = anchors.withColumn("salt", F.when(F.col("again"), SALTS + F.pmod("d", F.lit(1 << 20))).when(F.col("g") < 0, F.pmod("r", F.lit(SALTS))).otherwise(0))
    return rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "r", "again", "d", "at").select("again", "g", "r", "d", "at").mapInArrow(run, FOUND)


SHARED = "g long, d long, at long, b binary"


def slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings raw[start : start + size] as an Arrow array."""
    ends = np.cumsum(size)
    data = raw[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def bytes_of(runs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """SHARED of each run that shares an anchor: its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                g, at = (part.column(2).flatten().field(k).to_numpy() for k in (0, 1))
                of = np.repeat(np.arange(len(texts)), pc.list_value_length(part.column(2)).to_numpy())
                sizes = np.array([len(t) for t in texts], np.int64)
                begin = (np.cumsum(sizes) - sizes)[of] + (at >> 16)
                b = slices(np.frombuffer(b"".join(texts), np.uint8), begin, (at >> 8 & 255) + window - 1)
                yield pa.record_batch([pa.array(g), pa.array(part.column(0).to_numpy()[of]), pa.array(at), b], ["g", "d", "at", "b"])

    per = runs.where("not removed").groupBy("d").agg(F.collect_list(F.struct("g", "at")).alias("part"))
    return texts.join(per, "d").select("d", "t", "part").mapInArrow(run, SHARED)


def equal_windows(group: np.ndarray, place: np.ndarray, raw: np.ndarray, window: int) -> list[np.ndarray]:
    """Radix sort of suffixes from the most significant digit: indexes of windows, a value for each equal class.

    `place` is where a window begins in `raw`; windows of different groups are never equal.
    """
    words = np.zeros(len(raw) + 8, np.uint8)
    words[: len(raw)] = raw
    index, label = np.arange(len(place)), group.astype(np.int64)
    for at in range(0, window, 8):
        at = min(at, window - 8) if window >= 8 else 0
        digit = np.zeros(len(index), np.uint64)
        for k in range(min(8, window)):
            digit = digit << np.uint64(8) | words[place[index] + at + k].astype(np.uint64)
        order = np.lexsort((digit, label))
        index, label, digit = index[order], label[order], digit[order]
        new = np.r_[True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])]
        label = np.cumsum(new) - 1
        more = np.bincount(label)[label] > 1
        index, label = index[more], label[more]
        if not len(index):
            break
    return [index, label]


REMOVED = "d long, at long"


def sorted_windows(shared: DataFrame, window: int) -> DataFrame:
    """REMOVED: windows of SHARED that equal an earlier one, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group((p for b in batches for p in chunks(b, 3)), 1, SORTED, lambda b: b.column(3).nbytes):
            g, d, at = (rows[c].to_numpy() for c in ("g", "d", "at"))
            group = np.cumsum(np.r_[True, g[1:] != g[:-1]])
            bs = rows["b"].to_pylist()
            n = at >> 8 & 255
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sizes = np.array([len(b) for b in bs])
            place = (np.cumsum(sizes) - sizes)[which] + k
            index, label = equal_windows(group[which], place, np.frombuffer(b"".join(bs), np.uint8), window)
            if not len(index):
                continue
            dd, start = d[which][index], (at >> 16)[which][index] + k[index]
            order = np.lexsort((start, dd, label))
            later = np.r_[False, label[order][1:] == label[order][:-1]]
            dd, start = dd[order][later], start[order][later]
            order = np.lexsort((start, dd))
            dd, start = dd[order], start[order]
            new = np.flatnonzero(np.r_[True, (dd[1:] != dd[:-1]) | (start[1:] != start[:-1] + 1)])
            count = np.diff(np.r_[new, len(dd)])
            while (count > 255).any():  # as many as a run can hold
                new = np.unique(np.r_[new, new[count > 255] + 255])
                count = np.diff(np.r_[new, len(dd)])
            yield pa.record_batch([pa.array(dd[new]), pa.array(pack(start[new], count, np.zeros(len(new), np.int64)))], ["d", "at"])

    return shared.repartition("g").sortWithinPartitions("g").mapInArrow(run, REMOVED)


def spans_of(ats: list[int] | np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal [begin, end) that runs of repeated windows cover."""
    ats = np.sort(np.asarray(ats, np.int64))
    begin, end = ats >> 16, (ats >> 16) + (ats >> 8 & 255) + window - 1
    if not len(ats):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), reach[np.r_[new[1:] - 1, len(ats) - 1]].tolist(), strict=True))


def repeated(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, t, ats) of (d, t) with distinct d: ats are the runs of windows that occurred before, or null.

    Both joins of texts are on d in one plan, so that Spark shuffles the texts once.
    """
    found = written(compared(anchors_of(texts, window, frequent_of(texts, window, HOT))), "suffix-runs")
    again = found.where("removed").select("d", "at").union(sorted_windows(bytes_of(found, texts, window), window))
    return texts.join(again.groupBy("d").agg(F.collect_list("at").alias("ats")), "d", "left").select("d", "t", "ats")


def ordered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """((d, t), None) where keys are distinct integers; else d numbers the distinct rows in order, beside (d, k, h, n)."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    whole = isinstance(docs.schema[key].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    if whole and rows.groupBy("k").count().where("count > 1 or k is null").limit(1).count() == 0:
        return rows.where("k is not null").select(F.col("k").cast("long").alias("d"), "t"), None
    rows = rows.withColumn("h", F.xxhash64("t"))
    numbers = rows.groupBy("k", "h").agg(F.count("*").alias("n")).orderBy(F.col("k").asc_nulls_first(), "h")
    numbers = written(numbers.select("k", "h", F.monotonically_increasing_id().alias("d"), "n"), "suffix-order")
    on = rows.k.eqNullSafe(numbers.k) & (rows.h == numbers.h)
    return written(rows.join(numbers, on).select("d", "t").dropDuplicates(["d"]), "suffix-texts").where("d is not null"), numbers


RESULT = [("kept", T.BinaryType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("n_bytes", T.LongType()), ("n_removed", T.LongType())]


def cut(texts: DataFrame, window: int, as_text: bool = False) -> DataFrame:
    """(d, *RESULT) of (d, t); as_text: kept is a string without the characters that lost a byte."""
    kind = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                kept, spans, sizes, gone = [], [], [], []
                for t, ats in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2), strict=True):
                    found = spans_of(ats.values.to_numpy() if ats.is_valid else [], window)
                    at, left = 0, []
                    for a, b in found:
                        left.append(t[at:a])
                        at = b
                    left.append(t[at:])
                    kept.append(b"".join(left))
                    spans.append([list(x) for x in found])
                    sizes.append(len(t))
                    gone.append(len(t) - len(kept[-1]))
                if as_text:
                    kept = [k.decode(errors="ignore") for k in kept]
                yield pa.record_batch([part.column(0), pa.array(kept, kind), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["d", *(n for n, _ in RESULT)])

    return repeated(texts, window).mapInArrow(run, T.StructType([T.StructField("d", T.LongType()), *(T.StructField(n, T.StringType() if as_text and n == "kept" else t) for n, t in RESULT)]))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, kept, spans, n_bytes, n_removed) of every row of `docs`: kept holds the remaining bytes, spans the removed [begin, end)."""
    texts, numbers = ordered(docs, key, text)
    out = cut(texts, window)
    if numbers is None:
        return out.select(F.col("d").cast(docs.schema[key].dataType).alias(key), *(n for n, _ in RESULT))
    names = numbers.select("d", "k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
    return names.join(out, "d").select(F.col("k").alias(key), *(n for n, _ in RESULT))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """`docs` with the repeated bytes gone from `text`, and its characters counted anew in `size`.

    A character that lost a byte goes whole. Null texts stay null, and every row stays; columns may have any names.
    """
    texts, numbers = ordered(docs, key, text)
    out = cut(texts, window, as_text=True).select("d", "kept")
    h = F.xxhash64(F.coalesce(text, F.lit(""))) if numbers is not None else F.lit(None)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).isNull().alias("none"), F.col(key).alias("key"), h.alias("hash"))
    if numbers is None:
        both = rows.join(out, F.col("key").cast("long") == F.col("d"))
    else:
        both = rows.join(out.join(numbers, "d"), F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")))
    kept = F.when(~F.col("none"), F.col("kept"))
    of = {c: F.col("row")[c] for c in docs.columns if c != text} | {text: kept}
    if size in docs.columns and size != key:
        of[size] = F.coalesce(F.length(kept).cast(docs.schema[size].dataType), F.col("row")[size])
    return both.select(*(of[c].alias(c) for c in docs.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
