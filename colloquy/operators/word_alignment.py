"""Alignment of two texts' words, row by row, and error rates by stratum and by version that rest on it.

The cheapest alignment, of those the one with the fewest substitutions, then insertions, as `edit_counts`
has it. Words are normalized tokens; a null text has none. Pairs are aligned in the tasks that hold them,
by halves in memory linear in their length; nothing is shuffled before rates are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.metrics import ratio
from colloquy.functions.text import normalized_tokens
from colloquy.operators.intervals import overlap_pairs

MATCH, SUBSTITUTION, DELETION, INSERTION = "match", "substitution", "deletion", "insertion"
#: Cells of a table that is kept whole; larger ones are halved.
CELLS = 1 << 18
#: Pairs whose steps make one batch.
PAIRS = 256


class Costs:
    """Cost, substitutions, insertions and deletions in one number, so that sums compare in that order."""

    def __init__(self, size: int):
        base = 1 << max(15, (size + 1).bit_length())
        self.kind = np.int64 if base == 1 << 15 else object  # beyond 32,767 words Python's integers
        self.sub, self.ins, self.dele = base**3 + base**2, base**3 + base, base**3 + 1

    def first(self, m: int) -> np.ndarray:
        return np.arange(m + 1).astype(self.kind) * self.ins

    def next(self, row: np.ndarray, word: int, b: np.ndarray, step: np.ndarray) -> np.ndarray:
        new = row + self.dele
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(b == word, 0, 1).astype(self.kind) * self.sub)
        return np.minimum.accumulate(new - step) + step

    def last(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = row = self.first(len(b))
        for word in a:
            row = self.next(row, word, b, step)
        return row


def pairs(a: np.ndarray, b: np.ndarray, costs: Costs) -> list[tuple[int | None, int | None]]:
    """Places that stand side by side, in order; None on one side where the other's word has no partner.

    Of alignments that tie in all counts, each half takes the first place to divide, and a table's way back
    prefers a pair, then a deletion.
    """
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i0, i1, j0, j1 = work.pop()
        tail = []
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:  # equal ends belong together in some cheapest alignment
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            tail.append((i1, j1))
        if tail:
            work.append((tail[-1][0], tail[0][0] + 1, tail[-1][1], tail[0][1] + 1))
        n, m = i1 - i0, j1 - j0
        if n == 0 or m == 0:
            out += [(i, None) for i in range(i0, i1)] + [(None, j) for j in range(j0, j1)]
        elif n * m <= CELLS or n == 1:
            out += table(a[i0:i1], b[j0:j1], costs, i0, j0)
        else:
            half = (i0 + i1) // 2
            total = costs.last(a[i0:half], b[j0:j1]) + costs.last(a[half:i1][::-1], b[j0:j1][::-1])[::-1]
            cut = j0 + int(np.argmin(total))
            work += [(half, i1, cut, j1), (i0, half, j0, cut)]
    return out


def table(a: np.ndarray, b: np.ndarray, costs: Costs, i0: int, j0: int) -> list[tuple[int | None, int | None]]:
    step = costs.first(len(b))
    rows = [step]
    for word in a:
        rows.append(costs.next(rows[-1], word, b, step))
    i, j, back = len(a), len(b), []
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else costs.sub):
            i, j = i - 1, j - 1
            back.append((i0 + i, j0 + j))
        elif i and here == rows[i - 1][j] + costs.dele:
            i -= 1
            back.append((i0 + i, None))
        else:
            j -= 1
            back.append((None, j0 + j))
    return back[::-1]


def aligned(reference: list[str], hypothesis: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(op, place in reference, place in hypothesis) of each step, in order."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64) for ws in (reference, hypothesis))
    steps = pairs(a, b, Costs(max(len(a), len(b))))

    def op(i: int | None, j: int | None) -> str:
        return DELETION if j is None else INSERTION if i is None else MATCH if a[i] == b[j] else SUBSTITUTION

    return [(op(i, j), i, j) for i, j in steps]


def word_rows(df: DataFrame, keys: list[str], reference: str, hypothesis: str) -> DataFrame:
    """(keys, step, op, ref_no, hyp_no, ref_word, hyp_word): a row for each step of each pair's alignment.

    Steps, and words on each side, are numbered from 0. Pairs without words on both sides give no row.
    """
    kinds = {"step": pa.int32(), "op": pa.string(), "ref_no": pa.int32(), "hyp_no": pa.int32(), "ref_word": pa.string(), "hyp_word": pa.string()}
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, T.StringType() if k == pa.string() else T.IntegerType()) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                at, out = [], [[] for _ in kinds]
                for i, texts in enumerate(zip(*(part.column(len(keys) + side).to_pylist() for side in (0, 1)), strict=True)):
                    a, b = map(normalized_tokens, texts)
                    for step, (op, r, h) in enumerate(aligned(a, b)):
                        at.append(i)
                        for column, value in zip(out, (step, op, r, h, None if r is None else a[r], None if h is None else b[h]), strict=True):
                            column.append(value)
                yield pa.record_batch([*(c.take(pa.array(at, pa.int64())) for c in part.columns[: len(keys)]), *(pa.array(column, kind) for column, kind in zip(out, kinds.values(), strict=True))], [*keys, *kinds])

    return df.select(*keys, reference, hypothesis).mapInArrow(run, schema)


def op_counts() -> list[Column]:
    return [F.count_if(F.col("op") == op).alias(name) for op, name in ((MATCH, "matches"), (SUBSTITUTION, "substitutions"), (DELETION, "deletions"), (INSERTION, "insertions"))]


def rated(counts: DataFrame) -> DataFrame:
    """`counts` with n_words and wer; the rate is null without a reference word."""
    n = F.col("matches") + F.col("substitutions") + F.col("deletions")
    return counts.withColumn("n_words", n).withColumn("wer", ratio(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("n_words")))


def stratified_wer(df: DataFrame, keys: list[str], reference: str, hypothesis: str, tags: str, by: list[str] | None = None) -> DataFrame:
    """(by, tag, n_segments, matches, substitutions, deletions, insertions, n_words, wer): rates of the segments with each tag.

    A segment is a row of `keys`; it counts once for each distinct tag, and for none where tags are null or
    empty. A null tag is a stratum of its own. Each segment is aligned once, whatever its tags.
    """
    by = by or []
    per = word_rows(df, keys, reference, hypothesis).groupBy(*keys).agg(*op_counts())
    strata = df.select(*keys, *(c for c in by if c not in keys), F.explode(F.array_distinct(tags)).alias("tag"))
    both = strata.join(per, keys, "left")
    names = ["matches", "substitutions", "deletions", "insertions"]
    return rated(both.groupBy(*by, "tag").agg(F.count("*").alias("n_segments"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)))


def correction_impact(df: DataFrame, keys: list[str], reference: str, original: str, corrected: str, by: list[str]) -> DataFrame:
    """(by, n_words, errors_before, errors_after, wer_before, wer_after, wer_change) of two versions of each segment.

    A null version counts as empty. Rates are null without a reference word, their change then 0.
    """
    names = ["matches", "substitutions", "deletions", "insertions"]
    both = df.select(*keys, F.col(reference).alias("r"), F.explode(F.array(F.struct(F.lit("before").alias("version"), F.col(original).alias("h")), F.struct(F.lit("after").alias("version"), F.col(corrected).alias("h")))).alias("v")).select(*keys, "r", "v.*")
    rows = word_rows(both, [*keys, "version"], "r", "h")
    counted = rows.groupBy(*by).agg(*(F.count_if((F.col("version") == v) & (F.col("op") == op)).alias(f"{name}_{v}") for v in ("before", "after") for name, op in zip(names, (MATCH, SUBSTITUTION, DELETION, INSERTION), strict=True)))
    n = F.col("matches_before") + F.col("substitutions_before") + F.col("deletions_before")

    def errors(v: str) -> Column:
        return F.col(f"substitutions_{v}") + F.col(f"deletions_{v}") + F.col(f"insertions_{v}")

    out = df.select(*by).distinct().join(counted.select(*by, n.alias("n_words"), errors("before").alias("errors_before"), errors("after").alias("errors_after")), by, "left").na.fill(0, ["n_words", "errors_before", "errors_after"])
    out = out.withColumn("wer_before", ratio(F.col("errors_before"), F.col("n_words"))).withColumn("wer_after", ratio(F.col("errors_after"), F.col("n_words")))
    return out.withColumn("wer_change", F.round(F.coalesce(F.try_divide(F.col("errors_after") - F.col("errors_before"), F.col("n_words")), F.lit(0.0)), 9))


def overlapping_states(states: DataFrame, references: DataFrame, bin_us: int, key: str = "corpus_id", state: str = "segment_id") -> DataFrame:
    """The states that share an instant with any reference, each once."""
    met = overlap_pairs(states.select(key, state, "start_us", "end_us"), references.select(key, "start_us", "end_us"), bin_us, key)
    return states.join(met.select(key, F.col(f"{state}_l").alias(state)).distinct(), [key, state], "left_semi")
