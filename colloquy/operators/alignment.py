"""One-to-one matches of boundaries and spans of two sides, each within small independent groups.

Points further apart than a match may be never meet, so a recording is cut at such gaps and its pieces are
matched apart: a group is a number of pieces, however long the recording.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.intervals import overlap_pairs

#: How far apart boundaries match, and the least intersection over union of spans.
COLLAR_US, LEAST_IOU = 250_000, 0.5
#: Pieces of a recording that one group holds.
TOGETHER = 4096


def pieces(reference: DataFrame, system: DataFrame, reach_us: int, key: str, at: str) -> DataFrame:
    """(key, piece, side, at) of both sides' points, cut where none is within reach_us; side 0 is the reference."""
    both = reference.select(key, F.col(at).alias("at"), F.lit(0).alias("side")).union(system.select(key, F.col(at), F.lit(1)))
    w = Window.partitionBy(key).orderBy("at")
    cut = both.where("at is not null").withColumn("cut", (F.col("at") - F.lag("at").over(w) > reach_us).cast("int"))
    return cut.select(key, F.sum(F.coalesce("cut", F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("piece"), "side", "at")


def greedy_errors(reference: list[int], system: list[int], reach_us: int) -> list[int]:
    """Distances of matches: each system point, in order, takes the nearest free reference point, the smaller of two."""
    free, out = sorted(reference), []
    for p in sorted(system):
        i = bisect_left(free, p)
        near = [j for j in (bisect_left(free, free[i - 1]) if i else -1, i) if 0 <= j < len(free) and abs(free[j] - p) <= reach_us]
        if near:
            out.append(abs(free.pop(min(near, key=lambda j: (abs(free[j] - p), free[j]))) - p))
    return out


def best_errors(reference: list[int], system: list[int], reach_us: int) -> tuple[int, int]:
    """(matches, total distance) of the most matches in order, and of those the nearest."""
    r, s = np.sort(np.array(reference, np.int64)), np.sort(np.array(system, np.int64))
    one = min(len(r), len(s)) * reach_us + 1  # a match outweighs all distances
    best = np.zeros(len(s) + 1, np.int64)
    for p in r:
        error = np.abs(s - p)
        taken = np.where(error <= reach_us, best[:-1] + one - error, 0)
        best[1:] = np.maximum(best[1:], taken)
        best = np.maximum.accumulate(best)
    n = -(-int(best[-1]) // one)
    return n, n * one - int(best[-1])


def boundary_scores(reference: DataFrame, system: DataFrame, reach_us: int = COLLAR_US, key: str = "corpus_id", at: str = "at_us", best: bool = False) -> DataFrame:
    """(key, n_reference, n_system, matched, precision, recall, mean_error_us) of one-to-one matches within reach_us.

    Greedy in the system's order, or, if `best`, the most monotone matches with the least total distance.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece", kind="stable")
        piece, side, points = (rows[c].to_numpy() for c in ("piece", "side", "at"))
        ends = np.flatnonzero(np.r_[piece[1:] != piece[:-1], True]) + 1
        out = np.zeros(4, np.int64)
        for i, j in zip([0, *ends], ends):
            a, b = (points[i:j][side[i:j] == k].tolist() for k in (0, 1))
            n, total = best_errors(a, b, reach_us) if best else (len(e := greedy_errors(a, b, reach_us)), sum(e))
            out += len(a), len(b), n, total
        return pd.DataFrame({key: rows[key].iloc[:1].to_numpy(), **dict(zip("rsme", out[:, None]))})

    kind = reference.schema[key].dataType.simpleString()
    some = pieces(reference, system, reach_us, key, at).withColumn("some", F.floor(F.col("piece") / TOGETHER))
    found = some.groupBy(key, "some").applyInPandas(run, f"{key} {kind}, r long, s long, m long, e long")
    t = found.groupBy(key).agg(*(F.sum(c).alias(c) for c in "rsme"))
    return t.select(key, F.col("r").alias("n_reference"), F.col("s").alias("n_system"), F.col("m").alias("matched"), *(F.round(F.expr(f"try_divide({a}, {b})"), 9).alias(n) for a, b, n in (("m", "s", "precision"), ("m", "r", "recall"), ("e", "m", "mean_error_us"))))


def span_matches(reference: DataFrame, system: DataFrame, bin_us: int, least: float = LEAST_IOU, key: str = "corpus_id") -> DataFrame:
    """(key, reference_id, system_id, iou): pairs taken from the largest IoU down, ties to the larger ids, each span once.

    Spans with an IoU over a half overlap at one place, so a group holds only a key's close pairs.
    """
    p = overlap_pairs(reference, system, bin_us, key)
    iou = F.col("overlap_us") / (F.greatest("end_us_l", "end_us_r") - F.least("start_us_l", "start_us_r"))
    close = p.select(key, F.col("interval_id_l").alias("reference_id"), F.col("interval_id_r").alias("system_id"), iou.alias("iou")).where(F.col("iou") >= least)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["iou", "reference_id", "system_id"], ascending=False)
        used, kept = (set(), set()), []
        for a, b in zip(rows["reference_id"], rows["system_id"], strict=True):
            kept.append(new := a not in used[0] and b not in used[1])
            if new:
                used[0].add(a)
                used[1].add(b)
        return rows[kept]

    return close.groupBy(key).applyInPandas(run, close.schema)


def utterance_matches(reference: DataFrame, system: DataFrame, collar_us: int = COLLAR_US, bin_us: int = 60_000_000, key: str = "corpus_id") -> DataFrame:
    """(key, reference_id, system_id, words): each reference, in order of its id, takes the best free system utterance.

    Both sides are (key, utterance_id, word_id, start_us, end_us), a row a word. Candidates share words, overlap, or
    lie within the collar at both ends; most words count first, then the overlap, the ends' distance, the larger id.
    """

    def bounds(side: DataFrame) -> DataFrame:
        return side.groupBy(key, F.col("utterance_id").alias("interval_id")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))

    r, s = bounds(reference), bounds(system)
    shared = reference.select(key, "word_id", F.col("utterance_id").alias("reference_id")).join(system.select(key, "word_id", F.col("utterance_id").alias("system_id")), [key, "word_id"]).groupBy(key, "reference_id", "system_id").agg(F.count_distinct("word_id").alias("words"))
    wide = s.withColumn("start_us", F.col("start_us") - collar_us).withColumn("end_us", F.col("end_us") + collar_us + 1)
    near = overlap_pairs(r, wide, bin_us, key).select(key, F.col("interval_id_l").alias("reference_id"), F.col("interval_id_r").alias("system_id"))
    both = near.union(shared.select(key, "reference_id", "system_id")).distinct().join(shared, [key, "reference_id", "system_id"], "left")
    for side, rows in (("reference", r), ("system", s)):
        both = both.join(rows.select(key, F.col("interval_id").alias(f"{side}_id"), F.col("start_us").alias(f"{side}_s"), F.col("end_us").alias(f"{side}_e")), [key, f"{side}_id"])
    overlap = F.least("reference_e", "system_e") - F.greatest("reference_s", "system_s")
    start, end = F.abs(F.col("reference_s") - F.col("system_s")), F.abs(F.col("reference_e") - F.col("system_e"))
    words = F.coalesce("words", F.lit(0)).cast("long")
    fit = both.where((words > 0) | (overlap > 0) | ((start <= collar_us) & (end <= collar_us)))
    fit = fit.select(key, "reference_id", "system_id", words.alias("words"), F.greatest(overlap, F.lit(0)).alias("o"), (-start - end).alias("near"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["reference_id", "words", "o", "near", "system_id"], ascending=[True, False, False, False, False])
        used, last, kept = set(), None, []
        for a, b in zip(rows["reference_id"], rows["system_id"], strict=True):
            kept.append(new := a != last and b not in used)
            if new:
                last = a
                used.add(b)
        return rows.loc[kept, [key, "reference_id", "system_id", "words"]]

    kind = fit.schema
    return fit.groupBy(key).applyInPandas(run, f"{key} {kind[key].dataType.simpleString()}, reference_id {kind['reference_id'].dataType.simpleString()}, system_id {kind['system_id'].dataType.simpleString()}, words long")
