"""Matches between two sides: bands, best states, cut spans, versions of utterances, speaker mapping, error rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.metrics import ratio
from colloquy.operators.intervals import merge_intervals, overlap_pairs


def band_pairs(df: DataFrame, within_us: int, id_col: str = "event_id", key: str = "corpus_id", at: str = "at_us") -> DataFrame:
    """(key, left_id, right_id, delta_us) of rows 0 < |delta| <= within_us apart, both ways, by bins of within_us."""
    bin_of = F.floor(F.col(at) / within_us)
    left = df.select(key, F.col(id_col).alias("left_id"), F.col(at).alias("l"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    right = df.select(key, F.col(id_col).alias("right_id"), F.col(at).alias("r"), bin_of.alias("bin"))
    delta = F.col("r") - F.col("l")
    return left.join(right, [key, "bin"]).where((delta != 0) & (F.abs(delta) <= within_us)).select(key, "left_id", "right_id", delta.alias("delta_us"))


def matching_states(references: DataFrame, states: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, reference_id, state_id, overlap_us): the state that overlaps most, ties to the nearer midpoint, then the smaller id.

    A reference that none overlaps gets the state with the nearest midpoint; without states, null.
    """
    pairs = overlap_pairs(references, states, bin_us, key)
    apart = F.abs(F.col("start_us_l") + F.col("end_us_l") - F.col("start_us_r") - F.col("end_us_r"))
    best = pairs.groupBy(key, F.col("interval_id_l").alias("reference_id")).agg(F.min(F.struct((-F.col("overlap_us")).alias("o"), apart.alias("a"), F.col("interval_id_r").alias("id"))).alias("b"))
    middle = F.col("start_us") + F.col("end_us")
    places = states.groupBy(key, middle.alias("m")).agg(F.min("interval_id").alias("s")).select(key, "m", "s", F.lit(None).cast("long").alias("r"), F.lit(0).alias("side"))
    both = places.union(references.select(key, middle, F.lit(None).cast("long"), F.col("interval_id"), F.lit(1)))
    w = Window.partitionBy(key).orderBy("m", "side")
    here = F.when(F.col("s").isNotNull(), F.struct("m", "s"))
    near = both.select(key, "m", "r", F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("n")).where("r is not null")
    to_p, to_n = F.col("m") - F.col("p.m"), F.col("n.m") - F.col("m")
    nearest = F.when(F.col("n").isNull() | (to_p < to_n), F.col("p.s")).when(F.col("p").isNull() | (to_n < to_p), F.col("n.s")).otherwise(F.least("p.s", "n.s"))
    out = near.select(key, F.col("r").alias("reference_id"), nearest.alias("nearest")).join(best, [key, "reference_id"], "left")
    return out.select(key, "reference_id", F.coalesce("b.id", "nearest").alias("state_id"), F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap_us"))


def cut_spans(segments: DataFrame, turns: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, segment_id, start_us, end_us, active): segments cut where turns begin or end, with the turns active in each piece."""
    pairs = overlap_pairs(segments, turns, bin_us, key)
    held = pairs.groupBy(key, F.col("interval_id_l").alias("interval_id")).agg(F.collect_list(F.struct(F.greatest("start_us_l", "start_us_r").alias("s"), F.least("end_us_l", "end_us_r").alias("e"))).alias("turns"))
    rows = segments.join(held, [key, "interval_id"], "left").withColumn("turns", F.coalesce("turns", F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)")))
    rows = rows.withColumn("cuts", F.expr("array_sort(array_distinct(concat(array(start_us, end_us), transform(turns, t -> t.s), transform(turns, t -> t.e))))"))
    piece = "transform(sequence(1, size(cuts) - 1), i -> struct(cuts[i - 1] as s, cuts[i] as e))"
    rows = rows.where("end_us > start_us").select(key, F.col("interval_id").alias("segment_id"), "turns", F.explode(F.expr(piece)).alias("p"))
    return rows.select(key, "segment_id", F.col("p.s").alias("start_us"), F.col("p.e").alias("end_us"), F.expr("cast(size(filter(turns, t -> t.s < p.e and t.e > p.s)) as bigint)").alias("active"))


def versions(old: DataFrame, new: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, old_id, new_id, tier, change) of word memberships (key, utterance_id, word_id) of two versions.

    Equal word sets are tier 3, sets that share words tier 2; of an old utterance all partners of its best
    tier stay. One with several partners is split, one whose partner has several is merged.
    """
    n_old = old.groupBy(key, F.col("utterance_id").alias("old_id")).agg(F.count("*").alias("n_old"))
    n_new = new.groupBy(key, F.col("utterance_id").alias("new_id")).agg(F.count("*").alias("n_new"))
    shared = old.select(key, F.col("utterance_id").alias("old_id"), "word_id").join(new.select(key, F.col("utterance_id").alias("new_id"), "word_id"), [key, "word_id"]).groupBy(key, "old_id", "new_id").agg(F.count("*").alias("n"))
    rows = shared.join(n_new, [key, "new_id"]).join(n_old, [key, "old_id"], "right").withColumn("tier", F.when((F.col("n") == F.col("n_old")) & (F.col("n") == F.col("n_new")), 3).when(F.col("n") > 0, 2))
    of_old, of_new = Window.partitionBy(key, "old_id"), Window.partitionBy(key, "new_id")
    rows = rows.withColumn("best", F.max("tier").over(of_old)).where("tier is null or tier = best")
    rows = rows.withColumn("to", F.count("new_id").over(of_old)).withColumn("from", F.count("old_id").over(of_new))
    change = F.when(F.col("new_id").isNull(), "removed").when(F.col("to") > 1, "split").when(F.col("from") > 1, "merged").when(F.col("tier") == 3, "unchanged").otherwise("one_to_one")
    return rows.select(key, "old_id", "new_id", F.col("tier").cast("long").alias("tier"), change.alias("change"))


def keyed_unions(df: DataFrame, label: str, key: str = "corpus_id") -> DataFrame:
    """The unions of each label's intervals: (key, label, start_us, end_us)."""
    both = df.select(F.struct(key, label).alias("k"), "start_us", "end_us")
    return merge_intervals(both, "k").select(F.col(f"k.{key}").alias(key), F.col(f"k.{label}").alias(label), "start_us", "end_us")


def co_activity(reference: DataFrame, system: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, system, reference, weight_us): how long each system label and reference label are active together."""
    pairs = overlap_pairs(keyed_unions(system, "label", key), keyed_unions(reference, "label", key), bin_us, key)
    return pairs.groupBy(key, F.col("label_l").alias("system"), F.col("label_r").alias("reference")).agg(F.sum("overlap_us").alias("weight_us"))


def assigned(weights: dict[tuple[str, str], int]) -> tuple[int, list[tuple[str, str]]]:
    """The one-to-one mapping of most weight and its pairs; of equal ones the first by sorted labels."""
    systems, references = sorted({s for s, _ in weights}), sorted({r for _, r in weights})
    best: dict[int, tuple[int, list[tuple[str, str]]]] = {0: (0, [])}  # references in use -> weight and pairs so far
    for s in systems:
        now = dict(best)
        for used, (total, pairs) in best.items():
            for k, r in enumerate(references):
                w = weights.get((s, r), 0)
                if w > 0 and not used >> k & 1:
                    new = used | 1 << k
                    held = now.get(new)
                    if held is None or total + w > held[0] or total + w == held[0] and [*pairs, (s, r)] < held[1]:
                        now[new] = (total + w, [*pairs, (s, r)])
        best = now
    return min(best.values(), key=lambda x: (-x[0], x[1]))


def assigned_many(weights: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    """The pairs of positive weight of a one-to-one mapping of most weight, by shortest augmenting paths: a time that grows with the cube of the labels."""
    systems, references = sorted({s for s, _ in weights}), sorted({r for _, r in weights})
    n = max(len(systems), len(references))
    cost = [[-weights.get((systems[i], references[j]), 0) if i < len(systems) and j < len(references) else 0 for j in range(n)] for i in range(n)]
    of_row, of_column, match = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # potentials, and each column's row; rows and columns count from 1
    for i in range(1, n + 1):
        match[0], column = i, 0
        far, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[column]:
            used[column] = True
            row, least, after = match[column], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    d = cost[row - 1][j - 1] - of_row[row] - of_column[j]
                    if d < far[j]:
                        far[j], way[j] = d, column
                    if far[j] < least:
                        least, after = far[j], j
            for j in range(n + 1):
                if used[j]:
                    of_row[match[j]] += least
                    of_column[j] -= least
                else:
                    far[j] -= least
            column = after
        while column:
            match[column] = match[way[column]]
            column = way[column]
    pairs = [(systems[match[j] - 1], references[j - 1]) for j in range(1, len(references) + 1) if match[j] <= len(systems)]
    return sorted(p for p in pairs if weights.get(p, 0) > 0)


def speaker_mapping(weights: DataFrame, key: str = "corpus_id", most: int = 12) -> DataFrame:
    """(key, system, reference, weight_us): the best one-to-one mapping of each recording.

    Of equal ones it is the first by sorted labels; over `most` labels on a side, whichever the search finds.
    Recordings stream past, sorted, a batch at a time; only one recording's labels are held besides.
    """
    columns = [key, "system", "reference", "weight_us"]

    def mapped(k, given: dict[tuple[str, str], int]) -> list[tuple]:
        many = max(len({p[side] for p in given}) for side in (0, 1)) > most
        return [(k, *p, given[p]) for p in (assigned_many(given) if many else assigned(given)[1])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, given, out = None, {}, []
        for part in parts:
            for k, system, reference, weight in part.itertuples(index=False, name=None):
                if given and k != now:
                    out += mapped(now, given)
                    given = {}
                now = k
                given[system, reference] = int(weight)
            yield pd.DataFrame(out, columns=columns)
            out = []
        if given:
            yield pd.DataFrame(mapped(now, given), columns=columns)

    kind = weights.schema[key].dataType.simpleString()
    rows = weights.where(F.col(key).isNotNull()).select(columns)
    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(run, f"{key} {kind}, system string, reference string, weight_us long")


def relabelled(system: DataFrame, mapping: DataFrame, key: str = "corpus_id", label: str = "label") -> DataFrame:
    """The system's rows with the reference's label that each label is mapped to; one without gets a label that no reference bears."""
    named = mapping.select(key, F.col("system").alias(label), "reference")
    free = F.concat(F.lit("unmapped: "), F.col(label))
    return system.join(named, [key, label], "left").withColumn(label, F.coalesce("reference", free)).drop("reference")


def error_components(reference: DataFrame, system: DataFrame, collar_us: int, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """Speaker time outside collars: reference, correct, missed, false alarm, confusion and their rate.

    `label` of both sides is a speaker after mapping; without one an interval counts for no speaker. Time is cut at
    every boundary; a piece lies within collar_us of a reference boundary or not.

    Intervals are shuffled once, by key; then steps up and down are added up along time, of each speaker, then
    of all, so nothing is joined, and intervals with equal bounds may come in any order. `bin_us` has no effect.
    """
    label, kind = reference.schema["label"].dataType.simpleString(), F.col("side")
    both = reference.select(key, F.col("label").cast(label).alias("label"), "start_us", "end_us", F.lit("r").alias("side")).union(system.select(key, "label", "start_us", "end_us", F.lit("s").alias("side"))).repartition(key)
    piece = lambda side, who, a, b: F.struct(side.alias("side"), who.alias("label"), F.array(F.struct(a.alias("at"), F.lit(1).alias("d")), F.struct(b.alias("at"), F.lit(-1).alias("d"))).alias("ends"), a.alias("a"), b.alias("b"))
    around = [piece(F.lit("c"), F.lit(None).cast(label), F.greatest(F.col(at) - collar_us, F.lit(0)), F.col(at) + collar_us) for at in ("start_us", "end_us")]
    own = piece(kind, F.col("label"), F.col("start_us"), F.col("end_us"))
    pieces = both.select(key, F.explode(F.when(kind == "r", F.array(own, *around)).otherwise(F.array(own))).alias("p")).where("p.b > p.a")
    steps = pieces.select(key, F.col("p.side").alias("side"), F.col("p.label").alias("label"), F.explode("p.ends").alias("x"))
    steps = steps.select(key, (kind == "c").alias("collar"), "label", F.col("x.at").alias("at"), F.when(kind != "s", F.col("x.d")).otherwise(0).alias("u"), F.when(kind == "s", F.col("x.d")).otherwise(0).alias("v"))
    steps = steps.groupBy(key, "collar", "label", "at").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    of = Window.partitionBy(key, "collar", "label").orderBy("at")
    up = of.rowsBetween(Window.unboundedPreceding, 0)
    # which of the reference (1, or a collar) and the system (2) is on from here, and was on before
    on = steps.select(key, "collar", "label", "at", ((F.sum("u").over(up) > 0).cast("int") + (F.sum("v").over(up) > 0).cast("int") * 2).alias("now"))
    on = on.withColumn("was", F.lag("now", 1, 0).over(of)).where("now <> was")
    voice, named = ~F.col("collar"), F.col("label").isNotNull()
    states = {"r": lambda x: x.bitwiseAND(1) > 0, "s": lambda x: x.bitwiseAND(2) > 0, "hit": lambda x: x == 3, "any": lambda x: x > 0, "c": lambda x: x > 0}
    counts = {n: ~voice if n == "c" else voice if n == "any" else voice & named for n in states}
    change = {n: F.when(counts[n], of_(F.col("now")).cast("int") - of_(F.col("was")).cast("int")).otherwise(0) for n, of_ in states.items()}
    moves = on.select(key, "at", *(c.alias(n) for n, c in change.items())).groupBy(key, "at").agg(*(F.sum(n).alias(n) for n in states))
    w = Window.partitionBy(key).orderBy("at")
    rows = moves.select(key, (F.lead("at").over(w) - F.col("at")).alias("len"), *(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in states)).where("len is not null and c = 0 and any > 0")
    n_r, n_s, hit, zero = F.col("r"), F.col("s"), F.col("hit"), F.lit(0)
    total = lambda n, name: F.sum(n * F.col("len")).alias(name)
    out = rows.groupBy(key).agg(total(n_r, "reference_us"), total(hit, "correct_us"), total(F.greatest(n_r - n_s, zero), "missed_us"), total(F.greatest(n_s - n_r, zero), "false_alarm_us"), total(F.least(n_r, n_s) - hit, "confusion_us"))
    return out.withColumn("der", ratio(F.col("missed_us") + F.col("false_alarm_us") + F.col("confusion_us"), F.col("reference_us")))


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of the cheapest alignment; of equal cost: fewest substitutions, then insertions.

    Equal words at both ends stand side by side in some such alignment, so only what lies between is compared.
    """
    low, least = 0, min(len(reference), len(hypothesis))
    while low < least and reference[low] == hypothesis[low]:
        low += 1
    high = 0
    while high < least - low and reference[-1 - high] == hypothesis[-1 - high]:
        high += 1
    reference, hypothesis = reference[low : len(reference) - high], hypothesis[low : len(hypothesis) - high]
    size = max(len(reference), len(hypothesis)) + 1
    base = 1 << max(15, size.bit_length())
    kind = np.int64 if base == 1 << 15 else object  # cost, substitutions, insertions, deletions in one number
    sub, ins, dele = base**3 + base**2, base**3 + base, base**3 + 1
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(w, len(ids)) for w in ws] for ws in (reference, hypothesis))
    b = np.array(b, np.int64)
    step = np.arange(len(b) + 1).astype(kind) * ins
    row = step.copy()
    for w in a:
        new = row + dele
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(b == w, 0, 1).astype(kind) * sub)
        row = np.minimum.accumulate(new - step) + step
    left = int(row[-1])
    deletions, insertions, substitutions = left % base, left // base % base, left // base**2 % base
    return substitutions, deletions, insertions


def word_errors(df: DataFrame, keys: list[str], reference: str, hypothesis: str) -> DataFrame:
    """(keys, n_words, substitutions, deletions, insertions, wer): texts by normalized words; wer is null without a reference word.

    Alignment with these ties is no built-in, so pairs are aligned in Arrow batches; nothing is shuffled.
    """
    from colloquy.functions.text import normalized_tokens

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "n_words long, substitutions long, deletions long, insertions long"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sides = [[normalized_tokens(t) for t in part[c]] for c in (reference, hypothesis)]
            counts = [edit_counts(a, b) for a, b in zip(*sides, strict=True)]
            out = part[keys].copy()
            out["n_words"] = [len(a) for a in sides[0]]
            for i, name in enumerate(("substitutions", "deletions", "insertions")):
                out[name] = [c[i] for c in counts]
            yield out

    rows = df.select(*keys, reference, hypothesis).mapInPandas(run, schema)
    errors: Column = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return rows.withColumn("wer", ratio(errors, F.col("n_words")))


def grouped_observations(observations: DataFrame, key: str = "corpus_id", least: float = 0.5, bonus: float = 0.05) -> DataFrame:
    """(key, label, group_id, n, score): observations of a type whose spans overlap by `least` of the longer, transitively.

    A key and type is cut where nothing reaches over: spans of two pieces never overlap. Pieces stream past, sorted,
    and no more than one is held; within it, a span meets only those that begin within the longest span before
    it. The score is the highest confidence, plus `bonus` if both methods agree, 1 at most.
    """

    def grouped(spans: list[tuple]) -> list[tuple]:
        """(group_id, n, score) of one piece's (start, end, id, confidence, method), by start."""
        longest, root, first = max(e - s for s, e, *_ in spans), list(range(len(spans))), 0

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, (s, e, *_) in enumerate(spans):
            while first < i and spans[first][0] + longest <= s:
                first += 1
            for j in range(first, i):
                both = min(e, spans[j][1]) - s
                if both > 0 and both >= least * max(e - s, spans[j][1] - spans[j][0]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        of: dict[int, list[tuple]] = {}
        for i, span in enumerate(spans):
            of.setdefault(find(i), []).append(span)
        return [(min(x[2] for x in g), len(g), round(min(1.0, max(x[3] for x in g) + (bonus if len({x[4] for x in g}) > 1 else 0.0)), 9)) for g in of.values()]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, now, held, out = [key, "label", "group_id", "n", "score"], None, [], []
        for part in parts:
            for k, label, piece, *span in part.itertuples(index=False, name=None):
                if now != (k, label, piece):
                    if held:
                        out += [(now[0], now[1], *g) for g in grouped(held)]
                    now, held = (k, label, piece), []
                held.append(tuple(span))
            yield pd.DataFrame(out, columns=columns)
            out = []
        if held:
            yield pd.DataFrame([(now[0], now[1], *g) for g in grouped(held)], columns=columns)

    w = Window.partitionBy(key, "label").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = observations.withColumn("fresh", F.when(F.col("start_us") < reach, 0).otherwise(1))
    pieces = cut.withColumn("piece", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "label", "piece", "start_us", "end_us", "interval_id", "confidence", "method")
    kind = observations.schema[key].dataType.simpleString()
    return pieces.repartition(key, "label", "piece").sortWithinPartitions(key, "label", "piece", "start_us", "interval_id").mapInPandas(run, f"{key} {kind}, label string, group_id long, n long, score double")
