"""What a reviewer is shown: exclusive candidates, repairs of turns, interruptions, conflicts, clips and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.intervals import elementary_intervals, overlap_pairs

#: The score that selects, the difference that tells exclusive candidates apart, selections a key.
SELECTED, MARGIN, SELECTIONS = 0.8, 0.15, 12
#: Fixed values, in microseconds: distance to a word's edge, gap of a takeover, gap and length of a clip.
EDGE_US, TAKEOVER_US, CLIP_GAP_US, CLIP_US = 150_000, 250_000, 300_000, 30_000_000
#: What precedes the labels of overlapping speech.
OVERLAP = "OVERLAP: "


def exclusive_pairs(candidates: DataFrame, exclusive: list[list[str]], bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, left_id, right_id, left_score, right_score): overlapping candidates of one group of labels, or one of them `unknown`."""
    p = overlap_pairs(candidates, candidates, bin_us, key).where("interval_id_l < interval_id_r")
    one_unknown = (F.col("label_l") == "unknown") != (F.col("label_r") == "unknown")
    same = F.lit(False)
    for group in exclusive:
        same = same | (F.col("label_l").isin(group) & F.col("label_r").isin(group))
    return p.where(one_unknown | same).select(key, F.col("interval_id_l").alias("left_id"), F.col("interval_id_r").alias("right_id"), F.col("score_l").alias("left_score"), F.col("score_r").alias("right_score"))


def dispositions(candidates: DataFrame, pairs: DataFrame, key: str = "corpus_id", least: float = SELECTED, margin: float = MARGIN, most: int = SELECTIONS) -> DataFrame:
    """(key, interval_id, disposition): selected from `least` on, else deferred; then what the exclusive pairs say.

    Pairs of two selected ones: closer than `margin` both are unresolved, else the weaker is rejected; the last
    pair that says something of a candidate counts. Beyond `most` selected ones of a key the rest is deferred.
    """
    p = pairs.where(F.least("left_score", "right_score") >= least)
    close = F.round(F.abs(F.col("left_score") - F.col("right_score")), 9) < margin
    said = F.array(
        F.struct(F.col("left_id").alias("interval_id"), F.when(close, "unresolved").when(F.col("left_score") <= F.col("right_score"), "rejected").alias("says")),
        F.struct(F.col("right_id").alias("interval_id"), F.when(close, "unresolved").when(F.col("left_score") > F.col("right_score"), "rejected").alias("says")),
    )
    of = p.select(key, F.struct("left_id", "right_id").alias("at"), F.explode(said).alias("s")).select(key, "at", "s.*").where("says is not null")
    last = of.groupBy(key, "interval_id").agg(F.max_by("says", "at").alias("says"))
    rows = candidates.join(last, [key, "interval_id"], "left").withColumn("d", F.coalesce("says", F.when(F.col("score") >= least, "selected").otherwise("deferred")))
    place = F.row_number().over(Window.partitionBy(key, "d").orderBy(F.desc("score"), "interval_id"))
    return rows.withColumn("k", place).select(key, "interval_id", F.when((F.col("d") == "selected") & (F.col("k") > most), "deferred").otherwise(F.col("d")).alias("disposition"))


def turn_repairs(words: DataFrame, boundaries: DataFrame, bin_us: int, edge_us: int = EDGE_US, key: str = "corpus_id") -> DataFrame:
    """(key, at_us, pos, word_no, action, position_us) of boundaries (key, at_us, overlapped) strictly inside a word.

    An overlapped one keeps both speakers; else it moves to the nearer edge, the earlier of two, if that is
    within edge_us, and stays unresolved beyond. Words and boundaries meet by bins.
    """
    b = boundaries.select(key, "at_us", "overlapped", F.floor(F.col("at_us") / bin_us).alias("bin"))
    w = words.select(key, "pos", "word_no", "start_us", "end_us", F.explode(F.sequence(F.floor(F.col("start_us") / bin_us), F.floor(F.col("end_us") / bin_us))).alias("bin"))
    met = w.join(b, [key, "bin"]).where("start_us < at_us and at_us < end_us")
    edge = F.when(F.col("at_us") - F.col("start_us") <= F.col("end_us") - F.col("at_us"), F.col("start_us")).otherwise(F.col("end_us"))
    action = F.when(F.col("overlapped"), "preserve_mixed_speaker_interval").when(F.abs(edge - F.col("at_us")) <= edge_us, "move_boundary").otherwise("mark_unresolved")
    return met.select(key, "at_us", "pos", "word_no", action.alias("action"), F.when(action == "move_boundary", edge).alias("position_us"))


def overlap_projection(u: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, start_us, end_us, affected): pieces in which several utterances last, with (start, pos, speaker, end) of each, in order."""
    many = elementary_intervals(u, key).where("active > 1").select(key, "start_us", "end_us")
    p = overlap_pairs(many, u.select(key, "pos", "speaker", "start_us", "end_us"), bin_us, key)
    each = F.struct(F.col("start_us_r").alias("s"), F.col("pos_r").alias("pos"), F.col("speaker_r").alias("speaker"), F.col("end_us_r").alias("e"))
    return p.groupBy(key, F.col("start_us_l").alias("start_us"), F.col("end_us_l").alias("end_us")).agg(F.array_sort(F.collect_list(each)).alias("affected"))


def interruptions(u: DataFrame, bin_us: int, gap_us: int = TAKEOVER_US, key: str = "corpus_id") -> DataFrame:
    """(key, interrupted, interrupting, kind, onset_us, continues): by overlaps, and by quick takeovers of cut-off utterances.

    Of an overlap's utterances the first two by start count; speakers tell whether it is sure. A takeover is by
    another speaker, from 0 to gap_us after a text that ends in a dash or an ellipsis, where no overlap holds both alone.
    """
    o = overlap_projection(u, bin_us, key).withColumn("a", F.col("affected")[0]).withColumn("b", F.col("affected")[1])
    sure = F.col("a.speaker").isNotNull() & F.col("b.speaker").isNotNull() & (F.col("a.speaker") != F.col("b.speaker"))
    by_overlap = o.select(key, F.col("a.pos").alias("interrupted"), F.col("b.pos").alias("interrupting"), F.when(sure, "actual_simultaneous").otherwise("uncertain").alias("kind"), F.greatest("a.s", "b.s").alias("onset_us"), (F.col("a.e") > F.col("b.s")).alias("continues"))
    w = Window.partitionBy(key).orderBy("start_us", "pos")
    n = u.select(key, "pos", "speaker", "text", "end_us", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("pos", "speaker", "start_us")))
    cut_off = F.rtrim("text").rlike(r"(\.\.\.|…|[-—–])$")
    n = n.where(cut_off & (F.col("next_start_us") - F.col("end_us")).between(0, gap_us) & F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("next_speaker")))
    taken = n.select(key, F.col("pos").alias("interrupted"), F.col("next_pos").alias("interrupting"), F.lit("immediate_turn_takeover").alias("kind"), F.col("next_start_us").alias("onset_us"), F.lit(False).alias("continues"))
    pairs = o.where(F.size("affected") == 2).select(key, F.col("a.pos").alias("interrupted"), F.col("b.pos").alias("interrupting")).distinct()
    return by_overlap.union(taken.join(pairs, [key, "interrupted", "interrupting"], "left_anti"))


def self_conflicts(rows: DataFrame, bin_us: int, key: str = "corpus_id", label: str = "label") -> DataFrame:
    """(key, label, left_id, right_id, overlap_us): one label's intervals that last at one time; the label joins, so bins are small."""
    named = rows.where(F.col(label).isNotNull()).withColumn("who", F.struct(key, label))
    p = overlap_pairs(named.select("who", "interval_id", "start_us", "end_us"), named.select("who", "interval_id", "start_us", "end_us"), bin_us, "who")
    return p.where("interval_id_l < interval_id_r").select(F.col(f"who.{key}").alias(key), F.col(f"who.{label}").alias("label"), F.col("interval_id_l").alias("left_id"), F.col("interval_id_r").alias("right_id"), "overlap_us")


def agreed(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): what all known members of a group agree on, else null; by partial aggregation."""
    low, high = F.min(value), F.max(value)
    return members.groupBy(*keys).agg(F.when(low == high, low).alias(value))


def aliases(rows: DataFrame, exact: list[str], owner: Column, id_col: str = "interval_id") -> DataFrame:
    """(id, canonical_id): each row beside the smallest owner with the same exact key; null where none owns it."""
    owners = rows.where(owner).groupBy(*exact).agg(F.min(id_col).alias("canonical_id"))
    return rows.where(~owner).join(owners, exact, "left").select(id_col, "canonical_id")


def clips(speech: DataFrame, gap_us: int = CLIP_GAP_US, longest_us: int = CLIP_US, key: str = "corpus_id") -> DataFrame:
    """(key, start_us, end_us, n): speech merged over gaps of at most gap_us while a clip lasts longest_us at most, then cut at that.

    Gaps cut a recording into runs first, so the fold that knows a clip's start is over one run.
    """
    w = Window.partitionBy(key).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = speech.select(key, "start_us", "end_us").withColumn("cut", F.when(F.col("start_us") - reach <= gap_us, 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(F.col("start_us").alias("s"), F.col("end_us").alias("e")))).alias("xs"))
    fold = f"""aggregate(xs, named_struct('done', cast(array() as array<struct<s: bigint, e: bigint, n: bigint>>), 's', cast(null as bigint), 'e', cast(null as bigint), 'n', 0L),
      (a, x) -> if(a.s is not null and x.s - a.e <= {gap_us} and x.e - a.s <= {longest_us}, named_struct('done', a.done, 's', a.s, 'e', greatest(a.e, x.e), 'n', a.n + 1L),
        named_struct('done', if(a.s is null, a.done, concat(a.done, array(struct(a.s as s, a.e as e, a.n as n)))), 's', x.s, 'e', x.e, 'n', 1L)),
      a -> concat(a.done, array(struct(a.s as s, a.e as e, a.n as n))))"""
    merged = runs.select(key, F.explode(F.expr(fold)).alias("c")).select(key, "c.*").where("e > s")
    cut = merged.withColumn("at", F.explode(F.expr(f"sequence(s, e - 1, {longest_us}L)")))
    return cut.select(key, F.col("at").alias("start_us"), F.least(F.col("at") + longest_us, F.col("e")).alias("end_us"), "n")


def clip_segments(clips: DataFrame, segments: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, clip_us, segments): how many segments overlap each clip most, ties to the earlier; 0 for clips that none does."""
    p = overlap_pairs(segments, clips.withColumn("interval_id", F.col("start_us")), bin_us, key)
    best = p.groupBy(key, "interval_id_l").agg(F.min(F.struct((-F.col("overlap_us")).alias("o"), F.col("start_us_r").alias("clip"))).alias("b"))
    n = best.groupBy(key, F.col("b.clip").alias("clip_us")).agg(F.count("*").alias("segments"))
    return clips.select(key, F.col("start_us").alias("clip_us")).join(n, [key, "clip_us"], "left").fillna(0, ["segments"])


def speaker_labels(u: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, start_us, end_us, label): elementary pieces of speech with their speakers, `UNATTRIBUTED` without one, overlap disclosed."""
    p = overlap_pairs(elementary_intervals(u, key).where("active > 0").select(key, "start_us", "end_us"), u.select(key, "pos", "speaker", "start_us", "end_us"), bin_us, key)
    who = F.struct(F.col("start_us_r"), F.col("pos_r"), F.coalesce("speaker_r", F.lit("UNATTRIBUTED")).alias("who"))
    each = p.groupBy(key, F.col("start_us_l").alias("start_us"), F.col("end_us_l").alias("end_us")).agg(F.array_sort(F.collect_list(who)).alias("ws"))
    names = F.array_join(F.array_distinct(F.transform("ws", lambda x: x["who"])), " | ")
    return each.select(key, "start_us", "end_us", F.concat(F.when(F.size("ws") > 1, OVERLAP).otherwise(""), names).alias("label"))


def voice_result(score: Column, supports: float, weakly: float, contradicts: float, weakly_contradicts: float) -> Column:
    """Bands of a comparison's score; support is tested first."""
    return F.when(score >= supports, "supports").when(score >= weakly, "weakly_supports").when(score <= contradicts, "contradicts").when(score <= weakly_contradicts, "weakly_contradicts").when(score.isNotNull(), "inconclusive")


def acoustic_support(score: Column, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low)))


def shared_labels(rows: DataFrame, label: str, owner: str) -> DataFrame:
    """(label, owners): labels, but for case, that several owners bear."""
    return rows.groupBy(F.lower(label).alias("label")).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def applicable_bindings(turns: DataFrame, bindings: DataFrame, scopes: dict[str, list[str]], turn: str = "interval_id") -> DataFrame:
    """(turn, identities, bindings, status): the identities that bindings (scope, target, identity) give each turn.

    `scopes` names the columns of a turn that a scope's target is compared with, joined by `/`; a join for each
    scope, all on keys. Several identities are a conflict.
    """
    met = None
    for scope, columns in scopes.items():
        named = turns.select(turn, F.concat_ws("/", *columns).alias("target"))
        one = named.join(bindings.where(F.col("scope") == scope).select("target", "identity"), "target").select(turn, "identity")
        met = one if met is None else met.union(one)
    each = met.groupBy(turn).agg(F.count_distinct("identity").alias("identities"), F.count("*").alias("bindings"))
    out = turns.select(turn).join(each, turn, "left").fillna(0, ["identities", "bindings"])
    return out.withColumn("status", F.when(F.col("identities") > 1, "conflict").when(F.col("identities") == 1, "bound").otherwise("unbound"))


def clipped(rows: DataFrame, windows: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """The parts of labelled intervals that lie in windows (key, start_us, end_us, stratum), under the key `key/stratum`."""
    p = overlap_pairs(rows.select(key, "interval_id", "label", "start_us", "end_us"), windows.select(key, "stratum", "start_us", "end_us"), bin_us, key)
    return p.select(F.concat_ws("/", key, "stratum_r").alias(key), F.col("interval_id_l").alias("interval_id"), F.col("label_l").alias("label"), F.greatest("start_us_l", "start_us_r").alias("start_us"), F.least("end_us_l", "end_us_r").alias("end_us"))


def simultaneous(u: DataFrame, members: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, pos, member): members closed under overlap in time, whatever chain of overlaps leads there.

    Overlaps chain exactly within runs of strictly overlapping utterances, so a run's number stands for the closure.
    """
    w = Window.partitionBy(key).orderBy("start_us", "end_us", "pos")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = u.withColumn("cut", F.when(F.col("start_us") < reach, 0).otherwise(1)).select(key, F.col("pos").alias("member"), F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    of = members.join(runs, [key, "member"]).select(key, "pos", "run").distinct()
    return of.join(runs, [key, "run"]).select(key, "pos", "member")


def local_to_source(rows: DataFrame, chunk_us: Column, local_start: Column, length: Column, chunk_start: Column) -> DataFrame:
    """Source intervals of chunk-local ones; those that leave their chunk are left out."""
    inside = (local_start >= 0) & (length >= 0) & (local_start + length <= chunk_us)
    return rows.where(inside).withColumns({"start_us": chunk_start + local_start, "end_us": chunk_start + local_start + length})
