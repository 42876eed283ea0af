"""Ordered-sequence operators: sessions, runs, adjacency, as-of and nearest joins, state folds, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, gap_us: int, key: str = "corpus_id", at: str = "at_us", tie: str = "event_id") -> DataFrame:
    """Rows with `session`, numbered from 0: a new one begins after a gap of more than gap_us."""
    w = Window.partitionBy(key).orderBy(at, tie)
    fresh = F.when(F.col(at) - F.lag(at).over(w) <= gap_us, 0).otherwise(1)
    return df.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh")


def runs(df: DataFrame, value: str, key: str = "corpus_id", order: tuple[str, ...] = ("at_us", "event_id")) -> DataFrame:
    """Rows with `run`, numbered from 0: neighbours with equal values are one run."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh")


def demote_short_runs(df: DataFrame, value: str, least_us: int, to: str, key: str = "corpus_id", at: str = "at_us", tie: str = "event_id") -> DataFrame:
    """`value` of runs that last less than least_us becomes `to`; neighbours aren't merged again."""
    r = runs(df, value, key, (at, tie))
    whole = Window.partitionBy(key, "run")
    lasts = F.max(at).over(whole) - F.min(at).over(whole)
    return r.withColumn(value, F.when(lasts < least_us, F.lit(to)).otherwise(F.col(value))).drop("run")


def adjacency(df: DataFrame, key: str = "corpus_id", tie: str = "pos") -> DataFrame:
    """Neighbours in start order: signed gap and its kind."""
    w = Window.partitionBy(key).orderBy("start_us", tie)
    nxt = df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in (tie, "start_us", "end_us"))).where(F.col(f"next_{tie}").isNotNull())
    gap = F.col("next_start_us") - F.col("end_us")
    kind = F.when(F.col("next_start_us") == F.col("start_us"), "simultaneous_start").when(gap < 0, "overlapping").when(gap == 0, "touching").otherwise("before")
    return nxt.select(key, F.col(tie).alias("left_id"), F.col(f"next_{tie}").alias("right_id"), gap.alias("gap_us"), kind.alias("relation"))


def continuations(df: DataFrame, within_us: int, incomplete: Column, key: str = "corpus_id", target: str = "speaker") -> DataFrame:
    """The next utterance of the same speaker, two positions later or more, that starts within reach of an unfinished one.

    Later utterances that start before the unfinished one ends are passed over; the first that doesn't decides.
    Only starts within reach of an end are joined, by bins of within_us: two for each unfinished utterance.
    """
    w = Window.partitionBy(key).orderBy("start_us", "pos")
    rows = df.withColumn("rank", F.row_number().over(w))
    first = F.floor(F.col("end_us") / within_us)
    left = rows.where(incomplete & F.col(target).isNotNull()).select(key, target, F.col("pos").alias("left_id"), F.col("rank").alias("l_rank"), F.col("end_us").alias("l_end"), F.explode(F.array(first, first + 1)).alias("bin"))
    right = rows.select(key, target, F.col("pos").alias("right_id"), F.col("rank").alias("r_rank"), F.col("start_us").alias("r_start"), F.floor(F.col("start_us") / within_us).alias("bin"))
    near = left.join(right, [key, target, "bin"]).where((F.col("r_rank") >= F.col("l_rank") + 2) & F.col("r_start").between(F.col("l_end"), F.col("l_end") + within_us))
    found = near.groupBy(key, "left_id", "l_end").agg(F.min(F.struct("r_rank", "right_id", "r_start")).alias("f"))
    return found.select(key, "left_id", F.col("f.right_id").alias("right_id"), (F.col("f.r_start") - F.col("l_end")).alias("gap_us"))


def nearest_prior(df: DataFrame, is_source: Column, is_target: Column, id_col: str = "event_id", key: str = "corpus_id", order: str = "at_us") -> DataFrame:
    """For each source row the last target rows strictly before it: one window finds their time, an equi-join all that share it."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("prior", F.max(F.when(is_target, F.col(order))).over(w)).where(is_source)
    targets = df.where(is_target).select(F.col(key).alias("t_key"), F.col(order).alias("t_at"), F.col(id_col).alias("target_id"))
    both = out.join(targets, (F.col(key) == F.col("t_key")) & (F.col("prior") == F.col("t_at")), "left")
    return both.select(key, F.col(id_col).alias("source_id"), "target_id", (F.col(order) - F.col("prior")).alias("distance_us"))


def latest_of_kind(df: DataFrame, kinds: list[str], kind: str = "label", id_col: str = "event_id", key: str = "corpus_id", at: str = "at_us") -> DataFrame:
    """State after each event: for each kind the id of its last event, the event itself included."""
    w = Window.partitionBy(key).orderBy(at, id_col).rowsBetween(Window.unboundedPreceding, 0)
    state = [F.last(F.when(F.col(kind) == k, F.col(id_col)), ignorenulls=True).over(w).alias(f"latest_{k}") for k in kinds]
    return df.select(key, id_col, *state)


def top_per_group(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def dispositions(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with `disposition`: the first of each group is selected, the others are rejected."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("disposition", F.when(rank == 1, "selected").otherwise("rejected"))


def owners(candidates: DataFrame, item: list[str], overlap: str = "overlap_us", start: str = "span_start_us", span: str = "span_id") -> DataFrame:
    """The span that owns each item: most overlap, then earliest start, then the larger id; ambiguous if the two best overlap alike."""
    w = Window.partitionBy(*item).orderBy(F.desc(overlap), start, F.desc(span))
    ranked = candidates.where(F.col(overlap) > 0).select("*", F.row_number().over(w).alias("rank"), F.lead(overlap).over(w).alias("second"))
    return ranked.where("rank = 1").withColumn("ambiguous", F.coalesce(F.col("second") == F.col(overlap), F.lit(False))).drop("rank", "second")


def gaps(df: DataFrame, tolerance_us: int, key: str = "corpus_id", at: str = "at_us", tie: str = "event_id") -> DataFrame:
    """Per key: counts of missing, repeated and late points in arrival order, and the longest gap."""
    w = Window.partitionBy(key).orderBy(at, tie)
    d = df.withColumn("step", F.col(at) - F.lag(at).over(w))
    return d.groupBy(key).agg(F.count("*").alias("points"), F.sum((F.col("step") > tolerance_us).cast("long")).alias("gaps"), F.sum((F.col("step") == 0).cast("long")).alias("repeats"), F.max("step").alias("longest_us"))
