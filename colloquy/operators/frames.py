"""Frames of fixed length over chunks that each own a part of their recording, as frames and as runs of them.

chunks: key, chunk, start_us, end_us, own_start_us, own_end_us and decoded_us (how much of the chunk could be
decoded, from its start). Frames begin at the chunk's start and are clipped to what it owns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNCERTAIN, MALFORMED = "uncertain", "malformed_output"


def recording_chunks(recordings: DataFrame, target_us: int, overlap_us: int, key: str = "corpus_id") -> DataFrame:
    """chunks of each recording (key, duration_us): target_us long, overlap_us shared by neighbours, owned up to the middle of it.

    A recording of target_us or less is one chunk, an empty or negative one none. The last may be shorter.
    """
    step = target_us - overlap_us
    last = F.greatest(F.lit(0), F.ceil((F.col("duration_us") - overlap_us) / step) - 1).cast("long")
    rows = recordings.where("duration_us > 0").select(key, "duration_us", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), last.alias("last"))
    start = F.col("chunk") * step
    end = F.least(start + target_us, "duration_us")
    own_start = F.when(F.col("chunk") == 0, 0).otherwise(start + overlap_us // 2)
    own_end = F.when(F.col("chunk") == F.col("last"), F.col("duration_us")).otherwise(start + step + overlap_us // 2)
    return rows.select(key, "chunk", start.alias("start_us"), end.alias("end_us"), own_start.cast("long").alias("own_start_us"), own_end.cast("long").alias("own_end_us"))


def _owned(chunks: DataFrame, frame_us: int) -> DataFrame:
    """chunks with covered_us, the end of the last frame that could be decoded, clipped, and what is left to the chunk's own end."""
    got = F.least(F.col("decoded_us"), F.col("end_us") - F.col("start_us"))
    covered = F.greatest(F.col("own_start_us"), F.least(F.col("start_us") + got, F.col("own_end_us")))
    rows = chunks.withColumn("covered_us", covered.cast("long"))
    return rows.withColumn("left_us", F.col("own_end_us") - F.col("covered_us")).withColumn("failed", F.col("left_us") > frame_us)


def frame_grid(chunks: DataFrame, frame_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, chunk, frame_no, start_us, end_us, remainder) of every frame that a chunk owns a part of.

    What is left undecoded at the end of a chunk's own part, one frame at most, is a frame too, its number null,
    `remainder`; chunks of which more is left give none (`failures`).
    """
    rows = _owned(chunks, frame_us).where(~F.col("failed"))
    first, end = F.floor((F.col("own_start_us") - F.col("start_us")) / frame_us), F.ceil((F.col("covered_us") - F.col("start_us")) / frame_us)
    frames = rows.where("covered_us > own_start_us").select(key, "chunk", "start_us", "own_start_us", "covered_us", F.explode(F.sequence(first, end - 1)).alias("frame_no"))
    at = F.col("start_us") + F.col("frame_no") * frame_us
    whole = frames.select(key, "chunk", "frame_no", F.greatest(at, F.col("own_start_us")).alias("start_us"), F.least(at + frame_us, F.col("covered_us")).alias("end_us"), F.lit(False).alias("remainder"))
    rest = rows.where("left_us > 0").select(key, "chunk", F.lit(None).cast("long").alias("frame_no"), F.col("covered_us").alias("start_us"), F.col("own_end_us").alias("end_us"), F.lit(True).alias("remainder"))
    return whole.unionByName(rest)


def failures(chunks: DataFrame, frame_us: int, key: str = "corpus_id") -> DataFrame:
    return _owned(chunks, frame_us).where("failed").select(key, "chunk", "left_us", F.lit(MALFORMED).alias("reason"))


def frame_runs(chunks: DataFrame, signal: DataFrame, frame_us: int, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, chunk, class, start_us, end_us, frames) of runs of neighbouring frames of one class, without making the frames.

    signal: key, class, start_us, end_us, disjoint in a recording. A frame is of the class that holds at its unclipped start; of none, and in
    the remainder, `uncertain`. A stretch of signal says for a whole range of frames at once, by division, so
    rows are those of the signal, not of the frames.
    """
    from colloquy.operators.intervals import overlap_pairs

    rows = _owned(chunks, frame_us).where(~F.col("failed"))
    spans = rows.select(key, "chunk", "start_us", F.col("own_end_us").alias("end_us"), F.col("start_us").alias("zero"), "own_start_us", "covered_us")
    met = overlap_pairs(signal.select(key, "class", "start_us", "end_us"), spans, bin_us, key)
    first = F.greatest(F.ceil((F.col("start_us_l") - F.col("zero_r")) / frame_us), F.floor((F.col("own_start_us_r") - F.col("zero_r")) / frame_us))
    end = F.least(F.ceil((F.col("end_us_l") - F.col("zero_r")) / frame_us), F.ceil((F.col("covered_us_r") - F.col("zero_r")) / frame_us))
    told = met.select(key, F.col("chunk_r").alias("chunk"), F.col("class_l").alias("class"), first.alias("a"), end.alias("b")).where("a < b")
    bounds = rows.where("covered_us > own_start_us").select(key, "chunk", F.floor((F.col("own_start_us") - F.col("start_us")) / frame_us).alias("low"), F.ceil((F.col("covered_us") - F.col("start_us")) / frame_us).alias("high"))
    # what no signal tells: before each stretch, and after the last
    w = Window.partitionBy(key, "chunk").orderBy("a", "b")
    gaps = told.withColumn("from", F.lag("b").over(w)).join(bounds, [key, "chunk"]).select(key, "chunk", F.lit(UNCERTAIN).alias("class"), F.coalesce("from", "low").alias("a"), F.col("a").alias("b"))
    after = bounds.join(told.groupBy(key, "chunk").agg(F.max("b").alias("b")), [key, "chunk"], "left").select(key, "chunk", F.lit(UNCERTAIN).alias("class"), F.coalesce("b", "low").alias("a"), F.col("high").alias("b"))
    pieces = told.unionByName(gaps).unionByName(after).where("a < b")
    placed = pieces.join(rows.select(key, "chunk", "start_us", "own_start_us", "covered_us"), [key, "chunk"])
    timed = placed.select(key, "chunk", "class", F.greatest(F.col("start_us") + F.col("a") * frame_us, F.col("own_start_us")).alias("s"), F.least(F.col("start_us") + F.col("b") * frame_us, F.col("covered_us")).alias("e"), (F.col("b") - F.col("a")).alias("n"))
    rest = rows.where("left_us > 0").select(key, "chunk", F.lit(UNCERTAIN).alias("class"), F.col("covered_us").alias("s"), F.col("own_end_us").alias("e"), F.lit(1).cast("long").alias("n"))
    all_ = timed.unionByName(rest)
    order = Window.partitionBy(key, "chunk").orderBy("s", "e")
    fresh = F.when(F.lag("class").over(order).eqNullSafe(F.col("class")), 0).otherwise(1)
    runs = all_.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "chunk", "run").agg(F.first("class").alias("class"), F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.sum("n").alias("frames")).drop("run")


def run_edges(runs: DataFrame, key: str = "corpus_id", name: str = "class") -> DataFrame:
    """(key, at_us, before, after): every time at which a run ends or begins, once, and what lies on each side (null: nothing).

    Of several runs on one side (overlapping ones) the smallest name stands.
    """
    ends = runs.select(key, F.col("end_us").alias("at_us"), F.col(name).alias("before"), F.lit(None).cast("string").alias("after"))
    starts = runs.select(key, F.col("start_us").alias("at_us"), F.lit(None).cast("string").alias("before"), F.col(name).alias("after"))
    return ends.unionAll(starts).groupBy(key, "at_us").agg(F.min("before").alias("before"), F.min("after").alias("after"))
