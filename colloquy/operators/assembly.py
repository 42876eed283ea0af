"""Transcripts assembled from what recognizers proposed: one candidate promoted per observation, its words nested,
what is weak or missing told as regions of review, and a status folded up to the recording.

observations: key, observation_id, start_us, end_us, selected (candidate id or null), speech (array of presence
confidences, a null one unavailable), timing and boundary (confidences or null). candidates: key, observation_id,
candidate_id, text, confidence. words: key, observation_id, candidate_id, n (place), text, start_us, end_us,
recognition and timing. Ids are unique in a recording. Confidences are 0 to 1, null where unavailable.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least confidence of each kind, and the classes of regions.
LEAST = 0.5
MISSING, LOW_SPEECH, LOW_TEXT, NO_TEXT, LOW_TIMING, NO_TIMING, EDGE, SEVERAL, LOST_WORD = (
    "missing_output", "low_speech_probability", "low_transcription_confidence", "unavailable_transcription_confidence", "low_temporal_alignment_confidence", "unavailable_temporal_alignment_confidence", "uncertain_segment_boundary", "candidate_disagreement",
    "incomplete_boundary_word",
)


def nfkc(text: Column) -> Column:
    """Compatibility-composed text, in Arrow batches: Spark has no built-in for it."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(text)


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), r"\s+", " "))


def weak(value: Column, low: str, unavailable: str) -> Column:
    return F.when(value.isNull(), unavailable).when(value < LEAST, low)


def assemble(observations: DataFrame, candidates: DataFrame, words: DataFrame, key: str = "corpus_id", block_missing: bool = True, block_low_text: bool = False, block_no_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(segments, words, regions, statuses).

    segments: key, segment_id (`<observation>:<candidate>`), observation_id, start_us, end_us, text, normalized,
    confidence, alternatives (other candidates' ids, sorted), classes (of its regions, in order). An observation
    without a selected candidate of some text gives none, but a region `missing_output`. words: those of
    promoted candidates that have a text and both times; others give `incomplete_boundary_word`. regions: key,
    observation_id, segment_id, n (the word's place or null), class, blocks, review, start_us, end_us, from the
    word where it has times, else from the segment. statuses: key, n_observations, n_segments, n_words, n_regions,
    status: `blocked` if any region blocks, else `review` if any asks for it, else `complete`.
    """
    cands = candidates.withColumn("norm", normalized(F.coalesce("text", F.lit(""))))
    all_ids = cands.groupBy(key, "observation_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("ids"))
    chosen = cands.select(key, "observation_id", F.col("candidate_id").alias("selected"), F.col("text").alias("proposed"), "norm", "confidence")
    rows = observations.join(all_ids, [key, "observation_id"], "left").join(chosen, [key, "observation_id", "selected"], "left")
    rows = rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    promoted = F.coalesce(F.col("norm") != "", F.lit(False))
    quiet = F.coalesce(F.exists("speech", lambda p: F.coalesce(p < LEAST, F.lit(False))), F.lit(False))
    classes = F.array_compact(F.array_distinct(F.array(
        weak(F.col("confidence"), LOW_TEXT, NO_TEXT), weak(F.col("timing"), LOW_TIMING, NO_TIMING), weak(F.col("boundary"), EDGE, EDGE), F.when(F.size("ids") > 1, SEVERAL), F.when(quiet, LOW_SPEECH),
    )))
    rows = rows.withColumns({"promoted": promoted, "classes": F.when(promoted, classes).otherwise(F.array(F.lit(MISSING))), "segment_id": F.when(promoted, F.concat_ws(":", "observation_id", "selected"))})
    segments = rows.where("promoted").select(key, "segment_id", "observation_id", "start_us", "end_us", F.col("proposed").alias("text"), F.col("norm").alias("normalized"), "confidence", F.array_except("ids", F.array("selected")).alias("alternatives"), "classes")
    blocks = (F.col("class") == MISSING) & block_missing | (F.col("class") == LOW_TEXT) & block_low_text | (F.col("class") == NO_TEXT) & block_no_text
    of_segments = rows.select(key, "observation_id", "segment_id", F.lit(None).cast("int").alias("n"), F.explode("classes").alias("class"), "start_us", "end_us").withColumn("blocks", blocks)
    owners = segments.select(key, "observation_id", F.expr("substring(segment_id, length(observation_id) + 2)").alias("candidate_id"), "segment_id", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    own = words.join(owners, [key, "observation_id", "candidate_id"]).withColumn("norm", normalized(F.coalesce("text", F.lit(""))))
    usable = F.col("start_us").isNotNull() & F.col("end_us").isNotNull() & (F.col("norm") != "")
    good = own.where(usable).select(key, "segment_id", "observation_id", F.col("n").cast("int").alias("n"), "text", F.col("norm").alias("normalized"), "start_us", "end_us", "recognition", "timing")
    found = F.when(~usable, F.array(F.lit(LOST_WORD))).otherwise(F.array_compact(F.array(weak(F.col("recognition"), LOW_TEXT, NO_TEXT), weak(F.col("timing"), LOW_TIMING, NO_TIMING))))
    of_words = own.select(key, "observation_id", "segment_id", F.col("n").cast("int").alias("n"), F.explode(found).alias("class"), F.when(usable, F.col("start_us")).otherwise(F.col("s")).alias("start_us"), F.when(usable, F.col("end_us")).otherwise(F.col("e")).alias("end_us"), F.lit(False).alias("blocks"))
    regions = of_segments.unionByName(of_words).withColumn("review", F.lit(True))
    n = observations.groupBy(key).agg(F.count("*").alias("n_observations"))
    told = regions.groupBy(key).agg(F.count("*").alias("n_regions"), F.max("blocks").alias("b"))
    out = n.join(segments.groupBy(key).agg(F.count("*").alias("n_segments")), key, "left").join(good.groupBy(key).agg(F.count("*").alias("n_words")), key, "left").join(told, key, "left").na.fill(0, ["n_segments", "n_words", "n_regions"])
    statuses = out.select(key, "n_observations", "n_segments", "n_words", "n_regions", F.when(F.col("b"), "blocked").when(F.col("n_regions") > 0, "review").otherwise("complete").alias("status"))
    return segments, good, regions.select(key, "observation_id", "segment_id", "n", "class", "blocks", "review", "start_us", "end_us"), statuses
