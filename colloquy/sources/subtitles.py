"""Subtitle sinks: cues as numbered SRT or WebVTT blocks, and files of them, one a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.transcript import clock, cue_times


def blocks(cues: DataFrame, kind: str) -> DataFrame:
    """(corpus_id, block_no, block) of cues (corpus_id, pos, cue_no, text, start_us, end_us), in start order."""
    mark = {"srt": ",", "vtt": "."}[kind]
    number = F.row_number().over(Window.partitionBy("corpus_id").orderBy("start_us", "pos", "cue_no")).cast("long")
    s, e = cue_times(F.col("start_us"), F.col("end_us"))
    rows = cues.withColumn("block_no", number)
    head = F.concat(F.col("block_no").cast("string"), F.lit("\n")) if kind == "srt" else F.lit("")
    return rows.select("corpus_id", "block_no", F.concat(head, clock(s, mark), F.lit(" --> "), clock(e, mark), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


def write(cues: DataFrame, kind: str, path: str) -> None:
    """A folder of text files for each recording, `path`/corpus_id=N; blocks are lines apart, WebVTT has its header first."""
    rows = blocks(cues, kind).repartition("corpus_id").sortWithinPartitions("corpus_id", "block_no")
    first = F.when((F.col("block_no") == 1) & F.lit(kind == "vtt"), "WEBVTT\n\n").otherwise("")
    rows.select("corpus_id", F.concat(first, "block").alias("value")).write.partitionBy("corpus_id").text(path)
