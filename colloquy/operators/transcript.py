"""Transcripts as text: views, completeness, disfluencies, segments, subtitle lines and cues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policy defaults of analysis, segmentation and subtitles.
FILLERS = ["um", "uh", "erm", "hmm"]
REPAIR_MARKERS = ["i mean", "rather", "sorry"]
FRAGMENT_US, BOUNDARY_US = 500_000, 1
MAXIMUM_GAP_US = 750_000
LINE, CUE, CUE_US = 42, 84, 7_000_000

SPACE = "[ \\t\\r\\n]+"
EDGE = "^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def token(word: Column) -> Column:
    """Lower case without punctuation at the edges."""
    return F.regexp_replace(F.lower(word), EDGE, "")


def completeness(utterances: DataFrame) -> DataFrame:
    """(corpus_id, pos, completeness): the first rule that holds; the source ends where the last utterance does."""
    text = F.rtrim(collapsed(F.col("text")))
    end = F.max("end_us").over(Window.partitionBy("corpus_id"))
    rows = utterances.select("corpus_id", "pos", text.alias("t"), F.col("end_us").alias("e"), (F.col("end_us") - F.col("start_us")).alias("lasts"), end.alias("source_end"))
    rows = rows.withColumn("tokens", F.expr("size(filter(split(t, ' '), w -> w rlike '[\\\\p{L}\\\\p{N}_]'))"))
    terminal = F.col("t").rlike("[.?!]$")
    kind = (
        F.when(F.col("tokens") == 0, "non_lexical")
        .when(F.col("t").rlike("(\\.\\.\\.|…)$"), "unknown")
        .when(F.col("t").rlike("[-—–]$"), "unknown")
        .when(~terminal & (F.col("e") >= F.col("source_end") - BOUNDARY_US), "clipped_by_source_boundary")
        .when((F.col("lasts") <= FRAGMENT_US) & (F.col("tokens") == 1) & ~terminal, "fragment")
        .when(terminal, "complete")
        .otherwise("unknown")
    )
    return rows.select("corpus_id", "pos", kind.alias("completeness"))


def disfluencies(words: DataFrame) -> DataFrame:
    """(corpus_id, pos, word_no, kind) of words: fillers, hesitations, repetitions, corrections, false starts."""
    w = Window.partitionBy("corpus_id", "pos").orderBy("word_no")
    t = words.withColumn("token", token(F.col("word")))
    t = t.select("corpus_id", "pos", "word_no", "word", "token", F.lag("token").over(w).alias("before"), (F.col("word_no") < F.col("n_words")).alias("more"))
    kinds = [
        ("filler", F.col("token").isin(FILLERS)),
        ("hesitation", F.col("word").rlike("\\.\\.\\.|…")),
        ("repetition", (F.col("token") != "") & (F.col("token") == F.col("before"))),
        ("explicit_correction", F.col("token").isin(REPAIR_MARKERS) & F.col("before").isNotNull() & F.col("more")),
        ("false_start", F.col("word").rlike("[-—–]$") & F.col("more")),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds)))
    return t.select("corpus_id", "pos", "word_no", F.explode(found).alias("kind"))


def segments(atoms: DataFrame, gap_us: int = MAXIMUM_GAP_US) -> DataFrame:
    """Atoms (corpus_id, pos, line_no, speaker, text, start_us, end_us) with `segment`, numbered from 0.

    An atom joins the one just before if the speaker is the same, the gap is 0 to gap_us and the text before
    doesn't end a sentence. All conditions are between neighbours, so one window does.
    """
    w = Window.partitionBy("corpus_id").orderBy("start_us", "pos", "line_no")
    gap = F.col("start_us") - F.lag("end_us").over(w)
    joins = gap.between(0, gap_us) & F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & ~F.rtrim(F.lag("text").over(w)).rlike("[.?!]$")
    rows = atoms.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("segment", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh")


def _filled(words: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Runs of words, each as long as the next word fits: structs of text, first (words before) and n (words).

    One pass: a run is closed once, so an array grows by runs, not by words.
    """
    run = "struct<text: string, first: int, n: int>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("n"))

    def add(a: Column, w: Column) -> Column:
        same = (a["n"] > 0) & fits(a, w)
        closed = F.concat(a["done"], F.array(F.struct(a["text"].alias("text"), a["first"].alias("first"), a["n"].alias("n"))))
        return F.struct(
            F.when(same | (a["n"] == 0), a["done"]).otherwise(closed).alias("done"), F.when(same, F.concat(a["text"], F.lit(" "), w)).otherwise(w).alias("text"),
            F.when(same, a["first"]).otherwise(a["first"] + a["n"]).alias("first"), F.when(same, a["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    def finish(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["text"].alias("text"), a["first"].alias("first"), a["n"].alias("n"))))).otherwise(a["done"])

    return F.aggregate(words, start, add, finish)


def lines(text: Column, most: int = LINE) -> Column:
    """Lines of at most `most` characters, filled greedily; a longer word has a line of its own."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(_filled(words, lambda a, w: F.length(a["text"]) + 1 + F.length(w) <= most), lambda r: r["text"])


def cues(utterances: DataFrame, most: int = CUE, most_us: int = CUE_US) -> DataFrame:
    """(corpus_id, pos, cue_no, text, start_us, end_us): words packed up to `most` characters and most_us.

    The words of an utterance share its time evenly. Utterances without a word give no cue.
    """
    rows = utterances.withColumn("ws", F.filter(F.split("text", SPACE), lambda w: w != "")).where("size(ws) > 0")
    rows = rows.withColumn("each", F.expr("(end_us - start_us) div size(ws)"))
    runs = _filled(F.col("ws"), lambda a, w: (F.length(a["text"]) + 1 + F.length(w) <= most) & ((a["n"] + 1) * F.col("each") <= most_us))
    out = rows.select("corpus_id", "pos", "start_us", "each", F.posexplode(runs).alias("i", "r"))
    start = F.col("start_us") + F.col("r.first") * F.col("each")
    return out.select("corpus_id", "pos", (F.col("i") + 1).cast("long").alias("cue_no"), "r.text", start.alias("start_us"), (start + F.col("r.n") * F.col("each")).alias("end_us"))


def cue_times(start_us: Column, end_us: Column) -> tuple[Column, Column]:
    """Milliseconds: the start rounded down, the end up, one at least between."""
    start = F.floor(start_us / 1000)
    return start, F.greatest(F.ceil(end_us / 1000), start + 1)


def clock(ms: Column, mark: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
