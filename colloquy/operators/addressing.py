"""Addresses in media time and small set operations on evidence: seconds, tags, nearest frames, first occurrences,
what is compatible, regions at cues, selections, counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def microseconds(seconds: Column) -> Column:
    """Whole microseconds of decimal seconds (string or number), halves to the even; null for null, `N/A` and what is no number."""
    text = F.trim(seconds.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.bround(F.when(plain, text.cast("decimal(30,12)")) * 1_000_000, 0).cast("long")


def tag_pairs(tags: Column) -> Column:
    """A map's entries as structs (key, value), sorted; empty for null."""
    pairs = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.coalesce(pairs, F.array().cast("array<struct<key: string, value: string>>"))


def merged_points(a: Column, b: Column) -> Column:
    """The points of both arrays, each once, sorted, without nulls: a timeline's discontinuities and those that a probe found."""
    none = F.expr("cast(array() as array<bigint>)")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(a.cast("array<bigint>"), none), F.coalesce(b.cast("array<bigint>"), none)))))


def nearest_frames(asked: DataFrame, frames: DataFrame, radius_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, ask_id, at_us, frame_us, error_us) of every asked time: the nearest frame within the radius, the earlier of two, or null.

    asked: key, ask_id, at_us; frames: key, frame_us. Both sides are sorted together once; the frame before and
    the frame after are the last and the next seen, so no pair is formed.
    """
    both = asked.select(key, "ask_id", F.col("at_us").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("frame")).unionByName(
        frames.where("frame_us is not null").select(key, F.lit(None).cast(asked.schema["ask_id"].dataType).alias("ask_id"), F.col("frame_us").alias("at"), F.lit(0).alias("side"), F.col("frame_us").alias("frame"))
    )
    w = Window.partitionBy(key).orderBy("at", "side")
    seen = both.withColumns({"before": F.last("frame", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("frame", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    back, on = F.col("at") - F.col("before"), F.col("after") - F.col("at")
    near = F.when(F.col("after").isNull() | (back <= on), F.col("before")).otherwise(F.col("after"))
    out = seen.where("side = 1").select(key, "ask_id", F.col("at").alias("at_us"), near.alias("frame_us"))
    error = F.abs(F.col("frame_us") - F.col("at_us"))
    return out.select(key, "ask_id", "at_us", F.when(error <= radius_us, F.col("frame_us")).alias("frame_us"), F.when(error <= radius_us, error).alias("error_us"))


def first_occurrences(df: DataFrame, values: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal values the one that comes first, with all its columns: a partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in values]
    return df.groupBy(*values).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*values, "r.*").select(*df.columns)


def compatible(candidates: DataFrame, exclusions: DataFrame, group: list[str], candidate: str) -> DataFrame:
    """(group, candidate, compatible): of each candidate the others of its group that no exclusion (a, b) forbids, sorted.

    Exclusions hold both ways. Groups are the candidates of one utterance, a dozen at most.
    """
    peers = candidates.groupBy(*group).agg(F.collect_set(candidate).alias("peers"))
    both = exclusions.select(F.col("a").alias(candidate), F.col("b").alias("other")).union(exclusions.select("b", "a"))
    out = both.groupBy(candidate).agg(F.collect_set("other").alias("out"))
    rows = candidates.select(*group, candidate).distinct().join(peers, group).join(out, candidate, "left")
    kind = peers.schema["peers"].dataType
    return rows.select(*group, candidate, F.array_sort(F.array_except("peers", F.concat(F.coalesce("out", F.array().cast(kind)), F.array(candidate)))).alias("compatible"))


def retained_disagreements(acts: DataFrame, qualifications: DataFrame, act: str = "act_id") -> DataFrame:
    """(act, retained): the texts of a partial concession's qualifications, each once, in order of n; of other acts none."""
    texts = qualifications.where("text is not null").groupBy(act, "text").agg(F.min("n").alias("n"))
    each = texts.groupBy(act).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("texts"))
    none = F.array().cast("array<string>")
    return acts.join(each, act, "left").select(act, F.when(F.col("type") == "concession.partial", F.coalesce("texts", none)).otherwise(none).alias("retained"))


def cue_regions(cues: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions) of every cue: the ids of regions of its segments (regions without a word) and of its words, sorted.

    cues: keys, segments and words (arrays of ids); regions: keys' first column, region_id, segment_id, word_id (null: the
    whole segment).
    """
    at = keys[0]
    by_segment = cues.select(*keys, F.explode("segments").alias("segment_id")).join(regions.where("word_id is null").select(at, "segment_id", "region_id"), [at, "segment_id"]).select(*keys, "region_id")
    by_word = cues.select(*keys, F.explode("words").alias("word_id")).join(regions.where("word_id is not null").select(at, "word_id", "region_id"), [at, "word_id"]).select(*keys, "region_id")
    found = by_segment.union(by_word).groupBy(*keys).agg(F.array_sort(F.collect_set("region_id")).alias("regions"))
    return cues.select(*keys).join(found, keys, "left").withColumn("regions", F.coalesce("regions", F.array().cast(found.schema["regions"].dataType)))


def candidate_selection(references: DataFrame, matched: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, evaluated, correct, accuracy, unavailable): how often the expected candidate is among those of the matched state.

    references: key, reference_id, expected (candidate or null); matched: key, reference_id, selected (array of
    candidates). Without an expectation, or without a match, a recording has no accuracy, and a reason.
    """
    rows = references.select(key, "reference_id", "expected").join(matched.select(key, "reference_id", "selected"), [key, "reference_id"], "left")
    asked, met = F.col("expected").isNotNull(), F.col("selected").isNotNull()
    out = rows.groupBy(key).agg(F.count_if(asked).alias("asked"), F.count_if(asked & met).alias("evaluated"), F.count_if(asked & met & F.coalesce(F.array_contains("selected", F.col("expected")), F.lit(False))).alias("correct"))
    reason = F.when(F.col("asked") == 0, "unavailable_reference").when(F.col("evaluated") == 0, "unavailable_hypothesis")
    return out.select(key, "evaluated", "correct", F.round(F.try_divide("correct", "evaluated"), 9).alias("accuracy"), reason.alias("unavailable"))


def counters(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """(by, n, one column for each value, other): how often each value of an enumeration occurs; absent ones are 0, and so told."""
    known = F.col(column).isin(values)
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(v) for v in values), F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def inventory(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n, digest) of tables that are exported together: rows, and a digest that any order of them gives alike.

    A row's digest is the SHA-256 of its columns as JSON, in their order, nulls kept; the table's adds up their first 15 hex
    digits, in decimals, so two tables with equal rows, repeated ones too, agree.
    """
    out = None
    for name, df in parts.items():
        row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        one = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("s"))
        part = one.select(F.lit(name).alias("part"), "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("digest"))
        out = part if out is None else out.union(part)
    return out
