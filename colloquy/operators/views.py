"""Transcripts as people read them: six views of utterances, marks spliced into text, participants' cues.

A view replaces nothing: what it can't show is a named loss, a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import timestamp
from colloquy.operators.transcript import CUE, CUE_US, LINE, cue_times, lines

#: Views, markers, kinds of loss and labels.
VIEWS = ["machine_speaker_cluster", "reviewed_participant_identity", "unknown_preserving", "correction_aware", "overlap_expanded", "compact_reading"]
MARKERS = ["incomplete", "interrupted", "interrupting", "resumes", "continuation", "overlap", "quotation", "embedded_source", "repair_proposed", "repair_accepted", "unknown_speaker", "conflicting_speaker", "review_required"]
LOSSES = ["overlap_linearized", "machine_cluster_label_unavailable", "reviewed_identity_label_unavailable", "corrected_text_unavailable", "compact_marker_omission", "noncontiguous_intervals_linearized"]
CUE_LOSSES = ["millisecond_timestamp_rounding", "normalized_text_rendering", "format_metadata_in_companion_manifest", "line_length_exceeded", "long_cue_retained"]
UNKNOWN, CONFLICT, OVERLAP_PREFIX, REVIEWED_UNKNOWN, UNATTRIBUTED = "UNKNOWN", "CONFLICT", "OVERLAP: ", "REVIEWED: UNKNOWN", "UNATTRIBUTED"
LINES_PER_CUE = 2


def marked(keys: list[str], **sources: DataFrame) -> DataFrame:
    """(keys, markers, details) of utterances with any marker, both sorted, each value once.

    `sources` names by marker the rows (keys, and `detail` if there is any) that bear it.
    """
    unknown = set(sources) - set(MARKERS)
    if unknown:
        raise ValueError(f"no such marker: {sorted(unknown)}")
    all_ = None
    for name, df in sources.items():
        detail = F.col("detail").cast("string") if "detail" in df.columns else F.lit(None).cast("string")
        part = df.select(*keys, F.lit(name).alias("marker"), detail.alias("detail"))
        all_ = part if all_ is None else all_.union(part)
    return all_.groupBy(*keys).agg(F.array_sort(F.collect_set("marker")).alias("markers"), F.array_sort(F.collect_set("detail")).alias("details"))


def view_label(view: str) -> tuple[Column, Column]:
    """(label, kind of loss or null) that a view gives an utterance's attribution (status, label)."""
    status, label, none = F.col("status"), F.col("label"), F.lit(None).cast("string")
    if view == VIEWS[0]:
        shown = status == "machine_clustered"
        return F.when(shown, label).otherwise(UNKNOWN), F.when(shown, none).otherwise(LOSSES[1])
    if view == VIEWS[1]:
        shown = status.isin("manually_bound", "role_labeled")
        return F.when(shown, label).otherwise(UNKNOWN), F.when(shown, none).otherwise(LOSSES[2])
    return F.when(status == "conflicting", CONFLICT).when(status == "unknown", UNKNOWN).otherwise(label), none


def rendered(utterances: DataFrame, markers: DataFrame, key: str = "corpus_id", utterance: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(lines, losses): the six views of every utterance, and what each can't show.

    utterances: key, utterance, start_us, source_us, status, label, display, corrected (null: none), intervals
    (their number), group_no and lane; `markers` as `marked` gives them. lines: view, key, utterance, place
    (from 1, by start, then utterance), text, line. losses: view, key, kind, group_no and utterances (sorted),
    one for each utterance concerned, and one for each group that a view puts in a row. A null status counts
    as unknown, null texts as empty.
    """
    rows = utterances.join(markers.select(key, utterance, "markers"), [key, utterance], "left").withColumns({
        "markers": F.coalesce("markers", F.array().cast("array<string>")), "status": F.coalesce("status", F.lit("unknown")), "display": F.coalesce("display", F.lit("")), "label": F.coalesce("label", F.lit(UNKNOWN)),
    })
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start_us", utterance)))
    shown = []
    for view in VIEWS:
        label, loss = view_label(view)
        aware = view == "correction_aware"
        text = F.coalesce("corrected", "display") if aware else F.col("display")
        lacks = [loss]
        if aware:
            lacks.append(F.when(F.col("corrected").isNull(), LOSSES[3]))
        if view != "overlap_expanded":
            lacks.append(F.when(F.col("intervals") > 1, LOSSES[5]))
        name = F.lit("") if view == "compact_reading" else F.concat(F.lit("["), F.col(utterance).cast("string"), F.lit("] "))
        lane = F.concat(F.lit("[lane="), "lane", F.lit("] ")) if view == "overlap_expanded" else F.lit("")
        tags = F.array_join(F.transform("markers", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), " ")
        line = F.rtrim(F.concat(timestamp(F.col("source_us")), F.lit(" "), lane, name, label, F.lit(": "), tags, F.lit(" "), text))
        shown.append(F.struct(F.lit(view).alias("view"), text.alias("text"), line.alias("line"), F.array_compact(F.array(*lacks)).alias("lacks")))
    views = rows.select(key, utterance, "place", "group_no", F.explode(F.array(*shown)).alias("v")).select("v.view", key, utterance, "place", "group_no", "v.text", "v.line", "v.lacks")
    single = views.select("view", key, F.explode("lacks").alias("kind"), "group_no", F.array(utterance).alias("utterances"))
    groups = rows.groupBy(key, "group_no").agg(F.array_sort(F.collect_list(utterance)).alias("utterances")).where("size(utterances) > 1")
    linear = groups.select(F.explode(F.array(*(F.lit(v) for v in VIEWS if v != "overlap_expanded"))).alias("view"), key, F.lit(LOSSES[0]).alias("kind"), "group_no", "utterances")
    return views.drop("group_no", "lacks"), single.unionByName(linear)


def splice(text: str, marks: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int]], list[str]]:
    """(text, places, losses): `<kind>` and `</kind>` put around each (start, end, kind), in code points.

    places are where the marked stretch itself stands in the new text: without marks of others inside it, that
    slice is the old one. A mark that begins first, or ends last of those, is the outer one; marks that cross are kept, as losses `crossing`; one beyond the text is clipped, as `clipped`; one that is not in
    order, or null, is left out, as `unplaced`, with the place (-1, -1).
    """
    n, losses, sound = len(text), [], []
    for at, (a, b, kind) in enumerate(marks):
        if a is None or b is None or kind is None or a > b or a > n or b < 0:
            losses.append("unplaced")
            continue
        if a < 0 or b > n:
            losses.append("clipped")
        sound.append((max(a, 0), min(b, n), at, kind))
    sound.sort(key=lambda m: (m[0], -m[1], m[2]))
    inserts = []  # (place, order, nesting, tag, mark, side): at one place, ends come first, inner ends before outer, then starts, outer first
    stack: list[tuple[int, int]] = []
    for depth, (a, b, at, kind) in enumerate(sound):
        while stack and stack[-1][1] <= a:
            stack.pop()
        if stack and stack[-1][1] < b:
            losses.append("crossing")
        stack.append((a, b))
        empty = a == b
        inserts.append((a, 2 if empty else 1, depth, f"<{kind}>", at, 0))
        inserts.append((b, 2 if empty else 0, depth if empty else -depth, f"</{kind}>", at, 1))
    inserts.sort(key=lambda x: (x[0], x[1], x[2], x[5]))
    out, places, before, shift = [], [[-1, -1] for _ in marks], 0, 0
    for place, _, _, tag, at, side in inserts:
        out += [text[before:place], tag]
        before = place
        places[at][side] = place + shift + (len(tag) if side == 0 else 0)
        shift += len(tag)
    return "".join(out) + text[before:], [tuple(p) for p in places], losses


def spliced(df: DataFrame, keys: list[str], text: str, marks: str) -> DataFrame:
    """(keys, text, places, losses) of every row, as `splice` says; `marks` is array<struct<start, end, kind>>, offsets from 0.

    Offsets through many insertions are no built-in; rows are spliced in Arrow batches and nothing is shuffled.
    Null text counts as empty, null marks as none.
    """
    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("places", pair), T.StructField("losses", T.ArrayType(T.StringType()))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            done = [splice(t or "", [(m["start"], m["end"], m["kind"]) for m in ms or [] if m]) for t, ms in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            places = [[{"start": a, "end": b} for a, b in p] for _, p, _ in done]
            yield pa.record_batch([*batch.columns[:n], pa.array([d[0] for d in done], pa.string()), pa.array(places, kind), pa.array([d[2] for d in done], pa.list_(pa.string()))], [*keys, "text", "places", "losses"])

    return df.select(*keys, text, marks).mapInArrow(run, schema)


def participant_cues(segments: DataFrame, keys: list[str], most: int = LINE) -> DataFrame:
    """A cue for each labelled segment: keys, start_ms, end_ms, label, lines, unresolved, overlap, losses, refused.

    segments: keys, start_us, end_us, text, normalized and spans, an array of structs (kind, reviewed, machine:
    arrays of labels, overlap). Labels are those of people, else of machines, else of none, each once. A
    segment with a conflicted span, or without a word, is refused, with the reason; its other columns are null.
    Nothing is shortened: what exceeds a line, or a cue, is kept as a loss.
    """
    def of(s: Column) -> Column:
        some = lambda f: F.coalesce(F.size(s[f]), F.lit(0)) > 0
        return F.when(some("reviewed"), s["reviewed"]).when(some("machine"), s["machine"]).when(s["kind"] == "unattributed", F.array(F.lit(UNATTRIBUTED))).otherwise(F.array(F.lit(REVIEWED_UNKNOWN)))

    spans = F.coalesce("spans", F.expr("filter(spans, s -> false)"))
    overlap = F.coalesce(F.exists("spans", lambda s: F.coalesce(s["overlap"], F.lit(False))), F.lit(False))
    joined = F.array_join(F.array_distinct(F.flatten(F.transform(spans, of))), " | ")
    body = lines(F.coalesce("normalized", F.lit("")), most)
    start, end = cue_times(F.col("start_us"), F.col("end_us"))
    unresolved = F.coalesce(F.exists("spans", lambda s: s["kind"].isin("unknown", "unattributed", "multiple_candidates")), F.lit(False))
    refused = F.when(F.coalesce(F.exists("spans", lambda s: s["kind"] == "conflicted"), F.lit(False)), "conflicted").when(F.size("body") == 0, "empty")
    rows = segments.withColumns({"body": body, "start_ms": start, "end_ms": end, "label": F.concat(F.when(overlap, OVERLAP_PREFIX).otherwise(""), F.coalesce(joined, F.lit("")))}).withColumns({"refused": refused, "unresolved": unresolved, "overlap": overlap})
    tests = [
        (F.col("start_ms") * 1000 != F.col("start_us")) | (F.col("end_ms") * 1000 != F.col("end_us")), ~F.col("text").eqNullSafe(F.col("normalized")), F.size("spans") > 1,
        (F.size("body") + 1 > LINES_PER_CUE) | (F.length("label") > most), (F.length("normalized") > CUE) | (F.col("end_us") - F.col("start_us") > CUE_US),
    ]
    losses = F.array_compact(F.array(*(F.when(test, name) for test, name in zip(tests, CUE_LOSSES, strict=True))))
    good = F.col("refused").isNull()
    shown = {"start_ms": F.col("start_ms"), "end_ms": F.col("end_ms"), "label": F.col("label"), "lines": F.concat(F.array("label"), "body"), "unresolved": F.col("unresolved"), "overlap": F.col("overlap"), "losses": losses}
    return rows.select(*keys, *(F.when(good, c).alias(n) for n, c in shown.items()), "refused")
