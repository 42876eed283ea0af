"""Quoted and embedded speech, definitions, presuppositions and references to time in utterances."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cues of an attribution, cues of reported speech in their order.
ATTRIBUTION = ["said", "says", "asked", "wrote", "reported", "i quote", "quote"]
REPORTED = ["said that", "says that", "reported that", "told us that"]
#: Fixed values: (marker, source, kind) of speech that a recording plays.
EMBEDDED = [
    ("[video]", "embedded_media", "video_clip"),
    ("[recording]", "embedded_media", "archival_recording"),
    ("[advertisement]", "embedded_media", "advertisement"),
    ("[remote]", "remote_participant", "remote_feed"),
    ("[voicemail]", "replayed", "voicemail"),
    ("[translated playback]", "replayed", "translated_playback"),
    ("[public address]", "replayed", "public_address"),
    ("[synthetic voice]", "synthesized", "synthesized_voice"),
    ("[replay]", "replayed", "replayed_speech"),
]
#: Kinds of quotation by what stands before them, the first that matches.
KINDS = [
    ("reading_document", r"\[reading\]|read aloud"),
    ("recitation", r"\[recitation\]"),
    ("imitation", r"\[imitating\]|\[impersonating\]"),
    ("hypothetical", r"\bif\b.*\b(said|says|asked)\b"),
    ("self_quotation", r"\bi (said|say|wrote|asked)\b"),
]
#: Quotation marks, markers that stand for a cue, characters before a quotation that may hold one.
QUOTED, MARKED, BEFORE = "[\"“]([^\"”]+)[\"”]", r"\[reading\]|\[recitation\]|\[imitating\]", 120
#: Words of a presupposition, references to time, ways to define a term (context, term and body by group).
PRESUPPOSED = r"\b(?:again|already|still|continue|stop(?:ped)?|resume(?:d)?|why)\b"
TEMPORAL = r"\b(?:(?:19|20)\d{2}|today|yesterday|tomorrow|before|after|since|until|during)\b"
DEFINING = [
    (r"for (?:the )?purposes of (.+?),\s*(.+?)\s+means\s+(.+)", 1, 2, 3),
    (r"by\s+(.+?),\s*I mean\s+(.+)", 0, 1, 2),
    (r"(.+?)\s+is defined as\s+(.+)", 0, 1, 2),
    (r"(.+?)\s+means\s+(.+)", 0, 1, 2),
]
EXCLUDING = r"(?:does not include|excluding|except for)\s+([^.;]+)"


def text_rows(df: DataFrame, keys: list[str], text: str, of: Callable[[str], list[tuple]], schema: T.StructType) -> DataFrame:
    """Keys beside each tuple that `of` finds in a text; Arrow batches, no shuffle; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *row) for i, t in enumerate(b.column(len(keys)).to_pylist()) if t for row in of(t)]
            at, *values = zip(*found, strict=True) if found else [()] * (len(schema) + 1)
            kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.record_batch([*kept, *(pa.array(v, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for v, f in zip(values, schema, strict=True))], [*keys, *schema.names])

    return df.select(*keys, text).mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), *schema]))


def quoted(text: str) -> list[tuple]:
    """(kind, start_off, end_off, attribution, span) of a text's quotations, offsets in code points.

    Spans in quotation marks count where a cue or marker stands in the BEFORE characters before them. Without
    any, the first cue of reported speech, in their order, that words follow gives one to the text's end.
    """
    out = []
    for m in re.finditer(QUOTED, text):
        before = text[max(0, m.start() - BEFORE) : m.start()]
        low = before.casefold()
        if any(c in low for c in ATTRIBUTION) or re.search(MARKED, low):
            kind = next((k for k, p in KINDS if re.search(p, low)), "direct")
            out.append((kind, *m.span(1), before.strip(), m[1]))
    end = len(text.rstrip())
    for cue in REPORTED if not out else ():
        if (m := re.search(re.escape(cue) + "[ ,:-]*", text, re.IGNORECASE)) and m.end() < end:
            return [("reported_speech", m.end(), end, m[0].rstrip(), text[m.end() : end])]
    return out


def quotations(utterances: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, start_off, end_off, attribution, span) of all quotations."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_off", T.IntegerType()), T.StructField("end_off", T.IntegerType()), T.StructField("attribution", T.StringType()), T.StructField("span", T.StringType())])
    return text_rows(utterances, keys, text, quoted, schema)


def embedded_sources(utterances: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, marker, source, kind) of each marker in a text."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(m)), F.struct(F.lit(m).alias("marker"), F.lit(s).alias("source"), F.lit(k).alias("kind"))) for m, s, k in EMBEDDED]
    return utterances.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("e")).select(*keys, "e.*")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^[ ,.;:]+|[ ,.;:]+$", "")


def definitions(utterances: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, body, context, scope, exclusions) by the first way to define that a text takes.

    One cheap test for a defining word goes first, so the lazy patterns see few texts.
    """
    likely = utterances.where(F.col(text).rlike(r"(?iU)I mean\s|is defined as\s|\smeans\s"))
    parts = None
    for pattern, *groups in DEFINING:
        p = f"(?idU){pattern}"
        found = F.struct(*((F.regexp_extract(text, p, g) if g else F.lit("")).alias(n) for g, n in zip(groups, ("context", "term", "body"), strict=True)))
        parts = F.when(F.col(text).rlike(p), found) if parts is None else parts.when(F.col(text).rlike(p), found)
    rows = likely.withColumn("d", parts).where("d is not null").select(*keys, "d.*")
    outside = F.filter(F.transform(F.regexp_extract_all("body", F.lit(f"(?iU){EXCLUDING}"), F.lit(1)), _stripped), lambda x: x != "")
    scope = F.when(F.trim("context") != "", "declared_context").otherwise("source_utterance")
    return rows.select(*keys, _stripped(F.col("term")).alias("term"), F.trim("body").alias("body"), F.trim("context").alias("context"), scope.alias("scope"), F.array_join(outside, " | ").alias("exclusions"))


def marked(utterances: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """(keys, marker) of the distinct matches of a pattern without groups, as they are written."""
    return utterances.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0)))).alias("marker"))


def alternatives(text: Column) -> Column:
    """The parts of a question between its "or"s, null where there are not two."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "[ ?]+$", ""), r"(?iU)\s+or\s+"), lambda x: F.regexp_replace(x, "^[ ,]+|[ ,]+$", "")), lambda x: x != "")
    return F.when(F.size(parts) >= 2, parts)
