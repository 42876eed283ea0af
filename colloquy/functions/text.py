"""Text functions: discourse rules as data, matches with offsets, timestamps, identifiers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lexical act rules in their order (rule, pattern, strength); the family is the rule's first part.
RULES = [
    ("assertive.denial", r"\bI (?:deny|reject) that\b", 0.94),
    ("assertive.affirmation", r"\bI affirm that\b", 0.96),
    ("assertive.uncertainty", r"\b(?:I am not sure|I am uncertain|we do not know)\b", 0.96),
    ("assertive.report", r"\b(?:the report|the record|the data) (?:says|shows)\b", 0.92),
    ("question.clarification", r"\b(?:what do you mean|could you clarify|please clarify)\b", 0.96),
    ("question.procedural", r"\b(?:can|could|shall) we (?:move on|continue|proceed)\b", 0.95),
    ("question.information", r"^\s*(?:who|what|when|where|why|how)\b[^?]*\?", 0.91),
    ("question.yes_no", r"^\s*(?:do|does|did|is|are|was|were|can|could|would|will|should|have|has)\b[^?]*\?", 0.90),
    ("procedural.time_warning", r"\b(?:you have|there (?:is|are)) \w+ (?:seconds?|minutes?) (?:left|remaining)\b", 0.97),
    ("procedural.time_expired", r"\b(?:time is up|time has expired|your time is up)\b", 0.98),
    ("procedural.request_answer", r"\b(?:please|kindly) answer (?:the question|that)\b", 0.97),
    ("procedural.floor_grant", r"\b(?:you may respond|go ahead|the floor is yours)\b", 0.98),
    ("procedural.topic_transition", r"\b(?:let us|let's|we will) move (?:on|to)\b", 0.95),
    ("procedural.request_stop", r"\bplease stop\b", 0.97),
    ("concession.partial", r"^\s*(?:yes|true|agreed|granted)\s*,?\s+but\b", 0.93),
    ("concession.full", r"\bI (?:fully )?(?:agree|concede) that\b", 0.91),
    ("qualification.conditional", r"\b(?:if|unless|provided that|on condition that)\b", 0.84),
    ("qualification.temporal", r"\b(?:before|after|since|until|during|in)\s+(?:the \w+|today|yesterday|tomorrow|(?:19|20)\d{2})\b", 0.88),
    ("qualification.exception", r"\b(?:except for|with the exception of)\b", 0.95),
    ("qualification.probabilistic", r"\b(?:probably|possibly|perhaps|more likely than not)\b", 0.86),
    ("qualification.scope", r"\b(?:only|solely|specifically|insofar as)\b", 0.82),
    ("definition.operational", r"\bfor (?:the )?purposes of .{0,80}?\bmeans\b.*", 0.96),
    ("definition.explicit", r"\b(?:by .{1,60}, I mean|.{1,60} is defined as)\b.*", 0.92),
    ("definition.lexical", r"^\s*[A-Za-z][\w -]{0,50}\s+means\s+\S.*", 0.88),
    ("example.counterexample", r"\b(?:as a counterexample|consider the counterexample)\b.*", 0.97),
    ("example.hypothetical", r"\b(?:suppose|imagine|assume for example)\b.*", 0.90),
    ("example.explicit", r"\b(?:for example|for instance|as an example)\b.*", 0.97),
]
#: Acts of an utterance, at most.
ACTS = 12


def rule_hits(df: DataFrame, text: str) -> DataFrame:
    """A row for each rule that matches somewhere: JVM regexes in one projection, then one explode."""
    found = [F.when(F.col(text).rlike(f"(?iU){p}"), F.struct(F.lit(n).alias("rule"), F.lit(n.split(".")[0]).alias("family"), F.lit(s).alias("strength"), F.lit(i).alias("rule_no"))) for i, (n, p, s) in enumerate(RULES)]
    return df.withColumn("hit", F.explode(F.array_compact(F.array(*found)))).select(*df.columns, "hit.*")


def rule_spans(df: DataFrame, keys: list[str], text: str, acts: int = ACTS) -> DataFrame:
    """(keys, rule, start_off, end_off, span): all matches with offsets in code points, in rule order, at most `acts` an utterance.

    Built-in functions give no offsets, so matching runs over Arrow batches; nothing is shuffled.
    """
    rules = [(n, re.compile(p, re.IGNORECASE)) for n, p, _ in RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[], [], [], []]
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                seen = dict.fromkeys((n, *m.span()) for n, p in rules for m in p.finditer(t or ""))
                for n, s, e in list(seen)[:acts]:
                    at.append(i)
                    for o, v in zip(out, (n, s, e, t[s:e]), strict=True):
                        o.append(v)
            yield pa.record_batch([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], [*keys, "rule", "start_off", "end_off", "span"])

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("rule", T.StringType()), T.StructField("start_off", T.IntegerType()), T.StructField("end_off", T.IntegerType()), T.StructField("span", T.StringType())])
    return df.select(*keys, text).mapInArrow(run, schema)


TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def normalized_tokens(text: str | None) -> list[str]:
    """Compatibility-composed, case-folded words with inner apostrophes."""
    return TOKEN.findall(unicodedata.normalize("NFKC", text or "").casefold())


def timestamp(us: Column) -> Column:
    """HH:MM:SS.mmm of microseconds, rounded down."""
    ms = F.floor(us / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def typed_id(namespace: str, *parts: Column) -> Column:
    """A stable identifier from a namespace and parts."""
    return F.concat(F.lit(f"{namespace}_"), F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256), 1, 32))


def token_estimate(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).cast("long")
