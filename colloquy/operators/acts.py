"""What acts, their targets, voice references, streams and vectors count as: lookups, equi-joins and states.

Everything is an expression or one join or aggregation on keys; no group is collected. Null attributes take
the default of their lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes of an act by its type, and the default of types that are not listed.
DOMAINS = {"procedural_question": "procedural", "embedded_or_quoted_question": "embedded_or_quoted"}
EXPLICITNESS = {"partial_answer": "partial", "qualified_answer": "qualified", "indirect_answer": "indirect", "candidate_answer_with_unresolved_target": "unresolved"}
POLARITY = {
    "affirmative_answer": "affirmative",
    "negative_answer": "negative",
    "answer_by_correction": "mixed",
    "answer_by_rejection_of_premise": "mixed",
    "answer_deferred": "not_applicable",
    "explicit_refusal_to_answer": "not_applicable",
    "inability_to_answer": "not_applicable",
}
CHALLENGES = {
    "evidence_challenge": "evidence",
    "definition_challenge": "definition",
    "procedural_objection": "procedure",
    "premise_challenge": "premise",
    "relevance_challenge": "relevance",
    "unsupported_generalized_challenge": "general",
    "counterexample_proposal": "content",
    "objection": "content",
    "challenge": "content",
    "disagreement": "content",
}
REBUTTALS = {
    "direct_rebuttal": "direct",
    "rebuttal_by_denial": "denial",
    "rebuttal_by_counterevidence": "counterevidence",
    "rebuttal_by_counterexample": "counterexample",
    "rebuttal_by_alternative_explanation": "alternative_explanation",
    "rebuttal_by_qualification": "qualification",
    "rebuttal_by_scope_correction": "scope_correction",
    "rebuttal_by_causal_challenge": "causal_challenge",
    "purported_rebuttal_with_unresolved_target": "unresolved",
}
QUALIFICATIONS = {
    "scope_qualification": "scope",
    "temporal_qualification": "temporal",
    "conditional_qualification": "conditional",
    "probabilistic_qualification": "probabilistic",
    "exception": "exception",
    "limitation": "limitation",
    "hedging": "hedging",
    "precision_correction": "precision",
    "category_restriction": "category",
    "threshold_qualification": "threshold",
}
EVENTS = {
    "floor_request": "floor_request",
    "floor_grant": "floor_grant",
    "floor_denial": "floor_denial",
    "turn_yield": "turn_yield",
    "time_warning": "time_warning",
    "time_expired_notice": "time_expired",
    "topic_transition": "topic_transition",
    "agenda_setting": "agenda_setting",
    "request_to_answer": "answer_request",
    "request_to_clarify": "clarification_request",
    "request_to_stop": "stop_request",
    "moderator_intervention": "moderator_instruction",
    "rule_invocation": "rule_event",
    "rule_explanation": "rule_event",
    "acknowledgment_of_procedure": "procedure_acknowledgment",
    "introduction": "opening_or_closing",
    "closing": "opening_or_closing",
    "greeting": "social_procedural",
    "thanks": "social_procedural",
    "apology": "social_procedural",
    "technical_interruption_notice": "technical_interruption",
    "procedural_question": "procedural_question",
}
EFFECTS = {
    "floor_request": "floor requested; no grant inferred",
    "floor_grant": "response interval opened; recipient may be unresolved",
    "floor_denial": "floor denial recorded; fault is not inferred",
    "turn_yield": "response interval closed by explicit yield",
    "time_warning": "time warning recorded",
    "time_expired_notice": "time expiration notice recorded",
    "topic_transition": "topic transition recorded",
    "agenda_setting": "agenda-setting instruction recorded",
    "request_to_answer": "answer request recorded; pending question target preserved",
    "request_to_clarify": "clarification request recorded",
    "request_to_stop": "stop request recorded; compliance is not inferred",
    "moderator_intervention": "moderator intervention recorded descriptively",
    "rule_invocation": "rule invocation recorded; violation is not inferred",
    "rule_explanation": "rule explanation recorded",
    "acknowledgment_of_procedure": "procedure acknowledgment recorded",
    "procedural_question": "procedural question recorded as pending",
}
OTHER_EFFECT = "procedural speech event recorded descriptively"
#: Act types of quotations by their kind.
QUOTATIONS = {
    "direct": "direct_quotation",
    "partial": "partial_quotation",
    "paraphrase": "paraphrase",
    "attributed_proposition": "attributed_position",
    "reported_speech": "reported_speech",
    "self_quotation": "self_quotation",
}
#: Fixed values: (attribute, lookup, default) of acts.
ATTRIBUTES = [
    ("domain", DOMAINS, "substantive"),
    ("explicitness", EXPLICITNESS, "explicit"),
    ("polarity", POLARITY, "unresolved"),
    ("challenge", CHALLENGES, None),
    ("rebuttal", REBUTTALS, None),
    ("qualification", QUALIFICATIONS, None),
    ("event_kind", EVENTS, None),
    ("effect", EFFECTS, OTHER_EFFECT),
]
#: Confidence by the state of a relation's target.
CONFIDENCE = {"identified": 0.9, "probable": 0.7, "multiple_candidate_targets": 0.5}
#: Least speech of a voice reference, licences that forbid one, bases that allow one.
LEAST_SPEECH_US = 2_000_000
FORBIDDEN, LAWFUL = ["restricted", "unknown"], ["consent_recorded", "lawful_basis_recorded"]
#: Kinds of streams.
STREAMS = ["video", "audio", "subtitle", "data", "attachment", "unknown", "unsupported"]


def looked_up(table: dict, key: Column, default: object = None) -> Column:
    """The table's value of a key, `default` where it has none; a literal map, so no join."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def attributes(acts: DataFrame, act_type: str = "act_type") -> DataFrame:
    """Acts with every attribute that follows from their type alone; null where none applies."""
    return acts.withColumns({name: looked_up(table, F.col(act_type), default) for name, table, default in ATTRIBUTES})


def reality(act_type: Column, quoted: Column) -> Column:
    """How real an example is: a hypothetical one first, then one that its utterance quotes, then a cited case or anecdote."""
    return F.when(act_type == "hypothetical_example", "hypothetical").when(quoted, "quoted").when(act_type.isin("case_citation", "anecdotal_example"), "real").otherwise("uncertain")


def target_status(candidates: Column) -> Column:
    """State of a target by the number of its candidates; null counts as none."""
    return F.when(candidates == 1, "probable").when(candidates > 1, "multiple_candidate_targets").otherwise("unresolved")


def explicit_targets(proposals: DataFrame, questions: DataFrame) -> DataFrame:
    """(act_id, question_id, role) of the questions that proposals of acts name.

    `proposals` are (act_id, target_type, target_status, target_id, alternative_ids), `questions` are
    (question_id, source_act_id, utterance_id). An id names a question by itself, its act or its utterance, as
    target_type says. Named by an identified or probable proposal it is a target, else an alternative; one
    that is both is a target. Ids that name nothing, and nulls, give no row.
    """
    ids = F.array_compact(F.concat(F.array("target_id"), F.coalesce("alternative_ids", F.array().cast(proposals.schema["alternative_ids"].dataType))))
    named = proposals.select("act_id", "target_type", F.coalesce(F.col("target_status").isin("identified", "probable"), F.lit(False)).alias("sure"), F.explode(ids).alias("id"))
    ways = [("question", "question_id"), ("discourse_act", "source_act_id"), ("utterance", "utterance_id")]
    known = questions.select("question_id", F.explode(F.array(*(F.struct(F.lit(t).alias("target_type"), F.col(c).alias("id")) for t, c in ways))).alias("k")).select("question_id", "k.*")
    found = named.join(known, ["target_type", "id"]).groupBy("act_id", "question_id").agg(F.max("sure").alias("sure"))
    return found.select("act_id", "question_id", F.when(F.col("sure"), "target").otherwise("alternative").alias("role"))


def term_peers(definitions: DataFrame, act: str, term: str) -> DataFrame:
    """(act, peers, first): how many other acts define the same term, letter case apart, and the smallest of the term's.

    Counts are joined back, so acts of a term are never paired. Null terms have no row.
    """
    d = definitions.where(F.col(term).isNotNull()).select(F.col(act).alias("act"), F.lower(term).alias("term"))
    of = d.groupBy("term").agg(F.count_distinct("act").alias("n"), F.min("act").alias("first"))
    return d.distinct().join(of, "term").select(F.col("act").alias(act), "term", (F.col("n") - 1).alias("peers"), "first")


def quotation_uses(acts: DataFrame, quotations: DataFrame) -> DataFrame:
    """(act_id, quotation_id, act_type): the smallest quotation of an act's utterance with the act's text, its kind as an act.

    `acts` are (act_id, utterance_id, text), `quotations` are (quotation_id, utterance_id, text, kind). Acts
    without one have no row.
    """
    q = quotations.groupBy("utterance_id", "text").agg(F.min(F.struct("quotation_id", "kind")).alias("q"))
    return acts.join(q, ["utterance_id", "text"]).select("act_id", "q.quotation_id", looked_up(QUOTATIONS, F.col("q.kind"), "uncertain_attribution").alias("act_type"))


def enrolled(references: DataFrame, least_us: int = LEAST_SPEECH_US) -> DataFrame:
    """References with `result` (valid, warning, invalid) and `findings`, those against it first.

    Of (license_status, lawful_use_status, audio_quality, speech_us, contamination); nulls count as unknown, or as no speech.
    """
    known = {c: F.coalesce(c, F.lit("unknown")) for c in ("license_status", "lawful_use_status", "audio_quality", "contamination")}
    against = [
        (known["license_status"].isin(FORBIDDEN), "license"),
        (~known["lawful_use_status"].isin(LAWFUL), "lawful_use"),
        (known["audio_quality"] == "unusable", "unusable_audio"),
        (F.coalesce("speech_us", F.lit(0)) < least_us, "short_speech"),
        (known["contamination"] == "contaminated", "contaminated"),
    ]
    doubts = [(known["audio_quality"] == "marginal", "marginal_audio"), (known["contamination"].isin("possible", "unknown"), "contamination_possible")]
    listed = [F.array_compact(F.array(*(F.when(test, name) for test, name in tests))) for tests in (against, doubts)]
    result = F.when(F.size("against") > 0, "invalid").when(F.size("doubts") > 0, "warning").otherwise("valid")
    return references.withColumns({"against": listed[0], "doubts": listed[1]}).withColumns({"result": result, "findings": F.concat("against", "doubts")}).drop("against", "doubts")


def enrolled_at(events: DataFrame, at_us: int, key: str = "reference_id") -> DataFrame:
    """(key, enrolled): whether the last event of each reference up to a time enrols it; a partial aggregation, no sort."""
    last = events.where(F.col("at_us") <= at_us).groupBy(key).agg(F.max(F.struct("at_us", "event_id", "kind")).alias("e"))
    return last.select(key, (F.col("e.kind") == "enrolled").alias("enrolled"))


def competing(hypotheses: DataFrame, target: list[str], identity: str, open_: Column) -> DataFrame:
    """(target, hypotheses, identities) where open hypotheses of one target and scope name different identities."""
    return hypotheses.where(open_).groupBy(*target).agg(F.count("*").alias("hypotheses"), F.count_distinct(identity).alias("identities")).where("identities > 1")


def timelines(sources: DataFrame) -> DataFrame:
    """Sources with (start_us, duration_us, variable_rate, status) on their own clock.

    The container's start, or the first of its streams', or 0; its duration, or up to the last stream's end.
    Frame rates "n/d" are compared across, so 60/2 equals 30/1; one that is missing or has no denominator is
    unknown and varies from nothing. Status: ok, unavailable (no duration), not_positive.
    """
    ends = [F.col(f"{s}_start_us") + F.col(f"{s}_duration_us") for s in ("audio", "video")]
    start = F.coalesce("container_start_us", F.least("audio_start_us", "video_start_us"), F.lit(0).cast("long"))
    part = {f"{r}{i}": F.when(F.col(f"{r}_rate").rlike(r"^[0-9]+(/0*[1-9][0-9]*)?$"), F.coalesce(F.try_element_at(F.split(f"{r}_rate", "/"), F.lit(i)), F.lit("1")).cast("decimal(19,0)")) for r in ("average", "real") for i in (1, 2)}
    rows = sources.withColumn("start_us", start).withColumn("duration_us", F.coalesce(F.col("container_duration_us"), F.greatest(*ends) - F.col("start_us")))
    differs = F.coalesce(part["average1"] * part["real2"] != part["real1"] * part["average2"], F.lit(False))
    status = F.when(F.col("duration_us").isNull(), "unavailable").when(F.col("duration_us") <= 0, "not_positive").otherwise("ok")
    return rows.withColumns({"variable_rate": differs, "status": status})


def stream_kind(codec_type: Column, attached_picture: Column) -> Column:
    """A stream's kind: an attached picture is an attachment whatever its type, an unlisted type is unknown."""
    return F.when(attached_picture, "attachment").when(codec_type.isin(STREAMS), codec_type).otherwise("unknown")


def is_candidate(kind: Column, media: str) -> Column:
    """Whether a stream may be chosen for audio or for video."""
    return kind == "audio" if media == "audio" else kind.isin("video", "attachment")


def vector_spaces(vectors: DataFrame, runs: DataFrame, run: str, space: list[str]) -> DataFrame:
    """(run, vectors, stored, verified, spaces, disposition) of every run, also those without a vector.

    Vectors may be compared where two or more share one space and all are stored and verified. More than one
    space, or a stored vector that fails its check, blocks a run.
    """
    kept = F.coalesce("stored", F.lit(False))
    n = vectors.groupBy(run).agg(F.count("*").alias("vectors"), F.sum(kept.cast("long")).alias("stored"), F.sum((kept & F.coalesce("verified", F.lit(False))).cast("long")).alias("verified"), F.count_distinct(F.struct(*space)).alias("spaces"))
    out = runs.select(run).distinct().join(n, run, "left").na.fill(0, ["vectors", "stored", "verified", "spaces"])
    state = F.when((F.col("verified") < F.col("stored")) | (F.col("spaces") > 1), "blocked_integrity").when((F.col("vectors") >= 2) & (F.col("stored") == F.col("vectors")), "qualified_for_controlled_comparison")
    return out.withColumn("disposition", state.when(F.col("vectors") > 0, "qualified_metadata_only").otherwise("insufficient_evidence"))
