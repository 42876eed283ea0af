from pyspark.sql import functions as F
from test_operators import rows

from colloquy.operators import acts


def test_attributes_and_reality(spark):
    a = spark.createDataFrame([("partial_answer", False), ("disagreement", True), ("hypothetical_example", True), ("anecdotal_example", False), ("closing", None), (None, None)], "act_type string, quoted boolean")
    got = [(r.act_type, r.domain, r.explicitness, r.polarity, r.challenge, r.event_kind, r.effect[:10], r.reality) for r in acts.attributes(a).withColumn("reality", acts.reality(F.col("act_type"), F.col("quoted"))).collect()]
    other = acts.OTHER_EFFECT[:10]
    assert got == [
        ("partial_answer", "substantive", "partial", "unresolved", None, None, other, "uncertain"),
        ("disagreement", "substantive", "explicit", "unresolved", "content", None, other, "quoted"),
        ("hypothetical_example", "substantive", "explicit", "unresolved", None, None, other, "hypothetical"),
        ("anecdotal_example", "substantive", "explicit", "unresolved", None, None, other, "real"),
        ("closing", "substantive", "explicit", "unresolved", None, "opening_or_closing", other, "uncertain"),
        (None, "substantive", "explicit", "unresolved", None, None, other, "uncertain"),
    ]
    n = spark.createDataFrame([(0,), (1,), (3,), (None,)], "n long").select(acts.target_status(F.col("n")).alias("s"))
    assert [(r.s, r.c) for r in n.select("s", acts.looked_up(acts.CONFIDENCE, F.col("s")).alias("c")).collect()] == [("unresolved", None), ("probable", 0.7), ("multiple_candidate_targets", 0.5), ("unresolved", None)]


def test_explicit_targets(spark):
    q = spark.createDataFrame([("q1", "a1", "u1"), ("q2", "a2", "u1"), ("q3", None, "u2")], "question_id string, source_act_id string, utterance_id string")
    p = spark.createDataFrame(
        [("x", "question", "identified", "q1", None), ("x", "utterance", "unresolved", None, ["u1", "u1"]), ("y", "discourse_act", "probable", "a2", ["a9", None]), ("z", "implicit", "identified", "q1", []), ("w", "utterance", None, "u2", ["u2"])],
        "act_id string, target_type string, target_status string, target_id string, alternative_ids array<string>",
    )
    assert rows(acts.explicit_targets(p, q), "act_id", "question_id", "role") == [("w", "q3", "alternative"), ("x", "q1", "target"), ("x", "q2", "alternative"), ("y", "q2", "target")]
    assert acts.explicit_targets(p.limit(0), q).count() == 0


def test_terms_and_quotations(spark):
    d = spark.createDataFrame([(1, "Dam"), (2, "dam"), (3, "weir"), (3, "weir"), (4, None)], "act long, term string")
    assert rows(acts.term_peers(d, "act", "term"), "act", "term", "peers", "first") == [(1, "dam", 1, 1), (2, "dam", 1, 1), (3, "weir", 0, 3)]
    a = spark.createDataFrame([(1, "u", "yes"), (2, "u", "no"), (3, None, "yes")], "act_id long, utterance_id string, text string")
    q = spark.createDataFrame([(9, "u", "yes", "direct"), (8, "u", "yes", "imitation"), (7, "v", "no", "direct")], "quotation_id long, utterance_id string, text string, kind string")
    assert rows(acts.quotation_uses(a, q), "act_id", "quotation_id", "act_type") == [(1, 8, "uncertain_attribution")]


def test_enrolment(spark):
    cols = "license_status string, lawful_use_status string, audio_quality string, speech_us long, contamination string"
    r = spark.createDataFrame(
        [("licensed", "consent_recorded", "acceptable", 2_000_000, "clean"), ("licensed", "consent_recorded", "marginal", 2_000_000, "possible"), ("restricted", "pending", "unusable", 1_999_999, "contaminated"), (None, None, None, None, None)], cols
    )
    assert [(x.result, x.findings) for x in acts.enrolled(r).collect()] == [
        ("valid", []),
        ("warning", ["marginal_audio", "contamination_possible"]),
        ("invalid", ["license", "lawful_use", "unusable_audio", "short_speech", "contaminated"]),
        ("invalid", ["license", "lawful_use", "short_speech", "contamination_possible"]),
    ]
    e = spark.createDataFrame([("a", 1, 1, "enrolled"), ("a", 5, 2, "revoked"), ("b", 5, 3, "revoked"), ("b", 5, 4, "enrolled"), ("c", 9, 5, "enrolled")], "reference_id string, at_us long, event_id long, kind string")
    assert rows(acts.enrolled_at(e, 4), "reference_id", "enrolled") == [("a", True)]
    assert rows(acts.enrolled_at(e, 5), "reference_id", "enrolled") == [("a", False), ("b", True)]
    h = spark.createDataFrame([("t", "s", "x", True), ("t", "s", "y", True), ("t", "r", "y", True), ("v", "s", "x", True), ("v", "s", "z", False)], "target string, scope string, identity string, open boolean")
    assert rows(acts.competing(h, ["target", "scope"], "identity", F.col("open")), "target", "scope", "hypotheses", "identities") == [("t", "s", 2, 2)]


def test_timelines_and_streams(spark):
    cols = "k long, container_start_us long, container_duration_us long, audio_start_us long, audio_duration_us long, video_start_us long, video_duration_us long, average_rate string, real_rate string"
    s = spark.createDataFrame(
        [(1, 5, 9, 0, 1, 0, 1, "30/1", "60/2"), (2, None, None, 7, 10, 3, 2, "30000/1001", "30/1"), (3, None, None, None, 4, None, 4, "0/0", "25"), (4, 9, None, 1, 8, None, None, None, "25/0"), (5, None, 0, None, None, None, None, "25", "25/1")], cols
    )
    assert rows(acts.timelines(s), "k", "start_us", "duration_us", "variable_rate", "status") == [(1, 5, 9, False, "ok"), (2, 3, 14, True, "ok"), (3, 0, None, False, "unavailable"), (4, 9, 0, False, "not_positive"), (5, 0, 0, False, "not_positive")]
    k = spark.createDataFrame([("video", True), ("audio", None), ("dvb", False), (None, False)], "c string, p boolean").select(acts.stream_kind(F.col("c"), F.col("p")).alias("kind"))
    assert [(r.kind, r.v) for r in k.select("kind", acts.is_candidate(F.col("kind"), "video").alias("v")).collect()] == [("attachment", True), ("audio", False), ("unknown", False), ("unknown", False)]


def test_vector_spaces(spark):
    v = spark.createDataFrame([(1, "m", True, True), (1, "m", True, True), (2, "m", True, True), (2, "n", True, True), (3, "m", True, False), (4, "m", False, None), (4, "m", True, True), (6, None, True, True)], "run long, space string, stored boolean, verified boolean")
    got = rows(acts.vector_spaces(v, spark.range(1, 7).withColumnRenamed("id", "run"), "run", ["space"]), "run", "vectors", "stored", "verified", "spaces", "disposition")
    assert got == [(1, 2, 2, 2, 1, "qualified_for_controlled_comparison"), (2, 2, 2, 2, 2, "blocked_integrity"), (3, 1, 1, 0, 1, "blocked_integrity"), (4, 2, 1, 1, 1, "qualified_metadata_only"), (5, 0, 0, 0, 0, "insufficient_evidence"), (6, 1, 1, 1, 1, "qualified_metadata_only")]
