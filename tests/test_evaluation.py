import random

from colloquy.operators import evaluation as E
from colloquy.operators import matching as M

ACT = "k long, act_id string, family string, type string, targets array<string>, alternatives array<string>, affected boolean, review boolean, confidence double"


def acts(spark, *rows):
    return spark.createDataFrame(list(rows), ACT)


def test_discourse_report_counts_what_it_says(spark):
    r = acts(
        spark, (1, "r1", "question", "q.a", None, ["q.b", "q.c"], True, None, None), (1, "r2", "answer", "a.x", ["r1", "r1"], None, False, True, None), (2, "r3", "unknown", "u", [], [], None, True, None), (2, "r4", "answer", "a.x", ["z"], None, True, None, None), (3, "r5", "example", "e", ["r1"], None, None, None, None),
    )
    s = acts(spark, (1, "s1", "question", "q.b", None, None, None, None, 0.75), (1, "s2", "answer", "a.x", ["r1"], None, None, None, 1.0), (2, "s3", "unknown", "u", None, None, None, None, None), (2, "s4", "answer", "a.x", ["z", "y"], None, None, None, 0.5), (4, "s5", "question", "q.a", None, None, None, None, 0.0))
    spans = spark.createDataFrame([(0.5,), (1.0,)], "iou double")
    counts = spark.createDataFrame([(5, 4)], "n_reference long, n_system long")
    one = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "act_id string")
    rows = E.discourse_report(r, s, s.select("k", "type"), ["k"], spans, counts, one(1, 9), ids("s1"), ids("s2", "s3", "s1"), one(2)).collect()
    got = {x.metric: (x.numerator, x.denominator, x.value, x.not_applicable) for x in rows}
    assert len(rows) == len(got) == 28
    assert got["act_family_precision"][:2] == (4, 5) and got["act_family_recall"][:2] == (4, 5) and got["act_family_f1"] == (8, 10, 0.8, False)
    assert got["act_type_precision"][:2] == (3, 5) and got["act_type_recall"][:2] == (3, 5)
    assert got["multi_label_exact_match"][:2] == (1, 4) and got["multi_label_partial_match"][:2] == (round(1 / 3 + 1, 9), 4)
    assert got["evidence_span_precision"][:2] == (2, 4) and got["evidence_span_recall"][:2] == (2, 5) and got["evidence_span_overlap"] == (1.5, 2, 0.75, False)
    assert got["relation_target_accuracy"][:2] == (1, 3) and got["answer_link_accuracy"][:2] == (1, 2) and got["example_target_accuracy"][:2] == (0, 1)
    assert got["question_type_accuracy"][:2] == (0, 1) and got["unknown_state_appropriateness"][:2] == (1, 1)
    assert got["rebuttal_target_accuracy"] == (0, 0, None, True)
    assert got["alternative_candidate_recall"][:2] == (1, 2)
    assert got["confidence_reliability"][:2] == (0.25 + 1.0 + 0.5 + 1.0, 4)
    assert got["correction_propagation_completeness"][:2] == (1, 2) and got["unaffected_artifact_stability"][:2] == (2, 4) and got["human_review_impact"][:2] == (1, 2)
    empty = E.discourse_report(r.limit(0), s.limit(0), s.limit(0).select("k", "type"), ["k"], spans.limit(0), counts.where("false"), one().where("false"), ids(), ids(), one()).collect()
    assert len(empty) == 28 and all(x.not_applicable and x.value is None for x in empty)


PAIR = ", ".join(f"{side}_{c} {kind}" for c, kind in dict(status="string", target="string", completeness="string", overlap="boolean", self_repair="boolean", quoted="string", quotation="string", quoted_speaker="string", affected="boolean", review="boolean").items() for side in "rs") + ", s_stable boolean"


def test_utterance_report_counts_what_it_says(spark):
    rows = [
        ("unknown", "unknown", None, None, "complete", "fragment", True, True, False, False, None, None, None, None, None, None, True, True, True, None, None),
        ("bound", "bound", "p", "q", "fragment", "fragment", False, None, True, False, "x", "x", "direct", "reported", "z", "z", False, None, False, True, True),
        (None, None, "p", "p", None, None, None, None, None, None, "x", None, "direct", None, None, None, None, None, None, None, None),
    ]
    matched = spark.createDataFrame(rows, PAIR)
    links = lambda *p: spark.createDataFrame(list(p), "left long, right long")
    bounds = spark.createDataFrame([(4, 5, 3, 90)], "n_reference long, n_system long, matched long, error_us long")
    agree = spark.createDataFrame([(9, 10)], "agreeing long, pairs long")
    windows = spark.createDataFrame([(True, True, True), (None, False, None), (False, None, None)], "reproduced boolean, truncated boolean, excluded boolean")
    out = E.utterance_report(matched, (links((1, 2), (2, 3), (2, 3)), links((1, 2), (5, 6), (7, 8))), (links((1, 2)), links()), bounds, agree, windows).collect()
    got = {x.metric: (x.numerator, x.denominator) for x in out}
    assert len(out) == len(got) == 20
    assert got == {
        "utterance_boundary_precision": (3, 5), "utterance_boundary_recall": (3, 4), "boundary_timing_error_microseconds": (90, 3), "utterance_segmentation_similarity": (9, 10), "speaker_attribution_accuracy": (2, 3), "unknown_attribution_appropriateness": (1, 1),
        "incomplete_utterance_classification_accuracy": (1, 1), "overlap_preservation_accuracy": (2, 3), "self_repair_detection_accuracy": (2, 3), "quotation_span_accuracy": (1, 2), "quotation_type_accuracy": (0, 2), "quoted_speaker_attribution_accuracy": (1, 1),
        "correction_propagation_completeness": (1, 1), "unaffected_artifact_stability": (1, 1), "manual_review_impact": (0, 1), "context_window_reproducibility": (1, 3), "context_truncation_correctness": (2, 3), "interruption_detection_precision": (1, 3), "interruption_detection_recall": (1, 2), "continuation_link_accuracy": (0, 1),
    }


def test_many_speakers_are_mapped_best(spark):
    rng = random.Random(3)
    for _ in range(150):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        w = {(f"s{i}", f"r{j}"): rng.randrange(9) for i in range(n) for j in range(m) if rng.random() < 0.7}
        pairs = M.assigned_many(w)
        assert len({s for s, _ in pairs}) == len({r for _, r in pairs}) == len(pairs) and all(w[p] > 0 for p in pairs)
        assert sum(w[p] for p in pairs) == M.assigned(w)[0]
    big = {(f"s{i:02}", f"r{j:02}"): 1000 if (i * 7) % 40 == j else rng.randrange(900) for i in range(40) for j in range(40)}
    assert dict(M.assigned_many(big)) == {f"s{i:02}": f"r{i * 7 % 40:02}" for i in range(40)}
    rows = [(1, s, r, w) for (s, r), w in big.items()] + [(2, "a", "x", 5), (2, "a", "y", 5), (2, "b", "x", 5)]
    got = M.speaker_mapping(spark.createDataFrame(rows, "corpus_id long, system string, reference string, weight_us long")).collect()
    assert sum(r.weight_us for r in got if r.corpus_id == 1) == 40_000
    assert sorted((r.system, r.reference) for r in got if r.corpus_id == 2) == [("a", "y"), ("b", "x")]


def test_a_renamed_system_has_no_error_after_mapping(spark):
    ref = spark.createDataFrame([(1, "A", 0, 100), (1, "B", 100, 200), (2, "A", 0, 50)], "corpus_id long, label string, start_us long, end_us long")
    names = {"A": "B", "B": "C"}
    system = spark.createDataFrame([(1, names["A"], 0, 100), (1, names["B"], 100, 200), (2, "B", 0, 40), (2, "A", 60, 70)], "corpus_id long, label string, start_us long, end_us long")
    mapping = M.speaker_mapping(M.co_activity(ref, system, 1000))
    said = M.relabelled(system, mapping)
    assert sorted((r.corpus_id, r.label, r.start_us) for r in said.collect()) == [(1, "A", 0), (1, "B", 100), (2, "A", 0), (2, "unmapped: A", 60)]
    got = {r.corpus_id: (r.reference_us, r.correct_us, r.missed_us, r.false_alarm_us, r.confusion_us, r.der) for r in M.error_components(ref, said, 0, 1000).collect()}
    assert got == {1: (200, 200, 0, 0, 0, 0.0), 2: (50, 40, 10, 10, 0, 0.4)}
