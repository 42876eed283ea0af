import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import views as V

SCHEMA = "corpus_id long, pos long, start_us long, source_us long, status string, label string, display string, corrected string, intervals int, group_no long, lane int"


def test_six_views_and_every_loss(spark):
    rows = [
        (1, 0, 0, 3_600_000_000, "machine_clustered", "A", "first", "First", 1, 0, 0), (1, 1, 5, 5_000, "manually_bound", "P", "second", None, 2, 0, 1), (1, 2, 50, 50_000, "conflicting", "P", "third", None, 1, 1, 0),
        (1, 3, 60, 60_000, "unknown", "Q", "", None, 1, 2, 0), (1, 4, 70, 70_000, None, None, None, None, 1, 3, 0), (2, 0, 0, 0, "role_labeled", "host", "x", "y", 1, 0, 0),
    ]
    u = spark.createDataFrame(rows, SCHEMA)
    near = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "a")], "corpus_id long, pos long, detail string")
    every = {m: near.where("pos = 1").select("corpus_id", "pos") for m in V.MARKERS if m != "overlap"}
    marks = V.marked(["corpus_id", "pos"], overlap=near, **every)
    got = {r.pos: (list(r.markers), list(r.details)) for r in marks.collect()}
    assert got == {0: (["overlap"], ["a", "b"]), 1: (sorted(V.MARKERS), ["a"])}
    lines, losses = V.rendered(u, marks)
    text = {(r.view, r.corpus_id, r.pos): r.line for r in lines.collect()}
    assert len(text) == 6 * len(rows)
    assert text["machine_speaker_cluster", 1, 0] == "01:00:00.000 [0] A: <overlap> first"
    assert text["reviewed_participant_identity", 1, 0] == "01:00:00.000 [0] UNKNOWN: <overlap> first"
    assert text["correction_aware", 1, 0] == "01:00:00.000 [0] A: <overlap> First"
    assert text["overlap_expanded", 1, 0] == "01:00:00.000 [lane=0] [0] A: <overlap> first"
    assert text["compact_reading", 1, 2] == "00:00:00.050 CONFLICT:  third"
    assert text["unknown_preserving", 1, 3] == "00:00:00.060 [3] UNKNOWN:" and text["unknown_preserving", 1, 4] == "00:00:00.070 [4] UNKNOWN:"
    assert text["reviewed_participant_identity", 2, 0] == "00:00:00.000 [0] host:  x"
    lost = {}
    for r in losses.collect():
        lost.setdefault((r.view, r.kind), set()).add((r.corpus_id, *r.utterances))
    everyone = {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)}
    assert lost["machine_speaker_cluster", "machine_cluster_label_unavailable"] == everyone - {(1, 0)}
    assert lost["reviewed_participant_identity", "reviewed_identity_label_unavailable"] == everyone - {(1, 1), (2, 0)}
    assert lost["correction_aware", "corrected_text_unavailable"] == everyone - {(1, 0), (2, 0)}
    for view in V.VIEWS:
        linear = view != "overlap_expanded"
        assert lost.get((view, "overlap_linearized")) == ({(1, 0, 1)} if linear else None)
        assert lost.get((view, "noncontiguous_intervals_linearized")) == ({(1, 1)} if linear else None)
    with pytest.raises(ValueError, match="no such marker"):
        V.marked(["corpus_id", "pos"], wonder=near)


def unmarked(text, kinds):
    for k in kinds:
        text = text.replace(f"<{k}>", "").replace(f"</{k}>", "")
    return text


def test_offsets_map_through_insertions():
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice("abé🙂 ") for _ in range(rng.randrange(12)))
        marks = [(a, b, f"k{i}") for i in range(rng.randrange(5)) for a, b in [sorted(rng.randrange(len(text) + 1) for _ in range(2))]]
        out, places, losses = V.splice(text, marks)
        kinds = [m[2] for m in marks]
        assert unmarked(out, kinds) == text
        for (a, b, k), (x, y) in zip(marks, places, strict=True):
            assert out[x - len(k) - 2 : x] == f"<{k}>" and out[y : y + len(k) + 3] == f"</{k}>"
            assert unmarked(out[x:y], kinds) == text[a:b]
        crossing = any(a < c < b < d for i, (a, b, _) in enumerate(marks) for c, d, _ in marks)
        assert bool(losses) == crossing
    assert V.splice("abcd", [(0, 4, "x"), (0, 2, "y"), (2, 4, "z"), (2, 2, "e")]) == ("<x><y>ab</y><z><e></e>cd</z></x>", [(3, 28), (6, 8), (15, 24), (18, 18)], [])
    assert V.splice("ab", [(1, 9, "x"), (3, 4, "y"), (2, 1, "z"), (None, 1, "n")]) == ("a<x>b</x>", [(4, 5), (-1, -1), (-1, -1), (-1, -1)], ["clipped", "unplaced", "unplaced", "unplaced"])


def test_spliced_rows_take_nulls(spark):
    df = spark.createDataFrame([(1, "ab", [(0, 1, "x"), None], 9), (2, None, None, 9), (3, "q", [], 9)], "id int, text string, marks array<struct<start: int, end: int, kind: string>>, places int")
    got = {r.id: (r.text, [tuple(p) for p in r.places], list(r.losses)) for r in V.spliced(df, ["id"], "text", "marks").collect()}
    assert got == {1: ("<x>a</x>b", [(3, 4)], []), 2: ("", [], []), 3: ("q", [], [])}


def test_participants_cues(spark):
    span = "array<struct<kind: string, reviewed: array<string>, machine: array<string>, overlap: boolean>>"
    long = " ".join(["word"] * 20)
    rows = [
        (1, 1_000, 2_000, "a b", "a b", [("machine_cluster", None, ["A"], False)]),
        (2, 1_500, 1_600, " a  b", "a b", [("bound", ["P"], ["A"], True), ("machine_cluster", [], ["A"], False), ("bound", ["P"], None, None)]),
        (3, 0, 8_000_000, long, long, [("unattributed", None, None, False), ("unknown", None, None, False)]),
        (4, 0, 1_000, "a", "a", [("conflicted", ["P"], None, False)]),
        (5, 0, 1_000, "", " ", [("bound", ["P"], None, False)]),
        (6, 0, 1_000, "a", "a", None),
    ]
    df = spark.createDataFrame(rows, f"id int, start_us long, end_us long, text string, normalized string, spans {span}")
    got = {r.id: r for r in V.participant_cues(df, ["id"]).collect()}
    assert (got[1].start_ms, got[1].end_ms, got[1].label, list(got[1].lines), got[1].unresolved, got[1].overlap, list(got[1].losses), got[1].refused) == (1, 2, "A", ["A", "a b"], False, False, [], None)
    assert (got[2].start_ms, got[2].end_ms, got[2].label, got[2].overlap, list(got[2].losses)) == (1, 2, "OVERLAP: P | A", True, V.CUE_LOSSES[:3])
    assert got[3].label == "UNATTRIBUTED | REVIEWED: UNKNOWN" and got[3].unresolved and list(got[3].losses) == V.CUE_LOSSES[2:]
    assert [len(x) <= V.LINE for x in got[3].lines] == [True] * 4 and " ".join(got[3].lines[1:]) == long
    assert (got[4].refused, got[4].label, got[5].refused, got[5].lines) == ("conflicted", None, "empty", None)
    assert (got[6].label, got[6].refused, got[6].unresolved) == ("", None, False)
    assert df.select(F.count("*")).first()[0] == len(got)
