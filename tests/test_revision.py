import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import corrections as C
from colloquy.operators import propagation as P
from colloquy.operators import word_alignment as A
from colloquy.operators.matching import edit_counts

COLUMNS = {"text": ["text"], "boundary": ["end_us"], "speaker_attribution": ["who"], "display_label_only": ["label"], "quotation_structure": ["quoted"], "interruption_or_continuation": ["cut"]}
SCHEMA = "k long, text string, end_us long, who string, label string, quoted boolean, cut boolean"


def test_change_kinds_are_null_safe_and_name_every_change(spark):
    before = spark.createDataFrame([(1, "a", 5, "x", "X", False, None), (2, None, 5, "x", "X", False, None), (3, "a", 5, "x", "X", False, None), (4, "a", 5, "x", "X", False, None), (5, "a", 5, None, "X", False, None), (7, "a", 5, "x", "X", False, None)], SCHEMA)
    after = spark.createDataFrame([(1, "a", 5, "x", "X", False, None), (2, None, 5, "x", "Y", False, None), (3, "b", 6, "y", "Y", True, True), (5, "a", 5, "x", "Y", False, None), (6, "n", 5, "x", "X", False, None), (7, "", 5, "x", "X", False, None)], SCHEMA)
    got = {r.k: list(r.kinds) for r in P.change_kinds(before, after, ["k"], COLUMNS).collect()}
    assert got == {
        2: ["display_label_only"],
        3: ["text", "boundary", "speaker_attribution", "quotation_structure", "interruption_or_continuation"],
        4: ["removed_utterance"],
        5: ["speaker_attribution"],
        6: ["added_utterance"],
        7: ["text"],
    }


def test_impacts_follow_dependencies_only(spark):
    changes = spark.createDataFrame([(1, ["text"]), (2, ["display_label_only"]), (3, ["quotation_structure"]), (4, ["speaker_attribution"]), (5, ["speaker_attribution"]), (6, ["interruption_or_continuation"])], "k long, kinds array<string>")
    obs = spark.createDataFrame([(k, f"o{k}{n}", f) for k in range(1, 8) for n, f in enumerate(["assertive", "quotation_and_attribution"])], "k long, observation_id string, family string")
    sets = obs.select("k", F.concat(F.lit("s"), "observation_id").alias("set_id"), F.array("observation_id").alias("observation_ids"))
    acts = sets.select("k", F.concat(F.lit("a"), "set_id").alias("act_id"), "set_id")
    got = {r.k: r for r in P.impacts(changes, obs, sets, acts, ["k"], changes.where("k = 5").select("k")).collect()}
    assert {k: list(r.invalidated_observations) for k, r in got.items()} == {1: ["o10", "o11"], 2: [], 3: ["o31"], 4: [], 5: ["o50", "o51"], 6: []}
    assert list(got[3].invalidated_acts) == list(got[3].rebuild_relations) == ["aso31"] and list(got[3].preserved_acts) == ["aso30"]
    assert list(got[6].preserved_acts) == list(got[6].rebuild_relations) == ["aso60", "aso61"] and list(got[6].invalidated_sets) == []
    assert list(got[1].invalidated_sets) == ["so10", "so11"] and list(got[2].preserved_acts) == ["aso20", "aso21"]


def plain_reach(seeds, edges):
    seen, now, step = {s: 0 for s in seeds}, set(seeds), 0
    while now:
        step += 1
        now = {b for a, b in edges if a in now} - seen.keys()
        seen |= dict.fromkeys(now, step)
    return seen


def test_reached_ends_on_cycles_and_hubs(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("hub", f"h{i}") for i in range(500)] + [(f"h{i}", "hub") for i in range(0, 500, 7)] + [("n1", "hub"), ("x", "x"), (None, "n1"), ("n2", None)] + [("x", "y"), ("y", "x")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    for seeds in (["n1"], ["x"], ["n5", "n6", "n5", "absent"]):
        got = P.reached(spark.createDataFrame([(s,) for s in [*seeds, None]], "node string"), frame).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.round for r in got} == plain_reach(seeds, [e for e in edges if None not in e])
    one = P.reached(spark.createDataFrame([("x",)], "node string"), frame, 1).collect()
    assert {(r.node, r.round) for r in one} == {("x", 0), ("y", 1)}
    assert P.reached(spark.createDataFrame([], "node string"), frame).collect() == []


def test_reached_takes_few_steps_for_a_long_chain(spark, monkeypatch):
    steps = []
    plain = P.kept
    monkeypatch.setattr(P, "kept", lambda df, name: steps.append(name) or plain(df, name))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("c40", "side"), ("side", "c100")]
    got = P.reached(spark.createDataFrame([("c0",), ("c250",)], "node string"), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.round for r in got} == plain_reach(["c0", "c250"], edges)
    assert len(steps) < 60


def segment(i, a, b, text, **more):
    return {"segment_id": i, "start_us": a, "end_us": b, "text": text, "normalized": C.normalized(text), "language": None, "alternatives": [], "annotations": [], "fixed": False} | more


def value(a, b, text, **more):
    return {"start_us": a, "end_us": b, "text": text, "normalized": C.normalized(text), "language": None, "annotation": None, "candidate": None} | more


def entry(seq, kind, targets, prior, proposed, **more):
    return {"seq": seq, "kind": kind, "actor": "human", "references": ["r"], "from_us": 0, "to_us": 100, "targets": targets, "prior": prior, "proposed": proposed} | more


STATE = [segment("a", 0, 10, "one two"), segment("b", 10, 20, "three", alternatives=["alt"]), segment("c", 20, 30, "four"), segment("d", 40, 50, "five")]
A_, B_, C_, D_ = (value(x["start_us"], x["end_us"], x["text"]) for x in STATE)


@pytest.mark.parametrize(
    ("kind", "targets", "prior", "proposed", "more", "reason"),
    [
        ("replacement", ["a"], [A_], [value(0, 10, "two")], {}, None),
        ("replacement", ["a"], [A_], [value(0, 9, "two")], {}, "bounds_changed"),
        ("replacement", ["a"], [A_], [A_], {}, "nothing_changed"),
        ("replacement", ["a"], [B_], [value(0, 10, "two")], {}, "stale_prior"),
        ("replacement", ["q"], [A_], [value(0, 10, "two")], {}, "unknown_target"),
        ("replacement", ["a"], [A_], [value(0, 10, "two", normalized="x")], {}, "not_normalized"),
        ("replacement", ["a"], [A_], [value(0, 10, "two")], {"references": []}, "no_reference"),
        ("replacement", ["a"], [A_], [value(0, 10, "two")], {"actor": "nobody"}, "actor_excluded"),
        ("replacement", ["a"], [A_], [value(0, 10, "two")], {"to_us": 9}, "not_covered"),
        ("invention", ["a"], [A_], [value(0, 10, "two")], {}, "unknown_kind"),
        ("insertion", ["c"], [], [value(30, 40, "new")], {}, None),
        ("insertion", ["c"], [], [value(30, 41, "new")], {}, "overlaps"),
        ("insertion", ["c"], [], [], {}, "wrong_count"),
        ("deletion", ["a", "b"], [A_, B_], [], {}, None),
        ("deletion", ["a", "c"], [A_, C_], [], {}, "not_adjacent"),
        ("deletion", ["b", "a"], [B_, A_], [], {}, "not_adjacent"),
        ("deletion", ["a"], [A_], [A_], {}, "wrong_count"),
        ("split", ["a"], [A_], [value(0, 4, "one"), value(4, 10, "two")], {}, None),
        ("split", ["a"], [A_], [value(0, 4, "one"), value(5, 10, "two")], {}, "not_contiguous"),
        ("split", ["a"], [A_], [value(0, 4, "one"), value(4, 9, "two")], {}, "not_outer_span"),
        ("split", ["a"], [A_], [value(0, 10, "one two")], {}, "wrong_count"),
        ("split", ["a"], [A_], [value(0, 0, ""), value(0, 10, "one two")], {}, "empty_interval"),
        ("merge", ["a", "b"], [A_, B_], [value(0, 20, "one two three")], {}, None),
        ("merge", ["c", "d"], [C_, D_], [value(20, 50, "four five")], {}, None),
        ("merge", ["a", "b"], [A_, B_], [value(0, 19, "one two three")], {}, "not_outer_span"),
        ("merge", ["a"], [A_], [A_], {}, "wrong_count"),
        ("boundary_adjustment", ["c"], [C_], [value(21, 35, "four")], {}, None),
        ("boundary_adjustment", ["c"], [C_], [value(19, 30, "four")], {}, "overlaps"),
        ("boundary_adjustment", ["c"], [C_], [value(21, 30, "for")], {}, "content_changed"),
        ("boundary_adjustment", ["c"], [C_], [C_], {}, "nothing_changed"),
        ("language_correction", ["c"], [C_], [value(20, 30, "four", language="en")], {}, None),
        ("language_correction", ["c"], [C_], [C_], {}, "nothing_changed"),
        ("language_correction", ["c"], [C_], [value(20, 30, "for", language="en")], {}, "content_changed"),
        ("normalization_only", ["c"], [C_], [value(20, 30, "four", normalized="4")], {}, None),
        ("normalization_only", ["c"], [C_], [value(20, 30, "4", normalized="4")], {}, "content_changed"),
        ("uncertainty_annotation", ["c"], [C_], [value(20, 30, "four", annotation="unclear")], {}, None),
        ("uncertainty_annotation", ["c"], [C_], [C_], {}, "no_annotation"),
        ("restore_earlier_candidate", ["b"], [B_], [value(10, 20, "free", candidate="alt")], {}, None),
        ("restore_earlier_candidate", ["b"], [B_], [value(10, 20, "free", candidate="other")], {}, "no_alternative"),
        ("restore_earlier_candidate", ["b"], [B_], [value(10, 21, "free", candidate="alt")], {}, "bounds_changed"),
    ],
)
def test_each_kind_has_its_reasons(kind, targets, prior, proposed, more, reason):
    state, told = C.replayed([dict(x) for x in STATE], [entry(1, kind, targets, prior, proposed, **more)])
    assert told == [(1, reason)]
    if reason:
        assert [x["segment_id"] for x in state] == ["a", "b", "c", "d"]
    else:
        left = [x["segment_id"] for x in STATE if kind == "insertion" or x["segment_id"] not in targets]
        assert sorted(x["segment_id"] for x in state) == sorted([*left, *(f"c1.{n}" for n in range(len(proposed)))])
        assert [x["start_us"] for x in state] == sorted(x["start_us"] for x in state)


def test_entries_see_what_earlier_ones_left():
    one, two = value(0, 4, "one"), value(4, 10, "two")
    batch = [
        entry(3, "merge", ["c1.1", "b"], [two, B_], [value(4, 20, "two three")]),
        entry(1, "split", ["a"], [A_], [one, two]),
        entry(2, "uncertainty_annotation", ["c1.0"], [one], [value(0, 4, "one", annotation="?")]),
        entry(4, "replacement", ["a"], [A_], [value(0, 10, "gone")]),
        entry(5, "insertion", ["c3.0"], [], [value(30, 40, "new")]),
        entry(6, "deletion", ["c2.0"], [one], []),
    ]
    state, told = C.replayed([dict(x) for x in STATE], batch)
    assert told == [(1, None), (2, None), (3, None), (4, "unknown_target"), (5, None), (6, None)]
    assert [(x["segment_id"], x["text"]) for x in state] == [("c3.0", "two three"), ("c", "four"), ("c5.0", "new"), ("d", "five")]


def random_batch(rng, segs):
    """Entries that often fit: drawn from a state of their own, in which each is tried."""
    state, out = [dict(x) for x in segs], []
    for seq in range(rng.randrange(1, 12)):
        if not state:
            break
        i = rng.randrange(len(state))
        x = state[i]
        own, a, b = value(x["start_us"], x["end_us"], x["text"], normalized=x["normalized"], language=x["language"]), x["start_us"], x["end_us"]
        kind = rng.choice(C.KINDS)
        targets, prior, new = [x["segment_id"]], [own], []
        if kind == "insertion":
            prior, new = [], [value(b, b + rng.randrange(1, 8), "ins")]
        elif kind == "split":
            new = [value(a, (a + b) // 2, "l"), value((a + b) // 2, b, "r")]
        elif kind == "merge" and i + 1 < len(state):
            y = state[i + 1]
            targets, prior = [*targets, y["segment_id"]], [own, value(y["start_us"], y["end_us"], y["text"], normalized=y["normalized"], language=y["language"])]
            new = [value(a, y["end_us"], "both")]
        elif kind == "boundary_adjustment":
            new = [{**own, "end_us": b + rng.randrange(-3, 5)}]
        elif kind == "language_correction":
            new = [{**own, "language": "de"}]
        elif kind == "normalization_only":
            new = [{**own, "normalized": "n"}]
        elif kind == "uncertainty_annotation":
            new = [{**own, "annotation": "?"}]
        elif kind == "restore_earlier_candidate":
            new = [value(a, b, "alt", candidate="alt")]
        elif kind == "replacement":
            new = [value(a, b, "text")]
        if rng.random() < 0.1 and prior:
            prior = [{**prior[0], "text": "stale"}, *prior[1:]]
        times = [t for y in [*prior, own, *new] for t in (y["start_us"], y["end_us"])]
        e = entry(seq, kind, targets, prior, new, from_us=min(times), to_us=max(times))
        out.append(e)
        state, _ = C.replayed(state, [e])
    return out


def test_islands_replay_as_whole_recordings_do(spark):
    rng = random.Random(12)
    segs, asked, want = [], [], []
    for k in range(25):
        at, mine = 0, []
        for i in range(rng.randrange(1, 25)):
            at += rng.choice([0, 0, 3])
            mine.append(segment(f"s{i}", at, at + rng.randrange(4, 10), f"t{i}", alternatives=["alt"] if i % 2 else []))
            at = mine[-1]["end_us"]
        batch = random_batch(rng, mine)
        after, told = C.replayed([dict(x) for x in mine], batch)
        want.append((k, [(x["segment_id"], x["start_us"], x["end_us"], x["text"], tuple(x["annotations"])) for x in after], sorted(told)))
        segs += [(k, *(x[n] for n in ("segment_id", "start_us", "end_us", "text", "normalized", "language", "alternatives", "annotations")), "extra") for x in mine]
        asked += [(k, e["seq"], e["kind"], e["actor"], e["references"], e["from_us"], e["to_us"], e["targets"], e["prior"], e["proposed"]) for e in batch]
    segments = spark.createDataFrame(segs, f"corpus_id long, {C.SEGMENT}, island string")
    entries = spark.createDataFrame(asked, f"corpus_id long, seq int, kind string, actor string, references array<string>, from_us long, to_us long, targets array<string>, prior {C.PRIOR}, proposed {C.PROPOSED}")
    current, told = C.replay(segments, entries)
    now, said = {}, {}
    for r in current.collect():
        now.setdefault(r.corpus_id, []).append((r.segment_id, r.start_us, r.end_us, r.text, tuple(r.annotations)))
    for r in told.collect():
        said.setdefault(r.corpus_id, []).append((r.seq, r.reason))
        assert (r.status == "applied") == (r.reason is None)
    reasons = set()
    for k, after, expected in want:
        assert sorted(now.get(k, [])) == sorted(after)
        assert sorted(said[k], key=lambda x: x[0]) == expected
        reasons |= {r for _, r in expected}
    assert {None, "overlaps", "stale_prior"} <= reasons
    assert C.revision_findings(segments, entries, told, current).collect() == []


def test_replay_of_odd_rows(spark):
    segments = spark.createDataFrame([(1, "a", 0, 10, "x", "x", None, None, None), (1, "n", None, None, "y", "y", None, None, None), (2, "b", 0, 5, None, "", None, None, None)], f"corpus_id long, {C.SEGMENT}")
    schema = f"corpus_id long, seq int, kind string, actor string, references array<string>, from_us long, to_us long, targets array<string>, prior {C.PRIOR}, proposed {C.PROPOSED}"
    none = spark.createDataFrame([], schema)
    current, told = C.replay(segments, none)
    assert sorted(r.segment_id for r in current.collect()) == ["a", "b", "n"] and told.collect() == []
    odd = spark.createDataFrame([(1, 1, "deletion", "human", ["r"], None, 5, ["a"], None, None), (1, 2, "deletion", "human", None, 0, 10, ["a"], None, None), (9, 3, "deletion", "human", ["r"], 0, 10, ["a"], None, None), (2, 4, "deletion", "human", ["r"], 0, 5, ["b"], [(0, 5, None, "", None)], None)], schema)
    current, told = C.replay(segments, odd)
    assert sorted(r.segment_id for r in current.collect()) == ["a", "n"]
    assert {(r.seq, r.reason) for r in told.collect()} == {(1, "not_covered"), (2, "no_reference"), (3, "unknown_target"), (4, None)}


def test_findings_name_planted_faults(spark):
    row = lambda i, a, b, t="x": (1, i, a, b, t, t, None, [], [])
    schema = f"corpus_id long, {C.SEGMENT}"
    before = spark.createDataFrame([row("a", 0, 10), row("b", 10, 20), row("c", 20, 30), row("d", 30, 40)], schema)
    asked = spark.createDataFrame([(1, 1, "deletion", ["c"], [])], f"corpus_id long, seq int, kind string, targets array<string>, proposed {C.PROPOSED}")
    told = spark.createDataFrame([(1, 1, "applied")], "corpus_id long, seq int, status string")
    after = spark.createDataFrame([row("a", 0, 12), row("b", 10, 20), row("c", 20, 30), row("z", 50, 60)], schema)
    got = {(r.finding, r.id) for r in C.revision_findings(before, asked, told, after).collect()}
    assert got == {("overlap", "b"), ("lost", "d"), ("foreign", "z"), ("unreplaced", "c"), ("altered", "a")}


def plain_total(a, b):
    best = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                c, s, n, d = best[i - 1, j - 1]
                x = a[i - 1] != b[j - 1]
                ways.append((c + x, s + x, n, d))
            if i:
                c, s, n, d = best[i - 1, j]
                ways.append((c + 1, s, n, d + 1))
            if j:
                c, s, n, d = best[i, j - 1]
                ways.append((c + 1, s, n + 1, d))
            if ways:
                best[i, j] = min(ways)
    return best[len(a), len(b)][1:]


@pytest.mark.parametrize("cells", [1, 12, 1 << 18])
def test_alignments_are_cheapest_and_complete(monkeypatch, cells):
    monkeypatch.setattr(A, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(250):
        k = rng.choice([1, 2, 3, 8])
        a, b = ([f"w{rng.randrange(k)}" for _ in range(rng.randrange(14))] for _ in range(2))
        steps = A.aligned(a, b)
        assert [i for _, i, _ in steps if i is not None] == list(range(len(a)))
        assert [j for _, _, j in steps if j is not None] == list(range(len(b)))
        assert all((op == A.MATCH) == (i is not None and j is not None and a[i] == b[j]) for op, i, j in steps)
        n = [sum(s[0] == op for s in steps) for op in (A.SUBSTITUTION, A.INSERTION, A.DELETION)]
        assert tuple(n) == plain_total(a, b)
        assert (n[0], n[2], n[1]) == edit_counts(a, b)


def test_long_texts_are_halved():
    rng = random.Random(4)
    a = [f"w{rng.randrange(500)}" for _ in range(3000)]
    b = [w if i % 9 else "x" for i, w in enumerate(a) if i % 11 != 5]
    steps = A.aligned(a, b)
    n = [sum(s[0] == op for s in steps) for op in (A.SUBSTITUTION, A.DELETION, A.INSERTION)]
    assert tuple(n) == edit_counts(a, b)


def test_strata_and_impact_take_nulls(spark):
    rows = [(1, "r", "a b c", "a x c", "a b c", ["t", "u", "t"]), (2, "r", "d e", None, "d e f", ["t", None]), (3, "r", None, "z", "z", ["u"]), (4, "r", "", None, None, []), (5, "s", None, None, None, None), (6, "q", "k", "k", "m", ["t"])]
    df = spark.createDataFrame(rows, "id int, rec string, ref string, old string, new string, tags array<string>")
    got = {r.tag: (r.n_segments, r.matches, r.substitutions, r.deletions, r.insertions, r.wer) for r in A.stratified_wer(df, ["id"], "ref", "old", "tags").collect()}
    assert got == {"t": (3, 3, 1, 2, 0, 0.5), "u": (2, 2, 1, 0, 1, 0.666666667), None: (1, 0, 0, 2, 0, 1.0)}
    got = {r.rec: (r.n_words, r.errors_before, r.errors_after, r.wer_before, r.wer_after, r.wer_change) for r in A.correction_impact(df, ["id", "rec"], "ref", "old", "new", ["rec"]).collect()}
    assert got == {"r": (5, 4, 2, 0.8, 0.4, -0.4), "s": (0, 0, 0, None, None, 0.0), "q": (1, 0, 1, 0.0, 1.0, 1.0)}


def test_states_that_meet_a_reference(spark):
    states = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20), (1, "c", 20, 30), (2, "a", 0, 10), (1, "z", None, None)], "corpus_id long, segment_id string, start_us long, end_us long")
    refs = spark.createDataFrame([(1, 5, 10), (1, 7, 9), (1, 20, 21)], "corpus_id long, start_us long, end_us long")
    assert sorted(r.segment_id for r in A.overlapping_states(states, refs, 7).collect()) == ["a", "c"]


def test_revision_faults_computes_segments_and_corrections_once(spark, monkeypatch):
    from colloquy.plans import revision

    names = []
    monkeypatch.setattr(revision, "kept", lambda df, name, plain=revision.kept: names.append(name) or plain(df, name))
    out = revision.revision_faults(spark, "/root/testdata/sf0.001")
    assert names == ["revision-segments", "revision-corrections", "revision-spoilt"]
    assert "conversations" not in "".join(out.inputFiles())
