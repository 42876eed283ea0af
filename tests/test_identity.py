import random

from pyspark.sql import functions as F

from colloquy.operators import identity as I

LEDGER = "binding_id string, action string, identity string, scope string, target string, made_us long, expires_us long, supersedes string"
TURNS = "corpus_id long, turn_id string, observations array<string>, cluster string, start_us long, end_us long, evidence array<string>"
SCOPES = {"turn": ["turn_id"], "observation": ["observations"], "cluster": ["corpus_id", "cluster"], "recording": ["corpus_id"]}


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


def test_decisions_hold_until_they_expire_or_are_superseded(spark):
    b = ledger(
        spark, ("a", "bind", "p", "turn", "t", 10, None, None), ("b", "bind", "q", "turn", "t", 20, 30, "a"), ("c", "bind", "p", "turn", "u", 10, 25, None), ("d", "mark_unknown", None, "turn", "u", 40, None, "c"),
        ("e", "bind", "p", "turn", "v", 10, 10, None), ("f", "bind", "p", None, "v", 10, None, None), ("g", "bind", "p", "turn", "v", None, None, None), ("h", "bind", "p", "turn", "v", 50, None, "h2"), ("i", "bind", "z", "turn", "t", 22, None, "a"),
    )
    got = {r.binding_id: (r.from_us, r.until_us) for r in I.in_force(b).collect()}
    assert got == {"a": (10, 20), "b": (20, 30), "c": (10, 25), "d": (40, None), "h": (50, None), "i": (22, None)}
    held = {t: sorted(r.binding_id for r in I.at(b, t).collect()) for t in (9, 10, 19, 20, 25, 35, 60)}
    assert held == {9: [], 10: ["a", "c"], 19: ["a", "c"], 20: ["b", "c"], 25: ["b", "i"], 35: ["i"], 60: ["d", "h", "i"]}


def plain(turn, rows, t, narrowest):
    superseded = {}
    for r in rows:
        if r[7]:
            superseded[r[7]] = min(superseded.get(r[7], r[5]), r[5])
    met = []
    for r in rows:
        until = min(x for x in (r[6], superseded.get(r[0]), 1 << 60) if x is not None)
        if not r[5] <= t < until or r[1] in I.PLACEHOLDER_ACTIONS:
            continue
        at = {"turn": [turn[1]], "observation": turn[2] or [], "cluster": [f"{turn[0]}/{turn[3]}"] if turn[3] else [], "recording": [str(turn[0])]}[r[3]]
        if r[4] in at:
            met.append((list(SCOPES).index(r[3]), r))
    if narrowest and met:
        met = [m for m in met if m[0] == min(x[0] for x in met)]
    kinds = {("unknown" if r[1] == "mark_unknown" else "rejected" if r[1] == "reject_identity" else "bound", r[2]) for _, r in met}
    ids, names = sorted({r[0] for _, r in met}), sorted({n for _, n in kinds if n})
    if len(kinds) > 1:
        return "conflicted", I.CONFLICT_LABEL, names, ids
    if not kinds:
        return "unknown", None, [], []
    kind, name = next(iter(kinds))
    if kind == "bound" and name:
        return "reviewed_identity", f"REVIEWED: {name}", names, ids
    return ("rejected" if kind == "rejected" else "unknown"), I.UNKNOWN_LABEL, names, ids


def test_resolution_equals_a_plain_one(spark):
    rng = random.Random(6)
    turns = [(rng.randrange(3), f"t{i}", rng.choice([None, [], [f"o{i}", f"o{i % 7}"]]), rng.choice([None, "A", "B"]), i * 10, i * 10 + 15, [f"e{i}"]) for i in range(40)]
    rows = []
    for i in range(150):
        scope = rng.choice(list(SCOPES))
        target = {"turn": f"t{rng.randrange(40)}", "observation": f"o{rng.randrange(9)}", "cluster": f"{rng.randrange(3)}/{rng.choice('AB')}", "recording": str(rng.randrange(3))}[scope]
        action = rng.choice(["bind", "bind", "bind", "mark_unknown", "reject_identity", "revise", "merge_identity_placeholders"])
        made = rng.randrange(100)
        rows.append((f"b{i:03}", action, None if action == "mark_unknown" else rng.choice(["p", "p", "q"]), scope, target, made, rng.choice([None, made + rng.randrange(1, 30)]), rng.choice([None, f"b{rng.randrange(150):03}"])))
    frame, b = spark.createDataFrame(turns, TURNS), ledger(spark, *rows)
    seen = set()
    for t in (5, 40, 80):
        for narrowest in (False, True):
            got = {r.turn_id: (r.disposition, r.reviewed_label, list(r.identities), list(r.bindings)) for r in I.reviewed(frame, b, SCOPES, t, narrowest=narrowest).collect()}
            assert got == {x[1]: plain(x, rows, t, narrowest) for x in turns}
            seen |= {g[0] for g in got.values()}
    assert seen == {"reviewed_identity", "conflicted", "rejected", "unknown"}


def test_without_decisions_machine_labels_stay(spark):
    turns = spark.createDataFrame([(1, "t", ["o"], None, 0, 5, None)], TURNS)
    got = I.reviewed(turns, ledger(spark), SCOPES, 5).collect()
    assert [(r.disposition, r.reviewed_label, list(r.identities), list(r.bindings)) for r in got] == [("unknown", None, [], [])]


def test_conflicts_and_simultaneous_turns(spark):
    b = ledger(spark, ("a", "bind", "p", "turn", "t1", 1, None, None), ("b", "bind", "q", "turn", "t1", 1, None, None), ("c", "bind", "p", "recording", "7", 1, None, None), ("d", "restore", "p", "recording", "7", 2, None, None), ("x", "split_identity", "z", "recording", "7", 2, None, None))
    assert [(r.scope, r.target, list(r.bindings)) for r in I.decision_conflicts(b, 5).collect()] == [("turn", "t1", ["a", "b"])]
    turns = spark.createDataFrame([(7, "t1", [], "A", 0, 10, None), (7, "t2", [], "B", 5, 15, None), (7, "t3", [], "B", 6, 9, None), (7, "t4", [], None, 14, 20, None), (7, "t5", [], "A", 20, 30, None)], TURNS)
    resolved = I.reviewed(turns, b, SCOPES, 5)
    got = {(r.identity, r.left, r.right) for r in I.simultaneous_assignments(turns, resolved, 7).collect()}
    assert got == {("p", "t2", "t4")}  # t1 is in conflict, t3 is of t2's cluster


def test_eight_views_are_kept_apart(spark):
    text = "array<string>"
    turns = spark.createDataFrame([(1, "t1", ["o1"], "A", 0, 5, ["o1"]), (1, "t2", ["o2"], None, 5, 9, None)], TURNS)
    obs = spark.createDataFrame([("o1", "x", None), ("o2", None, ["r"])], f"observation_id string, label string, evidence {text}")
    consistency = spark.createDataFrame([("A", 1, 0, None), ("B", 0, 0, None)], f"cluster string, outliers int, conflicts int, evidence {text}")
    proposals = spark.createDataFrame([("m", True, ["A"]), ("n", False, None)], f"proposal_id string, open boolean, evidence {text}")
    hyps = spark.createDataFrame([("h", "p", ["c"])], f"hypothesis_id string, identity string, evidence {text}")
    comps = spark.createDataFrame([("c", "p", "supports", None), ("k", "q", "comparison_invalid", None)], f"comparison_id string, identity string, result string, evidence {text}")
    b = ledger(spark, ("b1", "bind", "p", "turn", "t1", 1, None, None), ("b2", "mark_unknown", None, "turn", "t2", 1, 2, None))
    rows = I.identity_views(obs, turns, consistency, proposals, hyps, comps, b, SCOPES, 5).collect()
    got = {(r.view, r.target): (r.disposition, r.machine_label, r.reviewed_label, list(r.identities), list(r.bindings), list(r.evidence)) for r in rows}
    assert len(got) == len(rows) == 2 + 2 + 2 + 2 + 1 + 2 + 2 + 2 and {r.view for r in rows} == set(I.VIEWS)
    assert got["canonical_machine_diarization", "t2"] == ("unknown", I.UNRESOLVED, None, [], [], [])
    assert got["unresolved_speaker", "m"] == ("unresolved_proposal", None, None, [], [], ["A"]) and ("unresolved_speaker", "n") not in got
    assert got["cluster_consistency", "A"][0] == "unresolved_proposal" and got["cluster_consistency", "B"][0] == "informational"
    assert got["reference_comparison", "k"][0] == "invalid_evidence"
    assert got["manually_reviewed_identity", "t1"] == ("reviewed_identity", "A", "REVIEWED: p", ["p"], ["b1"], ["o1"])
    assert got["manually_reviewed_identity", "t2"] == ("unknown", I.UNRESOLVED, None, [], [], [])
    assert got["binding_history", "b2"] == ("unknown", None, I.UNKNOWN_LABEL, [], ["b2"], [])


def test_comparisons_name_every_reason(spark):
    refs = spark.createDataFrame(
        [("ok", "p", [1.0, 0.0], "s", "x", False, None, True), ("gone", "p", [1.0, 0.0], "s", "x", True, 5, False), ("dims", "q", [1.0, 0.0, 0.0], "s3", "x", None, None, True), ("zero", "q", [0.0, 0.0], "s", "x", None, 6, True), ("far", "q", [-1.0, 0.0], "s", "x", None, None, True)],
        "reference_id string, identity string, vector array<double>, space string, scope string, replaced boolean, expires_us long, accepted boolean",
    )
    targets = spark.createDataFrame([("t", [3.0, 4.0], "s", "x", None, None), ("bad", [1.0, 1.0], "s", "y", "incompatible", "unusable"), ("none", None, "s", "x", "degraded", "marginal"), ("same", [2.0, 0.0], "s", "x", None, None)], "target_id string, vector array<double>, space string, scope string, channel string, quality string")
    asked = [("t", "ok"), ("t", "gone"), ("t", "dims"), ("t", "zero"), ("t", "far"), ("bad", "ok"), ("none", "ok"), ("who", "ok"), ("same", "ok"), ("t", "unknown")]
    rows = I.compared(spark.createDataFrame(asked, "target_id string, reference_id string"), targets, refs, 5, -0.5, 1.0, (0.8, 0.6, 0.0, 0.2)).collect()
    got = {(r.target_id, r.reference_id): (None if r.score is None else round(r.score, 9), list(r.reasons), r.result, None if r.support is None else round(r.support, 9)) for r in rows}
    assert got == {
        ("t", "ok"): (0.6, [], "weakly_supports", 0.733333333),
        ("same", "ok"): (1.0, [], "supports", 1.0),
        ("t", "gone"): (0.6, ["reference_replaced", "reference_expired", "reference_ineligible"], "comparison_invalid", None),
        ("t", "dims"): (None, ["incompatible_space", "no_score"], "comparison_invalid", None),
        ("t", "zero"): (None, ["no_score"], "comparison_invalid", None),
        ("t", "far"): (None, ["outside_scale"], "comparison_invalid", None),
        ("bad", "ok"): (0.707106781, ["outside_scope", "incompatible_channel", "unusable_target"], "comparison_invalid", None),
        ("none", "ok"): (None, ["no_score"], "comparison_invalid", None),
        ("who", "ok"): (None, ["target_unknown", "outside_scope", "incompatible_space", "no_score"], "comparison_invalid", None),
    }
    wide = I.compared(spark.createDataFrame([("t", "ok"), ("t", "far"), ("same", "far")], "target_id string, reference_id string"), targets, refs.withColumn("identity", F.lit("p")), 5, -1.0, 1.0, (0.8, 0.6, 0.0, 0.2))
    hyps = [(r.target_id, r.identity, r.disposition, round(r.support, 9), list(r.supporting), list(r.contrary)) for r in I.comparison_hypotheses(wide).collect()]
    assert hyps == [("t", "p", "proposed", 0.8, ["ok"], ["far"])]


def test_centroids_take_means_by_component(spark):
    v = spark.createDataFrame([(1, [1.0, 4.0]), (1, [3.0, 0.0]), (2, [5.0]), (2, None), (None, [9.0])], "label int, embedding array<float>")
    assert {r.label: (r.n, list(r.centroid)) for r in I.centroids(v, "label").collect()} == {1: (2, [2.0, 2.0]), 2: (1, [5.0])}
