import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chains as H
from colloquy.operators import coverage as V

ENTRY = "ledger long, entry_id long, predecessor_id long, predecessor_digest string, content string, digest string, made_us long"


def test_exact_cover_finds_planted_faults(spark):
    source = spark.createDataFrame([(1, f"w{i}", i) for i in range(6)] + [(2, "a", 0), (2, "a", 1), (3, "x", 0), (5, "p", 0), (5, "q", 1)], "corpus_id long, word_id string, place long")
    owned = spark.createDataFrame([(1, 7, 0, "w0"), (1, 7, 1, "w2"), (1, 7, 2, "w1"), (1, 8, 0, "w3"), (1, 9, 0, "w3"), (1, 9, 1, "zz"), (1, 9, 2, None), (2, 1, 0, "a"), (4, 1, 0, "w0"), (5, 2, 0, "p"), (5, 1, 0, "q")], "corpus_id long, utterance long, n long, word_id string")
    got = {(r.corpus_id, r.word_id, r.finding) for r in V.word_faults(source, owned).collect()}
    assert got == {(1, "w1", "out_of_order"), (1, "w3", "twice"), (1, "w4", "missing"), (1, "w5", "missing"), (1, "zz", "foreign"), (1, None, "foreign"), (2, "a", "repeated"), (3, "x", "missing"), (4, "w0", "foreign")}
    proof = {r.corpus_id: (r.n_source, r.n_owned, r.missing, r.twice, r.foreign, r.repeated, r.out_of_order, r.exact) for r in V.cover_proofs(source, owned).collect()}
    assert proof == {1: (6, 7, 2, 1, 2, 0, 1, False), 2: (2, 1, 0, 0, 0, 1, 0, False), 3: (1, 0, 1, 0, 0, 0, 0, False), 4: (0, 1, 0, 0, 1, 0, 0, False), 5: (2, 2, 0, 0, 0, 0, 0, True)}
    assert V.cover_proofs(source.limit(0), owned.limit(0)).collect() == []


def test_lineage_is_compared_null_safe(spark):
    a = spark.createDataFrame([(1, "c", None), (2, "c", "h")], "id int, corpus string, sha string")
    b = spark.createDataFrame([(1, "c", None), (2, "d", None), (3, "c", "h"), (2, "c", "h")], "id int, corpus string, sha string")
    got = {(r.id, r.part, r.column, r.expected, r.found) for r in V.lineage_faults({"a": a, "b": b, "same": a}, "id", ["corpus", "sha"]).collect()}
    assert got == {(2, "b", "corpus", "c", "d"), (2, "b", "sha", "h", None), (3, "b", "corpus", None, "c"), (3, "b", "sha", None, "h")}


def test_attributions_roll_up(spark):
    text = "array<string>"
    rows = [
        (1, 0, "reviewed", ["p"], None, ["P"], ["A"]), (1, 1, "unknown", None, None, None, ["B"]), (2, 0, "reviewed", ["p"], [], [], []), (2, 1, "reviewed", ["q"], [], ["Q"], []), (3, 5, "reviewed", ["p"], [], [], []), (3, 2, "machine_cluster", [], [], [], ["B", "A"]),
        (4, 0, "conflicted", ["q", "p"], ["e"], [], []), (5, 0, "multiple_candidates", ["p"], [], [], []), (6, 0, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, n int, kind string, identities {text}, entries {text}, reviewed {text}, machine {text}")
    got = {r.id: (r.status, r.target, list(r.candidates), r.label, r.degraded) for r in V.attributions(df, ["id"]).collect()}
    assert got == {
        1: ("manually_bound", "p", [], "P", False), 2: ("unknown", None, [], "Q", False), 3: ("machine_clustered", "A", [], "A + B", False),
        4: ("conflicting", None, ["p", "q", "e"], "UNKNOWN", False), 5: ("unknown", None, [], "UNKNOWN", True), 6: ("unknown", None, [], "UNKNOWN", False),
    }


def made(spark, n=12, ledgers=2):
    rng = random.Random(n)
    rows = [(k, k * 100 + i, rng.choice(["a", "b", None]), 10 * i) for k in range(ledgers) for i in range(n)]
    return H.sealed(spark.createDataFrame(rows, "ledger long, entry_id long, content string, made_us long").repartition(3)).select(*[c.split()[0] for c in ENTRY.split(", ")])


def test_sealed_ledgers_verify_and_continue(spark):
    one = made(spark)
    assert one.count() == 24 and H.chain_findings(one).collect() == []
    assert {(r.entry_id, r.depth) for r in H.surviving(one).collect()} == {(k * 100 + i, i) for k in range(2) for i in range(12)}
    more = spark.createDataFrame([(0, 90, "x", 500), (0, 91, None, 500), (7, 700, "x", 1)], "ledger long, entry_id long, content string, made_us long")
    both = one.unionByName(H.append(one, more))
    assert H.chain_findings(both).collect() == []
    assert {r.entry_id: r.depth for r in H.surviving(both).collect()}[91] == 13
    last = {(r.ledger, r.target): (r.value, r.entry_id) for r in H.state(both, F.coalesce("content", F.lit("none")), F.col("made_us")).collect()}
    assert last[0, "x"] == (500, 90) and last[0, "none"] == (500, 91) and last[7, "x"] == (1, 700)


def edited(spark, rows, entry, **values):
    return [r if r["entry_id"] != entry else {**r, **values} for r in rows]


def frame(spark, rows):
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ENTRY)


def found(spark, rows):
    df = frame(spark, rows)
    return {(r.entry_id, r.finding) for r in H.chain_findings(df).collect()}, sorted(r.entry_id for r in H.surviving(df).collect())


def test_tampering_forks_gaps_and_circles(spark):
    rows = [r.asDict() for r in made(spark, 6, 1).orderBy("entry_id").collect()]
    assert found(spark, edited(spark, rows, 3, content="!")) == ({(3, "altered"), (3, "cut_off"), (4, "cut_off"), (5, "cut_off")}, [0, 1, 2])
    assert found(spark, [r for r in rows if r["entry_id"] != 3]) == ({(4, "gap"), (4, "cut_off"), (5, "cut_off")}, [0, 1, 2])
    assert found(spark, edited(spark, rows, 5, made_us=-1)) == ({(5, "out_of_time")}, [0, 1, 2, 3, 4, 5])

    def again(r, **values):
        new = {**r, **values}
        import hashlib

        return {**new, "digest": hashlib.sha256("\n".join([new["predecessor_digest"] or "", str(new["entry_id"]), new["content"] or ""]).encode()).hexdigest()}

    fork = again(rows[3], entry_id=30, content="other", made_us=35)
    tail = again(rows[4], entry_id=31, predecessor_id=30, predecessor_digest=fork["digest"])
    assert found(spark, [*rows, fork, tail]) == ({(3, "fork"), (30, "fork"), (30, "cut_off"), (31, "cut_off")}, [0, 1, 2, 3, 4, 5])
    rewritten = again(rows[3], content="rewritten")  # by itself sound, but no longer what its successor names
    assert found(spark, [*rows[:3], rewritten, *rows[4:]]) == ({(4, "broken_link"), (4, "cut_off"), (5, "cut_off")}, [0, 1, 2, 3])
    root = again(rows[0], entry_id=40, made_us=-5, content="root")
    got, alive = found(spark, [*rows, root])
    assert {(0, "several_roots"), (40, "several_roots")} <= got and alive == [40]
    circle = [again(rows[0], entry_id=1, predecessor_id=2, predecessor_digest="x"), again(rows[0], entry_id=2, predecessor_id=1, predecessor_digest="x")]
    assert found(spark, circle)[1] == []
    twin = again(rows[2])
    assert {(2, "repeated_id")} <= found(spark, [*rows, twin])[0]
    assert found(spark, edited(spark, rows, 2, digest=None))[0] >= {(2, "altered"), (3, "cut_off")}
    assert found(spark, []) == (set(), [])


def test_circles_of_sound_links_end(spark, monkeypatch):
    monkeypatch.setattr(H, "digest", lambda before, entry, content: F.lit("d"))
    rows = [(1, i, (i + 1) % 5 if i < 5 else i - 1, "d", "c", "d", i) for i in range(9)] + [(1, 20, None, None, "c", "d", 0), (1, 21, 20, "d", "c", "d", 1)]
    assert {(r.entry_id, r.depth) for r in H.surviving(spark.createDataFrame(rows, ENTRY)).collect()} == {(20, 0), (21, 1)}


def test_queue_orders_and_names_its_items(spark):
    u = spark.createDataFrame([(1, 0, 0, 31_000_000, "unknown", None, None), (1, 1, 40, 50, "conflicting", "unknown", False), (1, 2, 60, 1_000_060, None, None, True), (2, 0, 0, 1_000_000, "x", "complete", False)], "corpus_id long, pos long, start_us long, end_us long, status string, completeness string, review boolean")
    source = spark.createDataFrame([(1, [0, 1, 9, 1], "e"), (1, [0, 1, 9, 1], "e"), (1, [9], "e"), (3, [0], "e")], "corpus_id long, utterances array<long>, evidence string")
    got = {(r.corpus_id, r.kind): (r.priority, list(r.utterances), r.evidence, list(r.actions), r.start_us, r.end_us) for r in H.review_queue(u, unresolved_interruption=source).collect()}
    order = list(H.QUEUES)
    assert {k: v[:2] for k, v in got.items() if k[1] != "low_confidence_segmentation"} == {
        (1, "uncertain_speaker_boundary"): (order.index("uncertain_speaker_boundary") + 1, [0]), (1, "long_utterance"): (order.index("long_utterance") + 1, [0]),
        (1, "conflicting_speaker_attribution"): (2, [1]), (1, "very_short_fragment"): (order.index("very_short_fragment") + 1, [1]), (1, "unresolved_interruption"): (order.index("unresolved_interruption") + 1, [0, 1]),
    }
    assert got[1, "unresolved_interruption"][2:] == ("e", ["mark_interruption", "remove_incorrect_interruption"], 0, 31_000_000)
    low = H.review_queue(u).where("kind = 'low_confidence_segmentation'").collect()
    assert sorted(list(r.utterances) for r in low) == [[1], [2]]
    with pytest.raises(ValueError, match="no such queue"):
        H.review_queue(u, wonder=source)


def test_links_are_found_in_one_pass_and_ways_by_runs(spark, monkeypatch):
    """A long chain is one run: no way is doubled, and the ledger is read for one written table."""
    names = []
    plain = H.kept
    monkeypatch.setattr(H, "kept", lambda df, name: names.append(name) or plain(df, name))
    whole = H.sealed(spark.createDataFrame([(1, i, f"x{i}", i, i * 2) for i in range(200)], "ledger long, entry_id long, content string, made_us long, size long"))
    assert [r["size"] for r in whole.orderBy("entry_id").collect()] == [2 * i for i in range(200)]
    got = H.surviving(whole).collect()
    assert sorted((r.entry_id, r.depth) for r in got) == [(i, i) for i in range(200)]
    assert names == ["chains-entries", "chains-links", "chains-runs", "chains-ways"]
    back = whole.withColumn("made_us", -F.col("made_us"))  # each entry was made before its predecessor: as many runs
    assert sorted((r.entry_id, r.depth) for r in H.surviving(back).collect()) == [(i, i) for i in range(200)]
    assert {(r.entry_id, r.finding) for r in H.chain_findings(back).collect()} == {(i, "out_of_time") for i in range(1, 200)}
