import os
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import metrics, text
from colloquy.operators import discourse, graph, intervals, ledger, sequence
from colloquy.plans import queries
from colloquy.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ivals(spark, pairs, key=1):
    return spark.createDataFrame([(key, i, s, e) for i, (s, e) in enumerate(pairs)], "corpus_id long, interval_id long, start_us long, end_us long")


def test_union_merges_touching_and_drops_empty(spark):
    df = intervals.merge_intervals(ivals(spark, [(20, 30), (0, 10), (10, 15), (40, 40), (5, 5)]))
    assert rows(df, "start_us", "end_us", "n") == [(0, 15, 2), (20, 30, 1)]
    assert intervals.merge_intervals(ivals(spark, [])).count() == 0


def test_activity_metrics(spark):
    m = intervals.activity_metrics(ivals(spark, [(100, 400), (700, 900)]), ivals(spark, [(200, 500), (800, 900)]), 64).first()
    assert (m.tp_us, m.fp_us, m.fn_us, m.precision, m.recall) == (300, 200, 100, 0.6, 0.75) and abs(m.f1 - 2 / 3) < 1e-8


def test_multiplicity_ends_first(spark):
    assert rows(intervals.coverage_multiplicity(ivals(spark, [(0, 10), (10, 20), (5, 15), (6, 7)])), "multiplicity") == [(3,)]
    assert rows(intervals.coverage_multiplicity(ivals(spark, [(0, 10), (10, 20)])), "multiplicity") == [(1,)]


def test_elementary_intervals(spark):
    assert rows(intervals.elementary_intervals(ivals(spark, [(0, 10), (5, 20)])), "start_us", "end_us", "active") == [(0, 5, 1), (5, 10, 2), (10, 20, 1)]


def test_overlap_pairs_once_each(spark):
    a, b = ivals(spark, [(0, 100), (150, 160)]), ivals(spark, [(90, 155), (100, 150), (-30, 1)])
    for width in (7, 64, 1000):
        got = rows(intervals.overlap_pairs(a, b, width), "interval_id_l", "interval_id_r", "overlap_us")
        assert got == [(0, 0, 10), (0, 2, 1), (1, 0, 5)]


def test_chunk_plan(spark):
    plan = intervals.chunk_plan(spark, 1_200_000_000, 600_000_000, 5_000_000)
    assert [r.start_us for r in plan.orderBy("ordinal").collect()] == [0, 595_000_000, 1_190_000_000]
    assert [r.terminal_short for r in plan.orderBy("ordinal").collect()] == [False, False, True]
    own = plan.orderBy("ordinal").collect()
    assert own[0].own_start_us == 0 and own[-1].own_end_us == 1_200_000_000 and all(a.own_end_us == b.own_start_us for a, b in zip(own, own[1:]))
    try:
        intervals.chunk_plan(spark, 10, 5, 5)
        raise AssertionError
    except ValueError:
        pass
    p = spark.createDataFrame([(at,) for at in (-1, 0, 597_499_999, 597_500_000, 1_199_999_999, 1_200_000_000)], "at_us long")
    got = rows(intervals.owned_by(p, "at_us", 1_200_000_000, 600_000_000, 5_000_000), "at_us", "ordinal")
    assert got == [(at, next(c.ordinal for c in own if c.own_start_us <= at < c.own_end_us)) for at in (0, 597_499_999, 597_500_000, 1_199_999_999)]


def test_map_interval(spark):
    df = intervals.map_interval(ivals(spark, [(0, 10), (95, 120), (200, 300), (20, 30)]), 5, 10, 110)
    assert rows(df, "interval_id", "mapping", "source_start_us", "source_end_us")[:3] == [(0, "clipped", 10, 15), (1, "clipped", 100, 110), (2, "unavailable", None, None)]
    broken = intervals.map_interval(ivals(spark, [(0, 10), (95, 120), (20, 30)]), 5, 10, 110, (12, 105))
    assert rows(broken, "interval_id", "mapping") == [(0, "discontinuous"), (1, "discontinuous"), (2, "exact")]


def points(spark, labels_at):
    return spark.createDataFrame([(1, i, lab, at) for i, (lab, at) in enumerate(labels_at)], "corpus_id long, event_id long, label string, at_us long")


def test_sequences(spark):
    p = points(spark, [("a", 0), ("a", 5), ("b", 20), ("a", 21), (None, 22), (None, 23)])
    assert rows(sequence.sessions(p, 10), "event_id", "session") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1)]
    assert [r for _, r in rows(sequence.runs(p, "label"), "event_id", "run")] == [0, 0, 1, 2, 3, 3]
    assert [v for _, v in rows(sequence.demote_short_runs(p, "label", 2, "u"), "event_id", "label")] == ["a", "a", "u", "u", "u", "u"]
    assert rows(sequence.nearest_prior(p, F.col("label") == "b", F.col("label") == "a"), "source_id", "target_id", "distance_us") == [(2, 1, 15)]
    tied = points(spark, [("a", 0), ("a", 0), ("b", 3)])
    assert rows(sequence.nearest_prior(tied, F.col("label") == "b", F.col("label") == "a"), "source_id", "target_id", "distance_us") == [(2, 0, 3), (2, 1, 3)]
    assert rows(sequence.latest_of_kind(p, ["a", "b"]), "event_id", "latest_a", "latest_b")[2:4] == [(2, 1, 2), (3, 3, 2)]


def test_owner_ties(spark):
    c = spark.createDataFrame([("w", 1, 5, 0), ("w", 2, 5, 0), ("w", 3, 4, 0), ("v", 1, 0, 0), ("x", 4, 2, 9), ("x", 5, 2, 3)], "item string, span_id long, overlap_us long, span_start_us long")
    assert rows(sequence.owners(c, ["item"]), "item", "span_id", "ambiguous") == [("w", 2, True), ("x", 5, True)]


def utter(spark, data):
    return spark.createDataFrame([(1, i, s, "some text.", a, b) for i, (s, a, b) in enumerate(data)], "corpus_id long, pos long, speaker string, text string, start_us long, end_us long")


def test_adjacency_groups_continuations(spark):
    u = utter(spark, [("A", 0, 10), ("B", 10, 20), ("A", 15, 30), ("B", 40, 50), ("A", 45, 46), ("A", 60, 70)])
    assert rows(sequence.adjacency(u), "left_id", "gap_us", "relation") == [(0, 0, "touching"), (1, -5, "overlapping"), (2, 10, "before"), (3, -5, "overlapping"), (4, 14, "before")]
    assert rows(graph.overlap_groups(u), "pos", "group_no", "lane") == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 2, 1), (5, 3, 0)]
    assert rows(sequence.continuations(u, 40, F.lit(True)), "left_id", "right_id", "gap_us") == [(0, 2, 5), (1, 3, 20), (2, 4, 15)]


#: One sentence for each rule, in the rules' order, then some that none matches.
SENTENCES = """I reject that reading of the minutes.
I affirm that the bridge was open.
We do not know who signed it.
The data shows a fall.
Could you clarify the second point, ma'am.
Shall we proceed with item four.
Who paid for the survey?
Does the fence belong to them?
There are ninety seconds left.
I fear time has expired.
Kindly answer that.
The floor is yours.
Let us move on.
Please stop.
Granted, but the well was dry.
I fully agree that it rained.
Unless it freezes.
It closed during the flood.
With the exception of Mondays.
Perhaps.
Solely for members.
For the purposes of this act, vessel means any raft.
Income is defined as wages.
Quorum means ten of us.
Consider the counterexample of Malta.
Imagine a town without wells.
As an example, take the mill.
The mill stood.
Well then.""".splitlines()


def test_rules_over_sentences(spark):
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(SENTENCES)] + [(1, 50, "Yes, but only after 2022."), (1, 51, "Go ahead, the floor is yours."), (1, 52, None)], "corpus_id long, pos long, phrase string")
    spans = text.rule_spans(df, ["corpus_id", "pos"], "phrase")
    assert rows(spans.where("pos = 50"), "rule", "start_off", "end_off") == [("concession.partial", 0, 8), ("qualification.scope", 9, 13), ("qualification.temporal", 14, 24)]
    assert rows(spans.where("pos = 51"), "start_off", "end_off") == [(0, 8), (10, 28)]
    hits = text.rule_hits(df, "phrase")
    assert rows(hits.select("pos", "rule").distinct(), "pos", "rule") == rows(spans.select("pos", "rule").distinct(), "pos", "rule")
    assert rows(discourse.unclassified(df, hits, ["corpus_id", "pos"]), "pos") == [(27,), (28,), (52,)]
    found = rows(hits, "pos", "rule")
    assert all((i, rule) in found for i, (rule, _, _) in enumerate(text.RULES))


def test_spans_of_whole_conversations(spark):
    """The rules' spans over the driver's texts, against plain matching."""
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    rules = [(n, re.compile(p, re.IGNORECASE)) for n, p, _ in text.RULES]
    want = []
    for r in tables.utterances(spark, SF).collect():
        seen = dict.fromkeys((n, m.start(), m.end()) for n, p in rules for m in p.finditer(r.text))
        want += [(r.corpus_id, r.pos, n, a, b, r.text[a:b]) for n, a, b in list(seen)[: text.ACTS]]
    assert rows(queries.QUERIES["rule_spans"](spark, SF), "corpus_id", "pos", "rule", "start_off", "end_off", "span") == sorted(want)


def test_links_of_acts(spark):
    said = [("A", "Who paid for it?"), ("B", "The mill."), ("B", "I concede that it rained, except for June."), ("A", "Time is up."), ("B", "Go ahead."), ("A", "There are two minutes left.")]
    u = spark.createDataFrame([(1, i, s, t, 10 * i, 10 * i + 9) for i, (s, t) in enumerate(said)], "corpus_id long, pos long, speaker string, text string, start_us long, end_us long")
    hits = text.rule_hits(u, "text")
    assert rows(discourse.question_answers(u, hits), "answer_pos", "question_pos", "rank", "distance_us") == [(1, 0, 1, 1), (2, 0, 1, 11), (4, 0, 1, 31)]
    assert rows(discourse.qualified_concessions(hits), "pos", "concession", "qualification") == [(2, "concession.full", "qualification.exception")]
    assert rows(discourse.procedural_state(hits), "pos", "last_warning", "time_expired", "floor_granted") == [(3, None, True, False), (4, None, True, True), (5, 5, True, True)]


def test_char_error_rate_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    pairs = [("", ""), ("", "ab"), ("Café au lait " * 30, "Cafe au lait " * 29 + "!"), ("日本語", "日本"), (None, "x")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "item_id long, ref string, hyp string")
    got = rows(metrics.char_error_rate(df, "ref", "hyp"), "item_id", "distance", "cer")
    assert got == [(i, None if a is None else distance(a, b), None if not a else round(distance(a, b) / len(a), 9)) for i, (a, b) in enumerate(pairs)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "reference string, predicted string")
    m = metrics.pair_confusion(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 2, 1, 2)
    b = metrics.reliability_bins(spark.createDataFrame([(0.0, 1), (0.2, 0), (1.0, 1), (None, 1)], "c double, ok int"), "c", "ok")
    assert rows(b, "bin", "n") == [(0, 1), (1, 1), (4, 1)]
    p = metrics.label_scores(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "reference string, predicted string"))
    assert rows(p, "label", "tp", "fp", "fn") == [("a", 1, 0, 1), ("b", 0, 2, 0)]


def test_ledger(spark):
    rows_ = spark.createDataFrame([(1, 1, None, "x", 1), (1, 2, 1, "y", 2), (2, 3, None, "x", 1)], "target_id long, entry_id long, predecessor_id long, action string, at_us long")
    assert rows(ledger.active(rows_), "entry_id") == [(2,), (3,)]
    assert rows(ledger.latest(rows_), "target_id", "action") == [(1, "y"), (2, "x")]
    c = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "x", "b"), (2, 1, "zz", "c")], "entry_id long, seq long, expected string, replacement string")
    assert rows(ledger.corrected(rows_, c, ["entry_id"], "action"), "entry_id", "action", "status") == [(1, "b", "applied"), (2, "y", "stale"), (3, "x", "unchanged")]


def test_downstream(spark):
    got = rows(graph.downstream(spark), "stage", "affected")
    assert ("provider_analysis", "corpus_export") in got and ("corpus_export", "provider_analysis") not in got and ("answer_linking", "concession_qualification") not in got
    own = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(graph.downstream(spark, own), "stage", "affected") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_timestamp(spark):
    assert spark.range(1).select(text.timestamp(F.lit(3_723_004_999))).first()[0] == "01:02:03.004"


def test_text_error_rate_takes_whole_texts(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs = [("a" * 130 + "end", "a" * 130 + "tail"), ("déjà vu 𝄞", "deja vu"), ("same", "same"), ("", "x")]
    for name, key, i in (("benchmark", "item_id", 0), ("documents", "doc_id", 1)):
        spark.createDataFrame([(k, p[i]) for k, p in enumerate(pairs)], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.item_id: (r.distance, r.cer) for r in queries.QUERIES["text_error_rate"](spark, f"file://{tmp_path}").collect()}
    want = {k: distance(*p) for k, p in enumerate(pairs)}
    assert got == {k: (n, round(n / len(pairs[k][0]), 9) if pairs[k][0] else None) for k, n in want.items()}


def test_sides_of_a_join_are_dealt_by_the_number_of_rows(spark):
    from colloquy.operators import ledger as books

    child = spark.createDataFrame([(i // 2, i) for i in range(100)] + [(None, -1), (900, -2)], "id long, line long")
    parent = spark.createDataFrame([(i, i) for i in range(45)] + [(7, 70), (None, -3), (800, -4)], "id long, made long")
    out = books.sides(child, parent, "id", 10)
    assert out.rdd.getNumPartitions() == 15  # 150 rows in parts of 10
    got = out.collect()
    assert sorted(r.line for r in got if not r.parent) == [-2, -1, *range(90, 100)]
    assert sorted(r.made for r in got if not r.child) == [-4, -3]
    assert len([r for r in got if r.child and r.parent]) == 92
