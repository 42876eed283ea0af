import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_operators import ivals, rows

from colloquy.functions import metrics
from colloquy.functions.text import normalized_tokens
from colloquy.operators import context, matching, transcript
from colloquy.sources import records, subtitles
from colloquy.streaming import bounded


def utter(spark, data):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(data)], "corpus_id long, pos long, speaker string, text string, start_us long, end_us long")


def aligned(a, b):
    """(cost, substitutions, insertions, deletions) by a plain table, the smallest in that order."""
    table = [[(j, 0, j, 0) for j in range(len(b) + 1)]]
    for i, x in enumerate(a):
        row = [(i + 1, 0, 0, i + 1)]
        for j, y in enumerate(b):
            d, n, s = table[-1][j + 1], row[-1], table[-1][j]
            row.append(min((d[0] + 1, d[1], d[2], d[3] + 1), (n[0] + 1, n[1], n[2] + 1, n[3]), (s[0] + (x != y), s[1] + (x != y), s[2], s[3])))
        table.append(row)
    return table[-1][-1]


def test_edit_counts_match_a_plain_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        _, s, i, d = aligned(a, b)
        assert matching.edit_counts(a, b) == (s, d, i)
    many = ["x"] * 33_000
    assert matching.edit_counts(many, many[1:]) == (0, 1, 0)


def test_word_errors(spark):
    df = spark.createDataFrame([(1, "The CAT\u2019s \ufb01ne, it's", "the cat s fine its x"), (2, "", "a"), (3, None, None)], "k long, a string, b string")
    got = rows(matching.word_errors(df, ["k"], "a", "b"), "k", "n_words", "substitutions", "deletions", "insertions", "wer")
    assert got == [(1, 5, 1, 0, 1, 0.4), (2, 0, 0, 0, 1, None), (3, 0, 0, 0, 0, None)]
    assert normalized_tokens("Stra\u00dfe o'clock_x") == ["strasse", "o'clock", "x"]


def test_mapping_is_the_best_of_all():
    rng = random.Random(7)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = {(f"s{i}", f"r{j}"): rng.randrange(6) for i in range(n) for j in range(m)}
        left, right = [f"s{i}" for i in range(n)] + [None] * m, [f"r{j}" for j in range(m)]
        best = max(sum(w.get((s, r), 0) for s, r in zip(p, right)) for p in itertools.permutations(left, m))
        total, pairs = matching.assigned(w)
        assert total == best == sum(w[p] for p in pairs) and len({s for s, _ in pairs}) == len({r for _, r in pairs}) == len(pairs)


def test_mapping_takes_many_speakers(spark):
    df = spark.createDataFrame([(1, f"s{i}", "r", 1 + i) for i in range(4)], "corpus_id long, system string, reference string, weight_us long")
    for most in (3, 12):
        assert rows(matching.speaker_mapping(df, most=most), "system", "reference", "weight_us") == [("s3", "r", 4)]


def test_error_components(spark):
    named = lambda data: spark.createDataFrame([(1, i, lab, s, e) for i, (lab, s, e) in enumerate(data)], "corpus_id long, interval_id long, label string, start_us long, end_us long")
    r = matching.error_components(named([("a", 0, 100), ("b", 100, 200)]), named([("a", 0, 120), ("b", 150, 260)]), 10, 64).first()
    # outside collars: 10-90, 110-190 of the reference and 210-260 of the system alone
    assert (r.reference_us, r.correct_us, r.missed_us, r.false_alarm_us, r.confusion_us, r.der) == (160, 120, 30, 50, 10, 0.5625)


def test_matching_states(spark):
    ref, st = ivals(spark, [(0, 10), (100, 110), (40, 60)]), ivals(spark, [(5, 9), (6, 30), (70, 80)])
    assert rows(matching.matching_states(ref, st, 16), "reference_id", "state_id", "overlap_us") == [(0, 0, 4), (1, 2, 0), (2, 2, 0)]
    assert rows(matching.matching_states(ref, st.limit(0), 16), "reference_id", "state_id") == [(0, None), (1, None), (2, None)]


def test_cut_spans_and_bands(spark):
    got = matching.cut_spans(ivals(spark, [(0, 100), (200, 210)]), ivals(spark, [(-5, 30), (20, 60)]), 64)
    assert rows(got, "segment_id", "start_us", "end_us", "active") == [(0, 0, 20, 1), (0, 20, 30, 2), (0, 30, 60, 1), (0, 60, 100, 0), (1, 200, 210, 0)]
    p = spark.createDataFrame([(1, i, at) for i, at in enumerate((0, 0, 10, 21))], "corpus_id long, event_id long, at_us long")
    assert rows(matching.band_pairs(p, 10), "left_id", "right_id", "delta_us") == [(0, 2, 10), (1, 2, 10), (2, 0, -10), (2, 1, -10)]


def test_versions(spark):
    side = lambda of: spark.createDataFrame([(1, u, w) for u, ws in of.items() for w in ws], "corpus_id long, utterance_id string, word_id string")
    got = matching.versions(side({"a": "12", "b": "34", "c": "5", "d": "67", "e": "89"}), side({"A": "12", "B": "3", "B2": "4", "D": "567", "E": "8x"}))
    assert rows(got, "old_id", "new_id", "tier", "change") == [("a", "A", 3, "unchanged"), ("b", "B", 2, "split"), ("b", "B2", 2, "split"), ("c", "D", 2, "merged"), ("d", "D", 2, "merged"), ("e", "E", 2, "one_to_one")]
    gone = matching.versions(side({"a": "1"}), side({"B": "2"}))
    assert rows(gone, "old_id", "new_id", "change") == [("a", None, "removed")]


def test_grouping_is_transitive(spark):
    ob = spark.createDataFrame([(0, 1, "q", 0, 10, 0.9, 0), (1, 1, "q", 4, 14, 0.8, 1), (2, 1, "q", 8, 18, 0.99, 1), (3, 1, "q", 30, 40, 0.5, 0), (4, 1, "r", 0, 10, 0.7, 0)], "interval_id long, corpus_id long, label string, start_us long, end_us long, confidence double, method long")
    assert rows(matching.grouped_observations(ob), "label", "group_id", "n", "score") == [("q", 0, 3, 1.0), ("q", 3, 1, 0.5), ("r", 4, 1, 0.7)]


def test_grouping_equals_a_plain_closure(spark):
    rng = random.Random(9)
    spans = [(i, rng.randrange(3), rng.choice("qr"), s := rng.randrange(60), s + rng.randrange(0, 14), rng.randrange(10) / 10, rng.randrange(2)) for i in range(150)]
    root = {x[0]: x[0] for x in spans}
    for _ in range(12):
        for a, b in itertools.combinations(spans, 2):
            both = min(a[4], b[4]) - max(a[3], b[3])
            if a[1:3] == b[1:3] and both > 0 and 2 * both >= max(a[4] - a[3], b[4] - b[3]):
                root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    groups = {}
    for x in spans:
        groups.setdefault((x[1], x[2], root[x[0]]), []).append(x)
    want = sorted((k, label, g, len(xs), round(min(1.0, max(x[5] for x in xs) + (0.05 if len({x[6] for x in xs}) > 1 else 0)), 9)) for (k, label, g), xs in groups.items())
    ob = spark.createDataFrame(spans, "interval_id long, corpus_id long, label string, start_us long, end_us long, confidence double, method long")
    assert rows(matching.grouped_observations(ob), "corpus_id", "label", "group_id", "n", "score") == want


def test_completeness(spark):
    said = ["So it was...", "Then we \u2014", "?!", "Right.", "Well", "and then they came", "never the end"]
    u = utter(spark, [("A", t, 1_000_000 * i, 1_000_000 * i + (400_000 if t == "Well" else 900_000)) for i, t in enumerate(said)])
    assert [k for _, k in rows(transcript.completeness(u), "pos", "completeness")] == ["unknown", "unknown", "non_lexical", "complete", "fragment", "unknown", "clipped_by_source_boundary"]


def test_disfluencies_and_segments(spark):
    ws = "Um the the\u2026 rather they we\u2014 went".split()
    w = spark.createDataFrame([(1, 0, i + 1, x, len(ws)) for i, x in enumerate(ws)], "corpus_id long, pos long, word_no long, word string, n_words long")
    assert rows(transcript.disfluencies(w), "word_no", "kind") == [(1, "filler"), (3, "hesitation"), (3, "repetition"), (4, "explicit_correction"), (6, "false_start")]
    a = spark.createDataFrame([(1, i, 0, s, t, b, e) for i, (s, t, b, e) in enumerate([("A", "so we", 0, 10), ("A", "left.", 12, 20), ("A", "Then", 20, 30), ("B", "no", 30, 40), ("B", "yes", 39, 45), ("B", "on", 146, 150)])], "corpus_id long, pos long, line_no long, speaker string, text string, start_us long, end_us long")
    assert [s for _, s in rows(transcript.segments(a, 100), "pos", "segment")] == [0, 0, 1, 2, 3, 4]


def test_lines_and_cues(spark):
    u = utter(spark, [("A", "aa bb  cccccc d", 0, 4_000_000), ("A", " ", 5, 6)])
    assert u.select(transcript.lines(F.col("text"), 5).alias("l")).collect()[0].l == ["aa bb", "cccccc", "d"] and u.select(transcript.lines(F.col("text")).alias("l")).collect()[1].l == []
    assert rows(transcript.cues(u, 84, 2_000_000), "cue_no", "text", "start_us", "end_us") == [(1, "aa bb", 0, 2_000_000), (2, "cccccc d", 2_000_000, 4_000_000)]
    c = transcript.cues(u.where("pos = 0"), 84, 2_000_000)
    assert rows(subtitles.blocks(c, "srt"), "block")[0] == ("1\n00:00:00,000 --> 00:00:02,000\naa bb\n",)


def test_subtitle_files(spark, tmp_path):
    c = spark.createDataFrame([(7, 0, 1, "one", 0, 999), (7, 1, 1, "two", 1_000_500, 1_000_600)], "corpus_id long, pos long, cue_no long, text string, start_us long, end_us long")
    subtitles.write(c, "vtt", f"file://{tmp_path}/out")
    got = "".join(p.read_text() for p in sorted((tmp_path / "out" / "corpus_id=7").glob("part-*")))
    assert got.split("\n") == ["WEBVTT", "", "00:00:00.000 --> 00:00:00.001", "one", "", "00:00:01.000 --> 00:00:01.001", "two", "", ""]


def test_context_windows(spark):
    u = utter(spark, [(s, "x", b * 10**6, (b + 5) * 10**6) for s, b in [("A", 0), ("A", 10), ("B", 30), ("A", 80)]])
    got = {(k, p): sorted(r[2] for r in rs) for (k, p), rs in itertools.groupby(sorted(rows(context.windows(u), "kind", "pos", "member")), lambda r: (r[0], r[1]))}
    assert got["preceding", 3] == [0, 1, 2] and got["following", 0] == [1, 2, 3] and got["same_speaker", 3] == [0, 1] and got["exchange", 1] == [0, 1, 2]
    assert got["current_turn", 0] == [0, 1] and got["current_turn", 2] == [2] and got["temporal", 2] == [0, 1, 2] and got["temporal", 3] == [3]


def test_budgets(spark):
    facts = [(p, "AB"[p % 2], 100, 10 * p, 10 * p + 10) for p in range(6)]
    got = context.selected(2, facts, 3, 1000, 1000)
    assert [p for p, w in got.items() if w == "member"] == [2, 1, 3] and set(got) == set(range(6))
    got = context.selected(2, facts, 99, 350, 25)
    assert got[2] == "member" and got[1] == "member" and sorted(got.values()).count("member") == 2 and set(got.values()) == {"member", "duration"}
    assert context.selected(2, facts, 2, 1000, 1000)[0] == "utterances" and context.selected(2, facts, 9, 250, 1000)[0] == "tokens"
    with pytest.raises(ValueError):
        context.selected(2, facts, 9, 50, 1000)
    u = utter(spark, [("AB"[i % 2], "word " * 100, i * 10**7, (i + 1) * 10**7) for i in range(20)])
    out = context.budgeted(u, context.within(u, 30_000_000)).collect()
    near = {p: [r.member for r in out if r.pos == p] for p in range(20)}
    assert all(sorted(near[p]) == [q for q in range(20) if abs(p - q) <= 4] for p in near)
    for p in near:
        rows_ = [(q, "AB"[q % 2], 125, q * 10**7, (q + 1) * 10**7) for q in near[p]]
        assert {r.member: r.decision for r in out if r.pos == p} == context.selected(p, rows_)


def test_error_components_shuffle_intervals_once(spark):
    rows_ = [(1, i, "ab"[i % 2], 10 * i % 70, 10 * i % 70 + 25) for i in range(20)] * 2 + [(1, 99, None, 0, 300), (2, 1, "a", 5, 5)]
    ref = spark.createDataFrame(rows_, "corpus_id long, interval_id long, label string, start_us long, end_us long")
    said = ref.where("label is not null").withColumns({"start_us": F.col("start_us") + 7, "end_us": F.col("end_us") + 7})
    out = matching.error_components(ref, said, 1, 64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan.replace("JoinSelection", "")

    def on(rs, at, shift):
        return {x for _, _, x, a, b in rs if x and a + shift <= at < b + shift}

    edges = {t for k, _, _, a, b in rows_ if k == 1 for t in (a, b)}
    want = [0] * 5
    for at in range(310):
        if not any(max(t - 1, 0) <= at < t + 1 for t in edges):
            r, s = on(rows_, at, 0), on(rows_, at, 7)
            for i, x in enumerate((len(r), len(r & s), max(len(r) - len(s), 0), max(len(s) - len(r), 0), min(len(r), len(s)) - len(r & s))):
                want[i] += x
    got = {x.corpus_id: list(x)[1:6] for x in out.collect()}
    assert got == {1: want}


def test_a_target_too_large_for_its_budget_is_left_out_and_stops_no_other(spark):
    u = utter(spark, [("A", "a", 0, 1_000_000), ("B", "b" * 2_001, 1_000_000, 121_060_000), ("A", "c", 121_060_000, 122_000_000)])
    got = {(r.pos, r.member): r.decision for r in context.budgeted(u, context.within(u, 30_000_000)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): "target", (1, 1): "duration", (1, 2): "target"}
    assert {k: v for k, v in got.items() if k[0] != 1} == {(0, 0): "member", (0, 1): "duration", (2, 2): "member", (2, 1): "duration"}


def test_metric_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "i long, l string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "y")], "i long, l string")
    assert rows(metrics.multiset_scores(a, b, "i", "l"), "l", "tp", "fp", "fn") == [("x", 1, 0, 2), ("y", 1, 2, 0)]
    assert rows(metrics.set_agreement(a, b, "i", "l"), "n", "exact", "mean_jaccard") == [(2, 1, 0.5)]
    s = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (None,)], "s double")
    assert rows(metrics.confidence_bands(s, "s"), "band", "n") == [("high", 1), ("low", 1), ("medium", 1), ("unavailable", 1)]
    assert rows(metrics.confidence_bands(s.limit(0), "s"), "n") == [(0,)] * 4


def test_records(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    records.append_json_lines(df, path)
    records.append_json_lines(df, path)
    assert sorted((tuple(r) for r in records.read_json_lines(spark, path, df.schema).collect()), key=str) == [(1, "a"), (1, "a"), (2, None), (2, None)]
    (tmp_path / "r" / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_json_lines(spark, path, df.schema).collect()


def test_register_and_verify(spark, tmp_path):
    files = tmp_path / "s"
    (files / "in").mkdir(parents=True)
    (files / "a.wav").write_bytes(b"abc")
    (files / "in" / "b.bin").write_bytes(b"x")
    first = records.register(spark, f"file://{files}").collect()
    assert sorted((r.path.rpartition("/")[2], r["size"], r.media_type) for r in first) == [("a.wav", 3, "audio/x-wav"), ("b.bin", 1, "application/octet-stream")]
    recorded = spark.createDataFrame(first)
    (files / "a.wav").write_bytes(b"abd")
    (files / "in" / "b.bin").rename(files / "in" / "c.bin")
    got = records.verify(recorded, records.register(spark, f"file://{files}")).collect()
    assert sorted((r.path.rpartition("/")[2], r.status) for r in got) == [("a.wav", "changed"), ("b.bin", "missing"), ("c.bin", "unrecorded")]


def test_streamed_contexts(spark, tmp_path):
    for n, batch in enumerate([[(1, 0), (1, 1), (2, 5)], [(1, 2), (1, 3), (1, 1)]]):
        spark.createDataFrame(batch, "corpus_id long, pos long").coalesce(1).write.json(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema("corpus_id long, pos long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in/*")
    q = bounded.contexts(stream, 2).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.corpus_id, r.pos, r.context) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, 0, []), (1, 1, [0]), (1, 2, [0, 1]), (1, 3, [1, 2]), (2, 5, [])]


def test_streamed_sessions(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 01:00:00")], "corpus_id long, t string").coalesce(1).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("corpus_id long, t string").json(f"file://{tmp_path}/in").select("corpus_id", F.col("t").cast("timestamp").alias("at"))
    q = bounded.sessions(stream, "10 seconds", "1 minute").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.corpus_id, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, 1), (1, 2)]
