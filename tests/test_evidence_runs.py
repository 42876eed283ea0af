import random

from pyspark.sql import functions as F

from colloquy.operators import assembly as S
from colloquy.operators import frames as R
from colloquy.operators import proposals as P
from colloquy.streaming import incremental as T


def test_assembly_promotes_tells_and_folds(spark):
    obs = spark.createDataFrame(
        [(1, "o1", 0, 10, "a", [0.9], 0.9, 0.9), (1, "o2", 10, 20, None, [], 0.9, 0.9), (1, "o3", 20, 30, "b", [0.1, None], None, 0.2), (2, "o1", 0, 10, "a", None, 0.5, 0.5), (3, "o1", 0, 10, "a", [0.9], 0.9, 0.9), (4, "o1", 0, 10, "zz", [0.9], 0.9, 0.9)],
        "corpus_id long, observation_id string, start_us long, end_us long, selected string, speech array<double>, timing double, boundary double",
    )
    cands = spark.createDataFrame([(1, "o1", "a", "ﬁne  text", 0.8), (1, "o2", "a", "x", 0.8), (1, "o3", "b", "low", 0.1), (1, "o3", "a", "alt", None), (2, "o1", "a", "plain", 0.5), (3, "o1", "a", " \n", 0.9), (4, "o1", "a", "x", 0.9)], "corpus_id long, observation_id string, candidate_id string, text string, confidence double")
    words = spark.createDataFrame(
        [(1, "o1", "a", 1, "ﬁne", 0, 5, 0.9, 0.9), (1, "o1", "a", 2, "text", None, 9, 0.9, 0.9), (1, "o2", "a", 1, "x", 0, 1, 0.9, 0.9), (1, "o3", "b", 1, "low", 20, 25, None, 0.3), (1, "o3", "a", 1, "alt", 20, 25, 0.1, 0.1), (2, "o1", "a", 1, "plain", 0, 5, 0.9, 0.9), (2, "o1", "a", 2, " ", 0, 5, 0.9, 0.9)],
        "corpus_id long, observation_id string, candidate_id string, n int, text string, start_us long, end_us long, recognition double, timing double",
    )
    segments, good, regions, statuses = S.assemble(obs, cands, words)
    got = {(r.corpus_id, r.segment_id): (r.normalized, list(r.alternatives), list(r.classes)) for r in segments.collect()}
    assert got == {
        (1, "o1:a"): ("fine text", [], []),
        (1, "o3:b"): ("low", ["a"], [S.LOW_TEXT, S.NO_TIMING, S.EDGE, S.SEVERAL, S.LOW_SPEECH]),
        (2, "o1:a"): ("plain", [], []),
    }
    assert sorted((r.corpus_id, r.segment_id, r.n, r.normalized) for r in good.collect()) == [(1, "o1:a", 1, "fine"), (1, "o3:b", 1, "low"), (2, "o1:a", 1, "plain")]
    told = {(r.corpus_id, r.observation_id, r.n, r["class"], r.blocks, r.start_us, r.end_us) for r in regions.where("n is not null or class = 'missing_output'").collect()}
    assert told == {
        (1, "o1", 2, S.LOST_WORD, False, 0, 10), (1, "o2", None, S.MISSING, True, 10, 20), (1, "o3", 1, S.NO_TEXT, False, 20, 25), (1, "o3", 1, S.LOW_TIMING, False, 20, 25), (2, "o1", 2, S.LOST_WORD, False, 0, 10), (3, "o1", None, S.MISSING, True, 0, 10), (4, "o1", None, S.MISSING, True, 0, 10),
    }
    folded = {r.corpus_id: (r.n_observations, r.n_segments, r.n_words, r.status) for r in statuses.collect()}
    assert folded == {1: (3, 2, 2, "blocked"), 2: (1, 1, 1, "review"), 3: (1, 0, 0, "blocked"), 4: (1, 0, 0, "blocked")}
    assert {r.corpus_id: r.status for r in S.assemble(obs, cands, words.where("text <> ' '"), block_missing=False)[3].collect()} == {1: "review", 2: "complete", 3: "review", 4: "review"}


def plain_frames(chunk, start, end, own_start, own_end, decoded, frame):
    covered, out, i = own_start, [], 0
    while i * frame < min(decoded, end - start):
        a, b = start + i * frame, start + min((i + 1) * frame, decoded, end - start)
        x, y = max(a, own_start), min(b, own_end)
        if x < y:
            out.append((chunk, i, x, y, a))
            covered = max(covered, y)
        i += 1
    if own_end - covered > frame:
        return None
    return out + ([(chunk, None, covered, own_end, None)] if covered < own_end else [])


def test_frames_and_runs_equal_a_plain_walk(spark):
    rng, frame = random.Random(2), 7
    chunks, signal, want, runs, failed = [], [], [], [], set()
    for k in range(30):
        at = 0
        for _ in range(rng.randrange(9)):
            at += rng.randrange(9)
            end = at + rng.randrange(1, 25)
            signal.append((k, rng.choice(["speech", "non_speech"]), at, end))
            at = end
        mine = [s for s in signal if s[0] == k]
        for c in range(3):
            start, end = c * 40, c * 40 + 50
            own_start, own_end = start + rng.choice([0, 3, 5]), end - rng.choice([0, 4, 5])
            decoded = 50 - rng.choice([0, 0, 3, 6, 8, 20, 60])
            chunks.append((k, c, start, end, own_start, own_end, decoded))
            got = plain_frames(c, start, end, own_start, own_end, decoded, frame)
            if got is None:
                failed.add((k, c))
                continue
            want += [(k, *g[:4]) for g in got]
            said = []
            for _, _, a, b, zero in got:
                kind = next((s[1] for s in mine if zero is not None and s[2] <= zero < s[3]), R.UNCERTAIN)
                if said and said[-1][0] == kind:
                    said[-1] = (kind, said[-1][1], b, said[-1][3] + 1)
                else:
                    said.append((kind, a, b, 1))
            runs += [(k, c, *s) for s in said]
    frames = spark.createDataFrame(chunks, "corpus_id long, chunk long, start_us long, end_us long, own_start_us long, own_end_us long, decoded_us long")
    heard = spark.createDataFrame(signal, "corpus_id long, class string, start_us long, end_us long")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(((r.corpus_id, r.chunk, r.frame_no, r.start_us, r.end_us) for r in R.frame_grid(frames, frame).collect()), key=key) == sorted(want, key=key)
    assert {(r.corpus_id, r.chunk) for r in R.failures(frames, frame).collect()} == failed and failed
    made = R.frame_runs(frames, heard, frame, 1000)
    assert sorted((r.corpus_id, r.chunk, r["class"], r.start_us, r.end_us, r.frames) for r in made.collect()) == sorted(runs)
    edges = {(r.corpus_id, r.at_us): (r.before, r.after) for r in R.run_edges(made).collect()}
    assert edges.keys() == {(k, t) for k, _, _, a, b, _ in runs for t in (a, b)}
    assert all(edges[k, a][1] is not None for k, _, _, a, _, _ in runs)


def test_chunks_own_a_recording_once(spark):
    rows = [(1, 0), (2, 5), (3, 100), (4, 101), (5, 195), (6, 1000), (7, -4), (8, None)]
    got = {}
    for r in R.recording_chunks(spark.createDataFrame(rows, "corpus_id long, duration_us long"), 100, 10).orderBy("corpus_id", "chunk").collect():
        got.setdefault(r.corpus_id, []).append(tuple(r)[1:])
    assert got.keys() == {2, 3, 4, 5, 6} and got[2] == [(0, 0, 5, 0, 5)] and got[3] == [(0, 0, 100, 0, 100)] and got[4] == [(0, 0, 100, 0, 95), (1, 90, 101, 95, 101)]
    for k, chunks in got.items():
        owned = [c[3:] for c in chunks]
        assert owned[0][0] == 0 and owned[-1][1] == dict(rows)[k] and all(a[1] == b[0] for a, b in zip(owned, owned[1:], strict=False)) and all(c[1] <= c[3] and c[4] <= c[2] for c in chunks)


def test_proposals_are_placed_or_refused(spark):
    u = spark.createDataFrame([(1, 0, "aaa 🙂b"), (1, 1, None)], "corpus_id long, pos long, text string")
    context = spark.createDataFrame([(1, 0, "0"), (1, 0, "1")], "corpus_id long, pos long, member string")
    near, far, both = [("utterance", "identified", "1", ["0"])], [("utterance", "probable", "7", [])], [("utterance", "identified", "8", ["9"]), ("claim", "identified", "x", ["y"])]
    rows = [
        (1, 0, "r", "p1", "aa", None, "g", near), (1, 0, "r", "p2", "🙂b", 4, "g", None), (1, 0, "r", "p3", "aa", 2, None, []), (1, 0, "r", "p4", "zz", None, None, []), (1, 0, "s", "p1", "a", None, "g", far), (1, 0, "s", "p2", "a", 0, None, [("utterance", "uncertain", "7", ["9"])]),
        (1, 0, "s", "p3", "", None, None, []), (1, 1, "t", "p1", "a", None, None, []), (5, 5, "t", "p2", "a", None, None, []), (1, 0, "t", "p3", "b", -1, None, None), (1, 0, "t", "p4", "b", 5, None, both), (1, 0, "t", "p5", "b", 5, None, [("utterance", "uncertain", None, None)]),
    ] + [(1, 0, "many", f"p{i}", "a", 0, None, []) for i in range(6)]
    props = spark.createDataFrame([(*r[:4], "question", *r[4:]) for r in rows], "corpus_id long, pos long, response_id string, proposal_id string, family string, quote string, start int, alternative_group string, targets array<struct<type: string, status: string, id: string, alternatives: array<string>>>")
    got = {(r.response_id, r.proposal_id): (list(r.places), list(r.alternatives), r.reason) for r in P.normalized(props, u, context, ["corpus_id", "pos"]).collect()}
    assert {got.pop(("many", f"p{i}"))[2] for i in range(6)} == {"over_budget"}
    assert got == {
        ("r", "p1"): ([0, 1], ["p2"], None), ("r", "p2"): ([4], ["p1"], None), ("r", "p3"): ([], [], "span_mismatch"), ("r", "p4"): ([], [], "quote_absent"), ("s", "p1"): ([0, 1, 2], [], "target_outside_context"), ("s", "p2"): ([0], [], "alternative_outside_context"),
        ("s", "p3"): ([], [], "empty_quote"), ("t", "p1"): ([], [], "quote_absent"), ("t", "p2"): ([], [], "unknown_utterance"), ("t", "p3"): ([], [], "span_mismatch"), ("t", "p4"): ([5], [], "target_outside_context"), ("t", "p5"): ([5], [], None),
    }


def test_streams_give_what_tables_give(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, p, None if p % 3 else f"a{p}", 1_700_000_000 + 10 * p) for k in range(4) for p in range(45 - 8 * k)]
    rows += [rows[7], rows[30]]  # repeats
    order = sorted(rows, key=lambda r: r[3] + rng.randrange(-25, 25))  # late, but by less than a minute
    last = 1_700_000_000 + 100_000
    parts = [order[i : i + 40] for i in range(0, len(order), 40)] + [[(99, 0, None, last)], [(99, 1, None, last + 1)]]
    schema = "corpus_id long, pos long, act string, t long"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in{i}")
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    for i in range(len(parts)):
        name = next(f for f in os.listdir(tmp_path / f"in{i}") if f.startswith("part-") and f.endswith(".json"))
        shutil.copy(tmp_path / f"in{i}" / name, tmp_path / "in" / f"{i:03}.json")
        os.utime(tmp_path / "in" / f"{i:03}.json", (1_600_000_000 + i, 1_600_000_000 + i))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in").withColumn("at", F.timestamp_seconds("t"))
    q = T.stream(read, "60 seconds", 300_000, 5, 7).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted((r.corpus_id, r.pos, tuple(r.context), tuple(r.acts), r.digest) for r in spark.read.parquet(f"file://{tmp_path}/out").where("corpus_id < 99").collect())
    whole = T.contexts(spark.createDataFrame(rows, schema), most=5, search=7)
    want = sorted((r.corpus_id, r.pos, tuple(r.context), tuple(r.acts), r.digest) for r in whole.collect())
    assert got == want and len(want) == 45 + 37 + 29 + 21
    assert max(len(r[2]) for r in want) == 5 and max(len(r[3]) for r in want) == 7
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # finished recordings are gone


def test_contexts_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 0, "x"), (None, 1, None), (1, 3, "b"), (1, 3, "a"), (1, None, "z")], "corpus_id long, pos long, act string")
    got = sorted(((r.corpus_id, r.pos, list(r.context), list(r.acts)) for r in T.contexts(rows).collect()), key=str)
    assert got == sorted([(1, 3, [], []), (None, 0, [], []), (None, 1, [0], ["x"])], key=str)
    assert T.contexts(rows.limit(0)).collect() == []
