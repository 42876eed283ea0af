import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from colloquy.operators import addressing as A


def test_microseconds_round_halves_to_the_even(spark):
    texts = ["1.0000005", "1.0000015", "1.0000025", "-0.0000005", "-1.0000015", "0", "12", ".5", "3.", " 7.25 ", "1e-6", "2.5E3", "N/A", "", None, "abc", "1.2.3", "--1", "123456789.1234567"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.us for r in df.select("i", A.microseconds(F.col("t")).alias("us")).collect()}
    for i, t in enumerate(texts):
        try:
            want = int((Decimal(t.strip()) * 1_000_000).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
        except Exception:  # noqa: BLE001
            want = None
        assert got[i] == want, t


def test_tags_and_points(spark):
    df = spark.createDataFrame([(1, {"b": "2", "a": None}, [3, 1, None], [2, 3]), (2, None, None, None)], "i int, m map<string, string>, p array<bigint>, q array<bigint>")
    got = {r.i: ([tuple(x) for x in r.t], list(r.p)) for r in df.select("i", A.tag_pairs(F.col("m")).alias("t"), A.merged_points(F.col("p"), F.col("q")).alias("p")).collect()}
    assert got == {1: ([("a", None), ("b", "2")], [1, 2, 3]), 2: ([], [])}


def test_nearest_frames_equal_a_search(spark):
    rng = random.Random(3)
    frames = [(k, rng.randrange(200)) for k in range(3) for _ in range(12)] + [(0, None)]
    asked = [(k, f"{k}-{i}", rng.randrange(-10, 215)) for k in range(4) for i in range(40)]
    got = {r.ask_id: (r.frame_us, r.error_us) for r in A.nearest_frames(spark.createDataFrame(asked, "corpus_id long, ask_id string, at_us long"), spark.createDataFrame(frames, "corpus_id long, frame_us long"), 9).collect()}
    for k, i, t in asked:
        near = min(((abs(f - t), f) for x, f in frames if x == k and f is not None), default=None)
        assert got[i] == ((near[1], near[0]) if near and near[0] <= 9 else (None, None))


def test_sets_of_evidence(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 5, "null"), (None, 4, None)], "v string, o int, x string")
    assert sorted(((r.v, r.o, r.x) for r in A.first_occurrences(df, ["v"], ["o"]).collect()), key=str) == sorted([("a", 1, "early"), (None, 4, None)], key=str)
    c = spark.createDataFrame([(1, "p"), (1, "q"), (1, "r"), (1, "r"), (2, "s")], "u int, c string")
    x = spark.createDataFrame([("q", "p")], "a string, b string")
    assert {r.c: list(r.compatible) for r in A.compatible(c, x, ["u"], "c").collect()} == {"p": ["r"], "q": ["r"], "r": ["p", "q"], "s": []}
    acts = spark.createDataFrame([("a", "concession.partial"), ("b", "concession.full"), ("c", "concession.partial")], "act_id string, type string")
    q = spark.createDataFrame([("a", 2, "only"), ("a", 1, "if"), ("a", 3, "if"), ("a", 4, None), ("b", 1, "if")], "act_id string, n int, text string")
    assert {r.act_id: list(r.retained) for r in A.retained_disagreements(acts, q).collect()} == {"a": ["if", "only"], "b": [], "c": []}
    cues = spark.createDataFrame([(1, 1, ["s1"], ["w1", "w2"]), (1, 2, [], ["w3"]), (2, 1, ["s1"], [])], "corpus_id int, cue int, segments array<string>, words array<string>")
    regions = spark.createDataFrame([(1, "r1", "s1", None), (1, "r2", "s1", "w2"), (1, "r3", "s9", "w9")], "corpus_id int, region_id string, segment_id string, word_id string")
    assert {(r.corpus_id, r.cue): list(r.regions) for r in A.cue_regions(cues, regions, ["corpus_id", "cue"]).collect()} == {(1, 1): ["r1", "r2"], (1, 2): [], (2, 1): []}


def test_selection_and_counters(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "x"), (1, "d", None), (2, "a", None), (3, "a", "x")], "corpus_id int, reference_id string, expected string")
    met = spark.createDataFrame([(1, "a", ["x", "z"]), (1, "b", ["x"]), (1, "d", ["x"]), (2, "a", ["x"])], "corpus_id int, reference_id string, selected array<string>")
    got = {r.corpus_id: (r.evaluated, r.correct, r.accuracy, r.unavailable) for r in A.candidate_selection(refs, met).collect()}
    assert got == {1: (2, 1, 0.5, None), 2: (0, 0, None, "unavailable_reference"), 3: (0, 0, None, "unavailable_hypothesis")}
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "z"), (2, "b")], "k int, v string")
    assert {r.k: (r.n, r.a, r.b, r.other) for r in A.counters(df, ["k"], "v", ["a", "b"]).collect()} == {1: (4, 2, 0, 2), 2: (1, 0, 1, 0)}


def test_inventories_agree_in_any_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "k int, v string, x double")
    got = {r.part: (r.n, r.digest) for r in A.inventory({"a": df, "b": df.orderBy(F.desc("k")).repartition(3), "c": df.distinct(), "d": df.limit(0), "e": df.withColumn("v", F.coalesce("v", F.lit("")))}).collect()}
    assert got["a"] == got["b"] and got["a"][0] == 3
    assert len({d for _, d in got.values()}) == 4
