import random

import numpy as np

from colloquy.llm import tandem_runs as R


def plain_runs(w, least=1):
    """Runs by their definition: for each distance, the maximal stretches of agreement; smaller periods win."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, 2 * q) and j > i and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences(rng, count, size, kinds):
    for t in range(count):
        k, n = rng.choice(kinds), rng.randrange(1, size)
        w = [rng.randrange(k) for _ in range(n)]
        if t % 3 == 0:
            p = rng.randrange(1, n + 1)
            w = (w[:p] * n)[:n]
        if t % 5 == 0:
            w += [rng.randrange(k) for _ in range(rng.randrange(20))] + w[: rng.randrange(1, n + 1)]
        yield w


def test_runs_equal_their_definition():
    for w in sequences(random.Random(5), 1500, 50, (1, 2, 2, 3, 5)):
        got = sorted(zip(*(x.tolist() for x in R.runs_of(np.array(w))), strict=True), key=lambda x: (x[0], x[2]))
        assert got == plain_runs(w)


def test_stretches_lose_no_run_and_texts_share_a_tree():
    rng = random.Random(8)
    found = 0
    for _ in range(60):
        texts = [[b"%d" % x for x in w] for w in sequences(rng, 8, 140, (1, 2, 4, 30, 200))] + [[]]
        for words, runs in zip(texts, R.runs_of_texts(texts), strict=True):
            assert runs == plain_runs(words, R.MIN_RUN)
            found += len(runs)
    assert found > 300


def test_squares_of_powers_belong_to_their_roots_run():
    assert [x.tolist() for x in R.runs_of(np.array([0, 1] * 8))] == [[0], [16], [2]]
    assert [x.tolist() for x in R.runs_of(np.zeros(40, np.int64))] == [[0], [40], [1]]


def test_every_row_gives_a_row(spark):
    long = " ".join(["a b c"] * 20000) + " end"
    rows = [(1, "x " * 12, 7, 1), (1, "x " * 12, 7, 2), (None, "a b c d e f " * 2, 7, 3), (2, None, 7, 4), (3, "", 7, 5), (4, "one two", 7, 6), (5, long, 7, 7), (6, "p q\tp q\np q p q p q p q z", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, k int")
    got = {}
    for r in R.periodic_runs(docs).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.n_words, r.collapsed))
    assert got[1] == [([(0, 12, 1)], 12, "x")] * 2
    assert got[None] == [([(0, 12, 6)], 12, "a b c d e f")]
    assert got[2] == got[3] == [([], 0, "")] and got[4] == [([], 2, "one two")]
    assert got[5] == [([(0, 60000, 3)], 60001, "a b c end")]
    assert got[6] == [([(0, 12, 2)], 13, "p q z")]
    assert R.periodic_runs(docs.limit(0)).collect() == []


def test_digests_name_the_longest_run(spark):
    import hashlib

    text = "x " * 12 + "stop " + "y z " * 8 + "stop " + "u v " * 8 + "end"
    docs = spark.createDataFrame([(11, text), (12, None)], "doc_id long, text string")
    a, b = sorted(R.digests(R.periodic_runs(docs)).collect(), key=lambda r: r.doc_id)
    assert (a.n_runs, a.start, a.length, a.period, a.exponent_milli) == (3, 13, 16, 2, 8000)
    assert a.runs_sha256 == hashlib.sha256(b"0,12,1\n13,16,2\n30,16,2\n").hexdigest()
    assert a.collapsed_sha256 == hashlib.sha256(b"x stop y z stop u v end").hexdigest()
    assert (b.n_runs, b.start, b.length, b.period, b.exponent_milli) == (0, None, None, None, None)
    assert b.runs_sha256 == b.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_query_equals_the_definition_on_the_smallest_tables(spark):
    import hashlib
    import zlib

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in R.op11_tandem_runs(spark, d).collect()}
    seen = 0
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        runs = plain_runs(words, 12)
        seen += bool(runs)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert got[r.doc_id].n_runs == len(runs)
        assert got[r.doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got[r.doc_id].collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert seen > 5
