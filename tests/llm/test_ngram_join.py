import random
import re

import numpy as np
import pytest

from colloquy.llm import ngram_join as N

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset([text])


def truth(docs):
    """{key: (class_id, n_links)} of (key, text) with distinct keys, by comparing all pairs."""
    sets = {k: None if t is None else shingle_set(t) for k, t in docs}

    def linked(a, b):
        if a is None or b is None:
            return False
        return a == b or 5 * len(a & b) >= 4 * len(a | b)

    links = {k: [j for j in sets if j != k and linked(sets[k], sets[j])] for k in sets}
    out = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (min(seen), len(links[k]))
    return out


def cases():
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(300)] + ["Été", "日本"]
    docs = []
    for _ in range(25):
        w = [rng.choice(voc) for _ in range(rng.choice([4, 30, 120, 400]))]
        docs.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = rng.choice(voc)
            docs.append(", ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    docs += [None, None, "", "", "!!", "!!", "?", "a b", "A  b", "same " * 4000, "same " * 5]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("together", [3000, 2])  # also with clusters cut into blocks
def test_equals_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(N, "TOGETHER", together)
    docs = cases()
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, node int, n_links int").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.similar(df).collect()}
    assert got == truth(docs)


def test_repeated_and_null_keys_and_empty(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in N.similar(df).collect()), key=str)
    assert got == sorted([(7, 7, 2, 3), (7, 7, 2, 3), (None, 7, 2, 3), (3, 3, 0, 1), (None, None, 0, 1)], key=str)
    assert N.similar(df.limit(0)).collect() == []


def test_recall_counts_what_was_missed():
    near, exact = np.zeros(N.STEPS), np.zeros(N.STEPS)
    near[0] = exact[-1] = 10
    at = [N.recall_of(near, d) for d in (6, 5, 4)]
    assert at[0] < N.RECALL < at[1] < at[2] and N.recall_of(exact, 6) > 0.999999 and N.recall_of(np.zeros(N.STEPS), 6) == 1


def test_prefixes_shorten_until_recall(spark, monkeypatch):
    depths = []
    links_of = N.links_of
    monkeypatch.setattr(N, "links_of", lambda *a: depths.append(a[-1]) or links_of(*a))
    rng = random.Random(1)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(40)]
    docs = [(2 * i + k, " ".join(w[: 100 - 15 * k] + ["x"] * (15 * k))) for i, w in enumerate(base) for k in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in N.similar(df).collect()} == truth(docs)
    assert depths[0] == N.LONGEST and depths == sorted(depths, reverse=True) and len(depths) > 1


def test_common_passage_makes_no_cluster(spark):
    """Texts that only share a passage meet in buckets, but not in clusters."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 200)))) for i in range(4000)]
    nodes = N.nodes_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "doc_id", "text").drop("k", "h")
    sizes = [r["count"] for r in N.clusters_of(N.written(nodes, "test-nodes"), 5).groupBy("root").count().collect()]
    assert max(sizes, default=0) < 50


def test_joined_matches_pairs():
    rng = np.random.default_rng(3)
    sign = rng.integers(0, 2, (300, 16)).astype(np.uint8)
    group = np.sort(rng.integers(0, 9, 300))
    root = N.joined(group, sign, 13)
    want = list(range(300))
    links = [(i, j) for i in range(300) for j in range(i) if group[i] == group[j] and (sign[i] == sign[j]).sum() >= 13]
    for _ in range(300):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert root.tolist() == want


def test_very_long_texts(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:58_000])), (3, " ".join(reversed(w)))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
