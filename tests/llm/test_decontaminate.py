import hashlib
import random
import re

from colloquy.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(str.maketrans(D.ASCII_UPPER, D.ASCII_LOWER)))


def truth(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            m = min(10, len(v))
            windows = {tuple(v[p : p + m]) for p in range(len(v) - m + 1)} if v else set()
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    voc = ["a", "b", "the", "Éa", "ß", "x1", "日本"]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(14)] + [(99, None), (2, "same item twice " * 5), (100, "--"), (101, "unique passage of exactly ten words in one item here now")]
    docs = [(i, "".join(rng.choice(voc) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.choice([0, 3, 9, 10, 40, 300])))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "!!"), (None, items[-1][1].upper()), (53, "xx " * 3 + items[-1][1] + " yy"), (53, "other"), (54, docs[5][1]), (54, docs[5][1]), (55, "in " * 5000), (56, "x y " * 6 + (items[3][1] or "") * 2)]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, h int, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in D.decontaminate(d, b).collect()], key=str)


def test_equals_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == truth(docs, items)


def test_long_items_only_and_large_benchmark(spark, monkeypatch):
    docs, items = cases()
    items = [i for i in items if len(words(i[1])) >= 10]
    assert run(spark, docs, items) == truth(docs, items)
    for bits in ("BITS", "FIRST_BITS"):  # maps that let nearly all windows through
        monkeypatch.setattr(D, bits, 64)
    docs, items = cases()
    assert run(spark, docs, items) == truth(docs, items)


def test_empty(spark):
    docs, items = cases()
    assert run(spark, docs[:5], []) == truth(docs[:5], [])
    assert run(spark, [], items) == []


def test_very_long_text(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[::-1]))]
    items = [(1, " ".join(w[70_000:70_040])), (2, " ".join(w[149_997:])), (3, " ".join(w[:10]))]
    (_, n, n_hit, n_items, _, hit), (_, m, *_) = run(spark, docs, items)
    assert (n, m) == (150_000, 150_000) and hit and n_items == 3 and n_hit >= 53


def test_clean_rows_stay(spark):
    """A contaminated row takes no other with it that has its doc_id, or none."""
    item = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, item, 0), (1, "clean", 1), (None, item, 2), (None, "clean", 3), (None, None, 4)], "doc_id long, text string, h int")
    rows = D.uncontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert rows.columns == df.columns and sorted(r.h for r in rows.collect()) == [1, 3, 4]


def test_null_and_empty_keys_stay_apart(spark):
    items = [(1, "unique passage of exactly ten words in one item here now")]
    docs = spark.createDataFrame([(None, items[0][1]), ("", items[0][1]), ("", "clean"), (None, None)], "doc_id string, text string")
    got = D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=str) == sorted([(None, 11, 11), ("", 11, 11), ("", 1, 0), (None, 0, 0)], key=str)
    assert sorted((r.doc_id for r in D.uncontaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str) == ["", None]
