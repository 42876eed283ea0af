import hashlib
import random

import corpus_pipeline as P
import test_decontaminate
import test_ngram_join
import test_suffix_dedup
from colloquy.llm import byte_bpe, toxicity
from colloquy.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(k, t, "en", "hot", len(t or "")) for k, t in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def cases():
    rng = random.Random(9)
    voc = [f"{a}{b}" for a in "ba ke li mo nu ra si to".split() for b in "fa ge hi jo".split()]
    words = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    bad = "scumlord filthbag vermintype".split()
    docs = [(i, words(40) + (" you are a " + " ".join(rng.sample(bad, 2)) if i % 5 == 0 else "")) for i in range(300)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 300, 1) if i % 7]
    items = [(1, words(14)), (2, words(4)), (3, None)]
    passage = words(60)
    docs += [(300 + i, docs[i + 1][1]) for i in range(3)]  # exact copies
    docs += [(310, docs[11][1] + " tail"), (311, words(20) + " " + items[0][1] + " " + words(9)), (312, None), (313, ""), (314, words(3) + " " + passage), (315, passage + " " + words(7)), (316, "so you SCUMLORD and filthbagg")]
    return docs, labels, items


def truth(docs, items, score):
    docs = [(k, t) for k, t in docs if score(t) < 0.5]
    first = test_ngram_join.truth(docs)
    docs = sorted((k, t) for k, t in docs if first[k][0] == k)
    docs = [(k, None if t is None else kept.decode(errors="ignore")) for (k, t), (_, _, _, _, kept) in zip(docs, test_suffix_dedup.truth(docs, 100), strict=True)]
    leaks = {r[0] for r in test_decontaminate.truth(docs, items) if r[-1]}
    enc = byte_bpe.encoding(tokenizer_path(byte_bpe.RANKS))
    out = []
    for k, t in docs:
        if k not in leaks:
            ids = enc.encode_ordinary(t or "")
            out.append((k, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark, tmp_path):
    docs, labels, items = cases()
    folder = f"file://{tmp_path}"
    tables(spark, folder, docs, labels, items)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    scorer = toxicity.Scorer(toxicity.train(read("documents"), read("labels")))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, folder).collect())
    assert got == truth(docs, items, scorer.score)
    kept = {r[0] for r in got}
    assert 312 in kept and 316 not in kept and 311 not in kept and not kept & {300, 301, 302, 310}


def test_stages_keep_columns_and_take_empty_and_null(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder, [(1, None), (1, None), (None, "a b"), (2, "")], [(1, None, None)], [(None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df, n in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == docs.columns and out.count() <= n
        assert P.STAGES[-1][1](spark, df, folder).count() == n


def test_copies_without_own_key_and_clashing_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder, [(1, "x")], [(1, None, None)], [(None, None)])
    text = "one two three four five six seven"
    rows = [(1, text, 0.5), (1, text, 0.5), (None, text, 0.1), (None, text, 0.1), (1, "another text of its own that says more", 0.2), (None, None, 0.3), (None, None, 0.3), (3, "", 0.4), (4, "", 0.4)]
    df = spark.createDataFrame([(k, t, s, 1, 2, 3, 4, 5, 6) for k, t, s in rows], "doc_id long, text string, score double, k int, h int, row int, node int, d int, hit_h int")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        got = sorted(((r.doc_id, r.text, r.score) for r in out.collect()), key=str)
        if name == "ngram_join":
            assert got == sorted([(1, text, 0.5), rows[4], rows[5], rows[6], (3, "", 0.4)], key=str)
        elif name == "suffix_dedup":
            assert [x[0] for x in got] == [x[0] for x in sorted(rows, key=str)]
        else:
            assert got == sorted(rows, key=str)
    assert P.STAGES[-1][1](spark, df, folder).count() == len(rows)
