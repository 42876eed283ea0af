"""Held-out accuracy of the trained operators, and their defined cases."""

import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import language_id as L
from colloquy.llm import suffix_tree_lm as S
from colloquy.llm import toxicity as X

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op2_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    tested = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != L.UNKNOWN]
    assert len(tested) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [("the cat sat on the mat and then it slept", "en"), ("der Hund und die Katze sind nicht hier", "de")] * 20
    df = spark.createDataFrame(rows, "text string, lang string")
    net = L.train(df)
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 34 !!", 0.0), (4, "und die Katze ist der Hund", 0.0), (4, "the mat and the cat", 0.0), (None, "the cat " * 20000, 0.0)], "doc_id long, text string, score double")
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(docs, net).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en"), (None, "en")], key=str)
    assert all(np.allclose(p.sum(1), 1, atol=1e-4) and len(p) == len(s.encode()) for s, p in net.label_positions("the cat"))
    nothing = L.train(df.where("false"))
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"} and L.predict(docs.limit(0), net).collect() == []


def test_languages_of_many_copies_are_learned(spark):
    english = spark.range(3000).selectExpr("concat('the word number ', id, ' is in english') AS text", "'en' AS lang")
    french = spark.range(40000).selectExpr("if(id % 2 = 0, 'voici une phrase en français', 'et une autre phrase française') AS text", "'fr' AS lang")
    net = L.train(english.union(french))
    assert sorted(net.labels) == ["en", "fr"]
    assert [label for label, _ in L.Predictor(net).predict(["voici une phrase en français", "the word number 77 is in english"])] == ["fr", "en"]


def test_language_predictions_match_a_plain_pass(spark):
    """What workers compute from tables of segments, against every position's probabilities one text at a time."""
    rows = [("the cat sat on the mat and then it slept", "en"), ("der Hund und die Katze sind nicht hier", "de"), ("le chat dort ici, et le chien l\u00e0-bas", "fr")] * 9
    net = L.train(spark.createDataFrame(rows, "text string, lang string"))
    assert net.labels == ["de", "en", "fr"]
    texts = ["the Cat, 12 mats", "und so weiter: " + "wort" * 40, "l\u00e0 \U0001d11e x", "\u00b2 \u00bd \u2167", "7 ate 9"]
    for text, (lang, score) in zip(texts, L.Predictor(net).predict(texts), strict=True):
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.zeros(3)
        for s, p in ((s, p) for w in text.lower().split() for s in L.segments(w) for p in [np.exp(net.log_probs(*L.packed([s])))[:, 0]]):
            total += np.log(p).sum(0) / np.sqrt(len(s))
        p = np.exp(total - total.max())
        assert net.labels[int(total.argmax())] == lang and abs(score - p.max() / p.sum()) < 1e-3


def test_language_gradient():
    net = L.Network.new(["a", "b"], 1)
    x, mask = L.packed([b" abc ", b" de "])
    y, w = np.eye(2, dtype=np.float32), np.ones(2, np.float32)

    def loss():
        p = net.log_probs(x, mask)
        return -sum((p[:, i] @ y[i] * mask[i]).sum() / mask[i].sum() for i in range(2)) / 2

    grad = net.step(x, mask, y, w)
    for name, at in (("lU", (1, 5)), ("rU", (2, 30)), ("lW", (3, 4)), ("rb", (7,)), ("V", (2, 1)), ("lE", (ord("b"), 2))):
        weight, eps = net.weights()[name], 1e-2
        old = weight[at]
        weight[at] = old + eps
        up = loss()
        weight[at] = old - eps
        down = loss()
        weight[at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 2e-3


@needs_tables
def test_toxicity_held_out_accuracy(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = X.op10_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) in (0, 1)]
    assert len(tested) > 50 and sum(a == b for a, b in tested) >= 0.9 * len(tested)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automata_equal_brute_force():
    rng = np.random.default_rng(3)
    terms = ["abcd", "abbe", "abcdabc", "bad", "dcbaabcdc"]
    a = X.Automaton([(t, False) for t in terms])
    for _ in range(3000):
        word = "".join(rng.choice(list("abcd"), rng.integers(0, 11)))
        want = min(((d, k) for k, t in enumerate(terms) if (d := distance(word, t)) <= X.edits(len(t))), default=None)
        assert a.match(word) == want


def test_toxicity_cases(spark):
    rows = [(i, ("you vile scumlord " if i % 4 == 0 else "a fine kind day ") + f"word{i} here", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.train(docs, labels)
    cases = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "vile scumlorrd", 1), (3, "fine day", 1), (None, "fine " * 50000, 1)], "doc_id long, text string, score int")
    got = sorted([(r.doc_id, r.score >= 0.5) for r in X.score(cases, model).collect()], key=str)
    assert got == sorted([(1, False), (2, False), (3, True), (3, False), (None, False)], key=str)
    scorer = X.Scorer(model)
    assert scorer.mass('he said "scumlord" was the word') < scorer.mass("you scumlord")
    assert X.score(cases.limit(0), model).collect() == []
    nothing = X.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.score(cases, nothing).collect()} == {0.0}


def test_toxicity_sample_keeps_the_true_shares(spark, monkeypatch):
    rows = [(i, "you vile scumlord " * (i % 3 != 0) + f"word{i}", 1) for i in range(200)] + [(i, 'he said "scumlord" ' * (i % 20 == 0) + f"word{i}", 0) for i in range(200, 2200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    whole = X.train(docs, labels)
    monkeypatch.setattr(X, "SAMPLE_CLEAN", 300)
    part = X.train(docs, labels)
    assert whole.terms and abs(X.Scorer(part).score("a plain text") - X.Scorer(whole).score("a plain text")) < 0.02
    x, y = np.array([0.0, 1, 1, 2]), np.array([0.0, 0, 1, 1])
    assert np.allclose(X.logistic(x, y, 3.0), X.logistic(np.r_[x, x[:2], x[:2]], np.r_[y, y[:2], y[:2]]))


def test_toxicity_matches_letter_runs():
    scorer = X.Scorer(X.Model([("scumlord", True), ("vile", False)], [1.0, 1.0]))
    for text in ("l'scumlord", "you/scumlord", "such-scumlord.", "scumlord", "sc4mlord"):
        assert [h[0] for h in scorer.found("x " + text)] == [1], text
    assert len(scorer.found("vile/scumlord")) == 2 and not scorer.found("a kind day")


def lm_truth(docs, training):
    c = Counter()
    split = {k: [*S.tokens(t), S.END] for k, t in docs}
    for _, t in training:
        c.update([*S.tokens(t), S.END])
    n, v = sum(c.values()), len(c)
    return {k: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in split.items()}


def test_lm_base_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAD", 5)  # most tokens are joined
    docs = [(i, " ".join(f"{'ABC'[j % 3]}w{(i * j) % 17}" for j in range(i))) for i in range(40)] + [(40, None), (41, ""), (42, " É x NEW words"), (43, "tok " * 30000), (44, "x" * 60000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, word int, score int")
    got = {r.doc_id: r for r in S.score(df, df.where("doc_id < 30")).collect()}
    for k, (n, known, total, base) in lm_truth(docs, docs[:30]).items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert S.score(df.limit(0), df).collect() == []
    blind = {r.doc_id: r for r in S.score(df, df.where("false")).collect()}
    assert blind[41].n_known == 0 and blind[41].train_tokens == 0 and blind[41].base_score == 0.0


def test_lm_distributions_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "some words come again and some go " * (1 + i % 3)) for i in range(30)], "doc_id long, t string")
    counts = S.counts_of(docs).where("gram is not null").select("gram", "n")
    tree = S.grow(counts, bits=5.0)
    p = 10.0**tree.logp
    unseen = 256 - (p.shape[1] - 1)
    assert len(p) > 5 and np.allclose(p[:, 1:].sum(1) + unseen * p[:, 0], 1, atol=1e-9)
    tokens, _ = S.grow_tokens(counts, bits=5.0)
    assert np.allclose((10.0 ** tokens.logp.astype(float)).sum(1), 1, atol=1e-4)


@needs_tables
def test_lm_beats_its_base_on_held_out_text(spark):
    rows = [r for r in S.op8_suffix_tree_lm(spark, SF.replace("0.01", "0.1")).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_keeps_every_context_that_passes(spark):
    # over 16000 four-byte contexts that each foretell the next byte; their suffixes are under 5300
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(20_000)]
    words = list({w[:4]: w for w in words}.values())
    docs = spark.createDataFrame([(i, " ".join(words[i::20] * 60)) for i in range(20)], "doc_id long, t string")
    tree = S.grow(S.counts_of(docs))
    assert len(words) > 16000 and len(tree.logp) > 16000


def test_lm_tables_equal_the_tree_in_memory(spark):
    texts = ["some words come again and some go " * (1 + i % 3) + f"end{i}" for i in range(30)] + ["unseen wördsé go", "", "so"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    flags = docs.select("t", (docs.doc_id < 30).alias("trained"), (docs.doc_id >= 0).alias("scored"))
    grams = S.gram_counts(S.unit_counts(flags))
    tree = S.grow(grams, bits=5.0)
    lp = {r.gram: r.lp for r in S.gram_scores(grams, bits=5.0).collect()}
    for t in texts:
        b = S.spelled(S.tokens(t))
        want = tree.score([b])[S.DEPTH :]
        assert np.allclose([lp[int.from_bytes(b[i - S.DEPTH : i + 1], "big")] for i in range(S.DEPTH, len(b))], want, atol=1e-9)


def plain_tree(seqs, keys, base, bits, depth):
    """log10 of each key after each place, by counting every context of the ladder of lengths one text at a time."""
    tree, now = [], [[base[k] for k in ks] for _, ks in seqs]
    while True:
        met = {}
        for (weight, ks), ps in zip(seqs, now, strict=True):
            for i in range(depth, len(ks) + 1):  # key i - 1 follows i symbols, the start sign among them
                c = met.setdefault(tuple(["<s>", *ks][i - depth : i]) if i - depth >= 0 else None, {})
                c.setdefault(ks[i - 1], [0, ps[i - 1]])[0] += weight
        kept = {}
        for ctx, c in met.items():
            total, kinds, single = sum(n for n, _ in c.values()), sum(n > 0 for n, _ in c.values()), sum(n == 1 for n, _ in c.values())
            if total >= S.OFTEN and any(n > 1 for n, _ in c.values()):
                e, of = kinds + single, total + kinds
                saved = single and single * math.log2((e - 2) / (of - 2))
                for n, p in c.values():
                    if n > 1:
                        saved += n * (math.log2((e + 1) / (of - 1)) if n == 2 else math.log2((n - 1 + e * 10**p) / (of - 1)) - p * math.log2(10))
                if saved >= bits:
                    kept[ctx] = (c, e, of)
        for (_, ks), ps in zip(seqs, now, strict=True):
            for i in range(depth, len(ks) + 1):
                if (k := kept.get(tuple(["<s>", *ks][i - depth : i]))) is not None:
                    n = k[0][ks[i - 1]][0]
                    ps[i - 1] = math.log10(((n if n > 1 else 0) + k[1] * 10 ** ps[i - 1]) / k[2])
        tree.append((depth, len(kept)))
        if depth > max(len(ks) for _, ks in seqs):
            return tree, now
        depth = S.after(depth)


def test_lm_contexts_are_as_long_as_the_counts_say(spark):
    # the first words of a line tell its last, over eleven equal ones: no shorter context does
    rng = np.random.default_rng(8)
    line = " ".join(f"passage{i}" for i in range(11))
    docs = [(i, f"{'left' if i % 2 else 'right'} {line} {'sinister' if i % 2 else 'dexterous'} " + " ".join(f"w{x}" for x in rng.integers(0, 30, 12))) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, t string")
    flags = df.select("t", (df.doc_id < 200).alias("trained"), (df.doc_id >= 0).alias("scored"))
    units = S.unit_counts(flags, alone=True).select("unit", "n").withColumn("uid", S.F.monotonically_increasing_id())
    words, _ = S.word_scores(S.written(units, "units"))
    base = {r.key: r.lp for r in words.collect()}
    split = [[*S.tokens(t), S.END] for _, t in docs]
    key = {w: int(S.hashed_tokens(w)[1].view(np.int64)[0]) if w != S.END else int(S.LAST.view(np.int64)) for ws in split for w in ws}
    tree, want = plain_tree([(int(i < 200), [key[w] for w in ws]) for i, ws in enumerate(split)], key, base, S.BITS, 1)
    assert dict(tree)[12] > 0
    got = {r.doc_id: r for r in S.score(df, df.doc_id < 200, text="t").collect()}
    for i, ps in enumerate(want):
        assert abs(got[i].score - sum(ps)) < 1e-6
    other = docs[239][1].replace("sinister", "dexterous")
    swapped = S.score(spark.createDataFrame([(1, docs[239][1]), (2, other)], "doc_id long, t string"), df.where("doc_id < 200"), text="t")
    right, wrong = (r.score for r in swapped.orderBy("doc_id").collect())
    assert right > wrong + 1


def test_lm_spelling_contexts_pass_the_packed_bytes(spark):
    # the first letter of a token tells its last, over eleven equal bytes
    words = [f"{'xy'[i % 2]}abcdefghijk{'uv'[i % 2]}{i}" for i in range(400)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, t string")
    new = spark.createDataFrame([(1, "xabcdefghijku900"), (2, "xabcdefghijkv900")], "doc_id long, t string")
    right, wrong = (r.score for r in S.score(new, df, text="t").orderBy("doc_id").collect())
    assert right > wrong + 1


def test_lm_scores_are_kept_for_what_a_context_met_twice(spark, monkeypatch):
    # 1500 words follow `common` once each: one row stands for all of them, and they still get its rest
    rng = np.random.default_rng(9)
    ends = [" ".join(f"w{x}" for x in rng.integers(0, 5, 6)) for _ in range(2100)]
    docs = [(i, f"common {'again' if i < 600 else f'u{i}'} {end}") for i, end in enumerate(ends)]
    sizes, written = [], S.written

    def counted(df, name):
        out = written(df, name)
        sizes.extend([out.count()] if name == "token-scores" else [])
        return out

    monkeypatch.setattr(S, "written", counted)
    df = spark.createDataFrame(docs, "doc_id long, t string")
    new = spark.createDataFrame([(1, "common again"), (2, "common u700"), (3, "w1 again"), (4, "w1 u700")], "doc_id long, t string")
    a, b, c, d = (r.score for r in S.score(new, df, text="t").orderBy("doc_id").collect())
    assert sizes and max(sizes) < 500
    assert a - c > b - d > 0


def test_lm_texts_are_read_seven_times_however_long_the_contexts(spark):
    # a passage of 70 tokens; before, there was a pass for each length up to 8, and copies of the texts beyond
    line = " ".join(f"passage{i}" for i in range(70))
    docs = [(i, f"{'left' if i % 2 else 'right'} {line} {'sinister' if i % 2 else 'dexterous'}") for i in range(200)]
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(docs, "doc_id long, t string").mapInArrow(told, "doc_id long, t string")
    right = {r.doc_id: r.score for r in S.score(df, S.F.lit(True), text="t").collect()}
    assert len(right) == 200 and read.value <= 7 * 200


def lm_entries(kinds, kind):
    return sum(len(S.unboxed([S.pa.scalar(r.box)])["key"]) for r in kinds.where(f"kind = {kind}").collect())


def test_lm_false_keys_score_as_their_suffix(spark, monkeypatch):
    # every bit map is full, so all that is looked up seems to be in the tree: no score may change
    rng = np.random.default_rng(4)
    docs = [(i, "common " + " ".join(f"w{x}" for x in rng.integers(0, 12, 20)) + (" so it ends" if i % 3 else f" but not{i} here")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, t string")
    scores, written = [], S.written

    def counted(df, name):
        out = written(df, name)
        scores.extend([lm_entries(out, S.SCORES)] if name == "token-scores" else [])
        return out

    monkeypatch.setattr(S, "written", counted)
    want = {r.doc_id: r.score for r in S.score(df, df.doc_id < 300, text="t").collect()}
    assert 0 < max(scores) < 500
    of = S.Sieve.of.__func__

    def full(cls, *args):
        s = of(cls, *args)
        return cls(~np.zeros_like(s.words))

    monkeypatch.setattr(S.Sieve, "of", classmethod(full))
    got = {r.doc_id: r.score for r in S.score(df, df.doc_id < 300, text="t").collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_lm_packed_letters_equal_the_tables(spark):
    texts = ["some words come again and some go " * (1 + i % 3) + f"end{i} longertokens{i % 4} x" for i in range(30)] + ["unseen wördsé go", "", "so"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    flags = docs.select("t", (docs.doc_id < 30).alias("trained"), (docs.doc_id >= 0).alias("scored"))
    units = S.unit_counts(flags, alone=True).select("unit", (S.F.col("n") > 0).cast("long").alias("n"))
    want = {int(S.mixed(np.array([r.gram]).view(np.uint64))[0]): r.lp for r in S.gram_scores(S.gram_counts(units), bits=5.0).collect() if r.gram < S.TOKEN}
    grams = S.written(S.byte_grams(S.vocabulary(flags, 58)), "grams")
    got = S.unboxed([S.pa.scalar(r.box) for r in S.byte_scores(grams, 58, 5.0).collect()])
    assert sorted(got["key"].tolist()) == sorted(want) and all(abs(want[k] - lp) < 1e-9 for k, lp in zip(got["key"].tolist(), got["lp"].tolist()))


def test_lm_boxes_cost_little():
    # tasks exchange a box for each two ranges, so a box of few entries may not cost a hundred microseconds
    part = np.repeat(np.arange(20_000, dtype=np.int32), 2)
    columns = {"key": np.arange(40_000, dtype=np.uint64), "n": np.ones(40_000, np.int32), "word": S.pa.array([b"a" * (i % 3) for i in range(40_000)], S.pa.binary())}
    took = []
    for _ in range(3):
        start = time.process_time()
        boxes = S.packs(columns, part)
        got = S.unboxed(boxes.column(1))
        took.append(time.process_time() - start)
    assert boxes.num_rows == 20_000 and boxes.column(0).to_pylist() == list(range(20_000))
    assert all((got[c] == columns[c]).all() for c in ("key", "n")) and got["word"].equals(columns["word"])
    some = S.unboxed(S.pa.chunked_array([boxes.column(1)[3:5], S.pa.array([None], S.pa.binary()), boxes.column(1)[:0]]))
    assert some["key"].tolist() == [6, 7, 8, 9] and some["word"].to_pylist() == [b"", b"a", b"aa", b""]
    assert not len(S.unboxed(boxes.column(1)[:0])["key"]) and min(took) < 1.0


def test_lm_sums_of_a_large_group(monkeypatch):
    monkeypatch.setattr(S, "RANGE", 1000)
    rng = np.random.default_rng(5)
    ctx, up, n = S.mixed(rng.integers(0, 9, 5300).astype(np.uint64)), S.mixed(rng.integers(0, 90, 5300).astype(np.uint64)), rng.integers(1, 400, 5300)
    boxes = S.packs({"ctx": ctx, "up": up, "n": n}, np.arange(5300, dtype=np.int32) // 130).column(1)
    want = S.summed(ctx, up, n)
    for got in (S.summed_boxes(boxes), S.summed_boxes(S.packs({"ctx": ctx, "up": up, "n": n}, np.zeros(5300, np.int32)).column(1))):
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in want))) and (got[0][1:] >= got[0][:-1]).all()


def test_lm_boxes_grow_with_the_places_of_a_length(spark, monkeypatch):
    # with many ranges, long contexts of few places made as many boxes as short ones: a box for each two ranges
    monkeypatch.setattr(S, "RANGE", 1 << 6)
    rng = np.random.default_rng(6)
    line = " ".join(f"passage{i}" for i in range(14))
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 30)) + (f" {'left' if i % 2 else 'right'} {line} {'sinister' if i % 2 else 'dexterous'}" if i < 200 else "")) for i in range(1500)]
    rows, written = [], S.written

    def counted(df, name):
        out = written(df, name)
        rows.extend([out.count()] if name == "token-met" else [])
        return out

    monkeypatch.setattr(S, "written", counted)
    df = spark.createDataFrame(docs, "doc_id long, t string")
    assert S.score(df, S.F.lit(True), text="t").count() == 1500
    assert len(rows) > 6 and min(rows) * 4 < rows[0]


def test_lm_shuffles_go_with_their_step(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with S.small_batches(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_lm_token_hashes():
    rng = np.random.default_rng(7)
    for text in ["", " ", "\n\t", "A", " b ", "é ü\x0bÄ\x0c" + "x" * 64 + " " + "X" * 65 + " " + "x" * 200 + "\r" + "y" * 200, *("".join(rng.choice(list("aB \n\x1cé"), 300)) for _ in range(20))]:
        begins, keys, ends = S.hashed_tokens(text.encode())
        found = [text.encode()[a:b].lower() for a, b in zip(begins, ends, strict=True)]
        assert found == S.tokens(text) and len(set(keys.tolist())) == len(set(found))
        assert all(S.hashed_tokens(b"before " + w + b" after")[1][1] == k for w, k in zip(found, keys, strict=True))
