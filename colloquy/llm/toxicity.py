"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: stems and whole words that are far likelier in toxic
documents. A product of the lexicon trie and Levenshtein automata, made deterministic state by state
as words arrive, finds exact and misspelled terms in one pass over a word. Each hit is weighed by its
edit distance and by the words around it: quotation marks and verbs of report lower it, other hits
nearby raise it. A logistic curve turns a document's sum into a probability.

Only text is an input of a score. Null or empty text has no words and gets the score of no hits.
Repeated rows and repeated or null keys stay as they are; other columns are dropped, so their names
cannot clash; an empty table, or one without labels of both classes, gives the score of no hits: 0.0
if no label is known. Scoring shuffles nothing and reads whole texts.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import chunks, table

#: Bounds of the labelled sample that the classifier is fitted on: rows of each label, by hash order.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 9000
#: Stems are prefixes of so many letters; a lexicon has so many terms at most.
STEM_MIN, STEM_MAX, TERMS = 4, 12, 512
#: A term's share of toxic documents among those that hold it, and its support among the toxic ones.
PURITY, SUPPORT = 0.8, 0.006
#: Least log-odds against chance, and terms of a document that count for it when the lexicon is chosen.
CHANCE, COVER = 14.0, 3
WINDOW = 8
QUOTES = frozenset("\"'“”„«»‘’‹›`")
REPORT = frozenset("said says say called calls quote quoted quotes quoting wrote writes term word words phrase insult slur dit écrit mot citation sagte sagt schrieb wort zitat dijo dice escribió palabra cita".split())
#: Letter runs: what the lexicon is learned of and matched with.
LETTERS = re.compile(r"[^\W\d_]{3,}")
TRIM = string.punctuation + string.whitespace + "“”„«»‘’‹›…–—·¡¿€§°"
#: Words and automaton states that one worker remembers, and terms that it counts, before it starts afresh;
#: they bound its memory, never its results.
REMEMBERED, STATES, COUNTED = 200_000, 50_000, 100_000


def edits(n: int) -> int:
    """Misspellings allowed in a term of n letters."""
    return 0 if n < 4 else 1 if n < 9 else 2


class Automaton:
    """Levenshtein automata of all terms over their trie, determinised as words need it.

    A state is a set of pairs, trie node and edits so far, packed in a few bytes. A stem accepts as soon
    as it is spelled, whatever follows; a whole word accepts at the word's end.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.stem: list[int | None] = [None]
        self.word: list[int | None] = [None]
        self.budget = [0]
        for k, (term, stem) in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.stem.append(None)
                    self.word.append(None)
                    self.budget.append(0)
                at = self.next[at][c]
                self.budget[at] = max(self.budget[at], edits(len(term)))
            (self.stem if stem else self.word)[at] = k
        self.budget[0] = max([0, *(edits(len(t)) for t, _ in terms)])
        self.sizes = [edits(len(t)) for t, _ in terms]
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []
        self.moves: list[dict[str, int]] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.early: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # a letter of the term may be missing from the word
            node, e = todo.pop()
            if e > self.budget[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        key = array("I", sorted(4 * node + e for node, e in best.items())).tobytes()
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            for into, of in ((self.at_end, self.word), (self.early, self.stem)):
                into.append(min(((e, of[n]) for n, e in best.items() if of[n] is not None and e <= self.sizes[of[n]]), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, e in (divmod(x, 4) for x in array("I", self.sets[state])):
            if c in self.next[node]:
                pairs.add((self.next[node][c], e))
            pairs.add((node, e + 1))
            pairs.update((child, e + 1) for child in self.next[node].values())
        out = self.moves[state][c] = self._state(pairs)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        state, best = self.start, None
        for c in word:
            move = self.moves[state].get(c)
            state = self._step(state, c) if move is None else move
            if (hit := self.early[state]) and (best is None or hit < best):
                best = hit
            if not self.sets[state]:
                return best
        return min(x for x in (best, self.at_end[state]) if x) if best or self.at_end[state] else None


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    #: Words near a term that clean documents use.
    spared: frozenset = frozenset()
    bias: float = -50.0
    slope: float = 0.0


class Scorer:
    """Finds hits in texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms)
        self.seen: set[str] = set()
        self.hits: dict[str, list[tuple[float, str]]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.automaton.sets) > STATES:
            self.automaton = Automaton(self.model.terms)
        for raw in words:
            # letter runs, of which the lexicon is learned; if none is a hit, all of it, in which other signs are edits
            if found := self._matched(LETTERS.findall(raw)) or self._matched([raw.strip(TRIM)]):
                self.hits[raw] = found
        self.seen |= words

    def _matched(self, words: list[str]) -> list[tuple[float, str]]:
        return [(self.model.weights[m[1]] * 0.6 ** m[0], w) for w in words if len(w) >= 3 and w not in self.model.spared and (m := self.automaton.match(w))]

    def found(self, text: str | None) -> list[tuple[int, float, str]]:
        """(position, weight after context, word) of each hit."""
        words = (text or "").lower().split()
        distinct = set(words)
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits = set(), {}
        self.learn(distinct - self.seen)
        if not (mine := distinct & self.hits.keys()):
            return []
        at = [i for i, w in enumerate(words) if w in mine]
        out = []
        for k, i in enumerate(at):
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            quoted = words[i][0] in QUOTES and words[i].rstrip(".,;:!?)")[-1:] in QUOTES or self._between(words, i)
            reported = sum(w.strip(TRIM) in REPORT for w in near)
            others = sum(0 < abs(j - i) <= WINDOW for j in at[max(0, k - WINDOW) : k + WINDOW + 1])
            factor = (0.3 if quoted else 1.0) * (0.6 if reported else 1.0) * (1 + 0.25 * min(others, 4))
            out += [(i, weight * factor, word) for weight, word in self.hits[words[i]]]
        return out

    @staticmethod
    def _between(words: list[str], i: int) -> bool:
        """A quotation opens before the word and closes after it, within the window."""
        opens = any(w[0] in QUOTES and w[-1] not in QUOTES for w in words[max(0, i - WINDOW) : i + 1])
        return opens and any(w.rstrip(".,;:!?)")[-1:] in QUOTES for w in words[i : i + 1 + WINDOW])

    def mass(self, text: str | None) -> float:
        return math.log1p(sum(w for _, w, _ in self.found(text)))

    def score(self, text: str | None) -> float:
        z = self.model.bias + self.model.slope * self.mass(text)
        return 1 / (1 + math.exp(-z)) if z > -50 else 0.0


def terms_of(text: str | None) -> set[str]:
    """The prefixes and, marked by a final blank, whole words of a text."""
    words = set(LETTERS.findall((text or "").lower()))
    return {w[:k] for w in words for k in range(STEM_MIN, min(len(w), STEM_MAX) + 1)} | {w + " " for w in words}


def choose(counts: dict[str, tuple[int, int]], holders: list[set[str]], clean: int, weight: float = 1.0) -> list[tuple[str, bool, float]]:
    """The lexicon (term, is stem, weight) from candidates' (toxic, clean) document counts; a clean one counts `weight`.

    Candidates must be pure and unlikely by chance. They are taken greedily, as long as enough toxic
    documents gain by them: a document gains from its first COVER terms. So what copies of a toxic
    document share besides its terms isn't learned.
    """
    toxic = len(holders)
    least, base = max(4, SUPPORT * toxic), toxic / (toxic + weight * clean)
    pure = {t: a / (a + b) for t, (a, b) in ((t, (a, weight * b)) for t, (a, b) in counts.items()) if a >= least and a / (a + b) >= PURITY and a * math.log(1 / base) - b * 2 >= CHANCE}
    of: dict[str, set[int]] = {}
    for i, held in enumerate(holders):
        for t in held & pure.keys():
            of.setdefault(t, set()).add(i)
    left, covered, chosen = set(of), [0] * toxic, []
    gains = {t: len(of[t]) for t in left}
    while left and len(chosen) < TERMS:
        t = max(left, key=lambda t: (gains[t], pure[t], -len(t), t))
        if gains[t] < least:
            break
        left.discard(t)
        fresh = sum(covered[i] < COVER for i in of[t])
        if fresh < gains[t]:  # others have covered some since: look again
            gains[t] = fresh
            left.add(t)
            continue
        stem = t
        while longer := [x for x in of if len(x) == len(stem) + 1 and x.startswith(stem) and x[-1] != " " and len(of[x]) >= 0.9 * len(of[stem])]:
            stem = max(longer, key=lambda x: (len(of[x]), x))
        whole = t[-1] == " " or len(of.get(stem + " ", ())) >= 0.9 * len(of[stem])
        chosen.append((stem.rstrip(), not whole, pure[t]))
        for i in of[t]:
            covered[i] += 1
        left = {x for x in left if not x.startswith(stem.rstrip()) and not stem.startswith(x.rstrip())}
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[float, float]:
    """Newton's method with a small ridge; a row of class 0 counts `weight`."""
    a = np.stack([np.ones_like(x), x], 1)
    w, n = np.zeros(2), np.where(y == 1, 1.0, weight)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (n * (p - y)) + 1e-2 * w)
        w = w - np.clip(step, -5, 5)
    return float(w[0]), float(max(0.0, w[1]))


def fit(sample: DataFrame, weight: float = 1.0) -> Model:
    """A model from the bounded sample's (text, toxic) rows: its term counts, then weights and curve.

    A clean row counts `weight`, so that the classes have their shares of all labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: Counter, b: Counter) -> pa.RecordBatch:
            keys = list(a.keys() | b.keys())
            return pa.record_batch([pa.array(keys, pa.string()), pa.array([a[k] for k in keys], pa.int64()), pa.array([b[k] for k in keys], pa.int64())], ["term", "a", "b"])

        counts = Counter[str](), Counter[str]()
        for batch in batches:
            for part in chunks(batch, 0):
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[0 if toxic else 1].update(terms_of(text))
                    if len(counts[0]) + len(counts[1]) > COUNTED:
                        yield rows(*counts)
                        counts = Counter[str](), Counter[str]()
        yield rows(*counts)

    sample = sample.where("text is not null").select("text", "toxic").repartition(12).persist()  # recomputed if an executor is lost
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        sample.unpersist()
        return Model()
    least = max(4, SUPPORT * toxic)

    counted = sample.mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pure = counted.where((F.col("a") >= least) & (F.col("a") >= PURITY * (F.col("a") + weight * F.col("b")))).collect()  # a small part of a bounded sample
    counts = {r.term: (r.a, r.b) for r in pure}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([sorted(terms_of(t) & counts.keys()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["held"])

    holders = [set(r.held) for r in sample.where("toxic = 1").select("text").mapInArrow(holding, "held array<string>").collect()]
    chosen = choose(counts, holders, clean, weight)
    model = Model([(t, s) for t, s, _ in chosen], [w for _, _, w in chosen])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.found(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([math.log1p(sum(w for _, w, _ in f)) for f in found]), pa.array([sorted({w for _, _, w in f}) for f in found], pa.list_(pa.string()))], ["toxic", "mass", "words"])

    def measured() -> DataFrame:
        return sample.mapInArrow(features, "toxic int, mass double, words array<string>")

    words: dict[str, list[int]] = {}
    for r in measured().select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("n > a").collect():
        words[r.w] = [r.a, r.n]
    model.spared = frozenset(w for w, (a, n) in words.items() if a < 0.6 * (a + weight * (n - a)))
    x = np.array([(r.mass, r.toxic) for r in measured().select("mass", "toxic").collect()])
    model.bias, model.slope = logistic(x[:, 0], x[:, 1], weight)
    sample.unpersist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_hits) of every row of `docs`."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by TERMS and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, sent.value)
        for part in (p for b in batches for p in chunks(b, 1)):
            found = [scorer.found(t) for t in part.column(1).to_pylist()]
            z = scorer.model.bias + scorer.model.slope * np.array([math.log1p(sum(w for _, w, _ in f)) for f in found])
            yield pa.record_batch([part.column(0), pa.array(np.where(z > -50, 1 / (1 + np.exp(-np.maximum(z, -50))), 0.0)), pa.array([len(f) for f in found], pa.int64())], ["k", "score", "n_hits"])

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def clean_rows(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `least`, with all their columns, whatever their names."""
    sent, name, at = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, sent.value)
        for part in (p for b in batches for p in chunks(b, at)):
            yield part.filter(pa.array([scorer.score(t) < least for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_scorers: dict = {}


def scorer_of(key: str, model: Model) -> Scorer:
    """The worker's scorer for a model: what it has met serves its later tasks too."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that are not held out."""
    known = labels.where(~held_out()).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    weight = clean / min(clean, SAMPLE_CLEAN) / (toxic / min(toxic, SAMPLE_TOXIC)) if toxic and clean else 1.0
    return fit(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), weight)  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
