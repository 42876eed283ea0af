"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows.
It reads a segment's bytes in both directions and labels every position with language probabilities;
a document's score pools the log-probabilities of all its positions. A segment is a run of characters
that aren't white space, with the space around it: all bytes of a text but its white space are read, and
a position's label depends on its segment alone, so a worker labels each distinct segment once, whatever
its count, and whole texts are cheap. The state thus doesn't pass from one segment to the next; reading
on through white space would cost the network's whole work on every byte of every text. A run of over
SEGMENT bytes is read in pieces that overlap by half.

Only text is an input of a prediction. Null texts and texts without a letter give `und` and score 0.
A letter is what str.isalpha says. Ties go to the first label in sorted order. Repeated rows and repeated or null keys stay as they are; other columns are dropped, so their names
cannot clash. If no row has a label, every text gives `und`. Predicting shuffles nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import table

UNKNOWN = "und"
#: Bound of the sample that the network is fitted on: rows of each label, by the order of their texts' hashes,
#: with their whole texts.
SAMPLE_PER_LABEL = 150
HIDDEN, EMBEDDED, SEGMENT = 12, 8, 48
#: Passes over the sample, steps at least, segments of a step, rate.
EPOCHS, STEPS, BATCH, RATE = 3, 300, 256, 0.01
#: Words that one worker remembers before it starts afresh; bounds its memory, never its results.
REMEMBERED = 800_000
SPLIT = re.compile(r"\S+")
MAYBE = re.compile(r"[^\W\d_]")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def segments(word: str) -> list[bytes]:
    raw = b" " + word.encode() + b" "
    half = SEGMENT // 2
    return [raw] if len(raw) <= SEGMENT else [raw[i : i + SEGMENT] for i in range(0, len(raw) - half, half)]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE.finditer(text))


def packed(segs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, mask), one row a segment."""
    width = max(map(len, segs))
    x = np.zeros((len(segs), width), np.uint8)
    mask = np.zeros((len(segs), width), np.float32)
    for i, s in enumerate(segs):
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
        mask[i, : len(s)] = 1
    return x, mask


class GRU:
    """One direction. Weights: input table per byte (embedding times input matrix), recurrent matrices, biases."""

    def __init__(self, rng: np.random.Generator):
        h, e = HIDDEN, EMBEDDED
        self.p = {
            "E": rng.normal(0, 0.3, (256, e)).astype(np.float32),
            "W": rng.normal(0, 1 / np.sqrt(e), (e, 3 * h)).astype(np.float32),
            "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32),
            "b": np.zeros(3 * h, np.float32),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        p, h = self.p, HIDDEN
        table = p["E"] @ p["W"] + p["b"]
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((x.shape[1], len(x), h), np.float32)
        tape = []
        for t in range(x.shape[1]):
            a = table[x[:, t]]
            u = state @ p["U"][:, : 2 * h]
            zr = sigmoid(a[:, : 2 * h] + u)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            n = np.tanh(a[:, 2 * h :] + rs @ p["U"][:, 2 * h :])
            m = mask[:, t, None]
            new = m * ((1 - z) * state + z * n) + (1 - m) * state
            if keep:
                tape.append((state, z, r, n, rs, m))
            out[t] = state = new
        return out, tape

    def read(self, x: np.ndarray) -> np.ndarray:
        """The states at every position of segments of one length, without a tape."""
        p, h = self.p, HIDDEN
        table = p["E"] @ p["W"] + p["b"]
        table[:, : 2 * h] *= 0.5
        Uzr, Un = p["U"][:, : 2 * h] * np.float32(0.5), np.ascontiguousarray(p["U"][:, 2 * h :])
        a = table[x.T]
        out = np.empty((x.shape[1], len(x), h), np.float32)
        state = np.zeros((len(x), h), np.float32)
        for t in range(x.shape[1]):
            zr = state @ Uzr
            zr += a[t, :, : 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n = (zr[:, h:] * state) @ Un
            n += a[t, :, 2 * h :]
            np.tanh(n, out=n)
            n -= state
            n *= zr[:, :h]
            state = np.add(state, n, out=out[t])
        return out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Through time: grad holds the loss's gradient at every position's state."""
        p, h = self.p, HIDDEN
        dU = np.zeros_like(p["U"])
        dtable = np.zeros((256, 3 * h), np.float32)
        ds = np.zeros_like(grad[0])
        for t in range(x.shape[1] - 1, -1, -1):
            state, z, r, n, rs, m = tape[t]
            dnew = ds + grad[t]
            dm = dnew * m
            dz, dn = dm * (n - state), dm * z
            ds = dnew * (1 - m) + dm * (1 - z)
            dan = dn * (1 - n * n)
            drs = dan @ p["U"][:, 2 * h :].T
            daz, dar = dz * z * (1 - z), drs * state * r * (1 - r)
            dzr = np.concatenate([daz, dar], 1)
            ds += drs * r + dzr @ p["U"][:, : 2 * h].T
            dU[:, : 2 * h] += state.T @ dzr
            dU[:, 2 * h :] += rs.T @ dan
            np.add.at(dtable, x[:, t], np.concatenate([dzr, dan], 1))
        return {"E": dtable @ p["W"].T, "W": p["E"].T @ dtable, "U": dU, "b": dtable.sum(0)}


@dataclass
class Network:
    labels: list[str]
    prior: np.ndarray
    left: GRU
    right: GRU
    V: np.ndarray
    c: np.ndarray

    @staticmethod
    def new(labels: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(labels, np.zeros(len(labels)), GRU(rng), GRU(rng), rng.normal(0, 0.1, (2 * HIDDEN, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, tape_a = self.left.forward(x, mask, keep)
        b, tape_b = self.right.forward(x[:, ::-1], mask[:, ::-1], keep)
        return np.concatenate([a, b[::-1]], 2), tape_a, tape_b

    def log_probs(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """[position, segment, label]."""
        y = self.states(x, mask)[0] @ self.V + self.c
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def label_positions(self, text: str) -> list[tuple[str, np.ndarray]]:
        """(segment, probabilities of each of its bytes) in text order."""
        segs = [s for w in SPLIT.findall(text.lower()) for s in segments(w)]
        if not segs:
            return []
        p = np.exp(self.log_probs(*packed(segs)))
        return [(s.decode(errors="replace"), p[: len(s), i]) for i, s in enumerate(segs)]

    def pooled(self, segs: list[bytes]) -> np.ndarray:
        """Sum of log-probabilities over each segment's positions, divided by their number's root."""
        out = np.empty((len(segs), len(self.labels)))
        sizes = np.array([len(s) for s in segs])
        for size in np.unique(sizes):  # equal lengths need no mask
            same = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join([segs[i] for i in same]), np.uint8).reshape(-1, size)
            for k in range(0, len(same), 2048):
                y = np.concatenate([self.left.read(x[k : k + 2048]), self.right.read(x[k : k + 2048, ::-1])[::-1]], 2).reshape(-1, 2 * HIDDEN) @ self.V + self.c
                y -= y.max(1, keepdims=True)
                y -= np.log(np.exp(y).sum(1, keepdims=True))
                out[same[k : k + 2048]] = y.reshape(size, -1, len(self.labels)).sum(0) / np.sqrt(size)
        return out

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross-entropy summed over all positions."""
        s, tape_a, tape_b = self.states(x, mask, True)
        logits = s @ self.V + self.c
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p -= y[None]
        p *= (mask * (weight / mask.sum(1) / weight.sum())[:, None]).T[:, :, None]
        ds = p @ self.V.T
        h = HIDDEN
        flat = s.reshape(-1, 2 * h)
        g = {"V": flat.T @ p.reshape(-1, p.shape[2]), "c": p.sum((0, 1))}
        g |= {"l" + k: v for k, v in self.left.backward(x, tape_a, ds[:, :, :h]).items()}
        g |= {"r" + k: v for k, v in self.right.backward(x[:, ::-1], tape_b, ds[::-1, :, h:]).items()}
        return g

    def weights(self) -> dict[str, np.ndarray]:
        return {"V": self.V, "c": self.c} | {"l" + k: v for k, v in self.left.p.items()} | {"r" + k: v for k, v in self.right.p.items()}


def learn(words: Counter, labels: list[str]) -> Network:
    """Train on (word, label) counts: each distinct segment once an epoch, with its labels' shares."""
    net = Network.new(labels)
    at = {k: i for i, k in enumerate(labels)}
    shares: dict[bytes, np.ndarray] = {}
    for (word, label), n in sorted(words.items()):
        for s in segments(word):
            shares.setdefault(s, np.zeros(len(labels)))[at[label]] += n
    total = np.maximum(sum(shares.values()), 1)
    segs = sorted(shares)
    y = np.array([shares[s] for s in segs]) / total  # labels weigh alike, however many their rows
    weight = np.sqrt(y.sum(1))
    y = (y / y.sum(1, keepdims=True)).astype(np.float32)
    rng, m, v, t = np.random.default_rng(11), {}, {}, 0
    sizes = np.array([len(s) for s in segs])
    a_pass = len(segs) // BATCH + 1
    epochs = max(EPOCHS, -(-STEPS // a_pass))
    steps = epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(segs))
        order = order[np.argsort(sizes[order] // 4, kind="stable")]
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            b = batches[k]
            g = net.step(*packed([segs[i] for i in b]), y[b], weight[b].astype(np.float32))
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for name, w in net.weights().items():
                d = np.clip(g[name], -1, 1)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                w -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    def __init__(self, net: Network):
        self.net, self.at = net, {}
        self.table = np.empty((0, len(net.labels)))

    def learn(self, words: list[str]) -> None:
        segs = [segments(w) for w in words]
        flat = self.net.pooled([s for ss in segs for s in ss])
        ends = np.cumsum([len(ss) for ss in segs])
        rows = np.add.reduceat(flat, np.concatenate([[0], ends[:-1]]), axis=0)
        self.at.update((w, len(self.table) + i) for i, w in enumerate(words))
        self.table = np.concatenate([self.table, rows])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.net.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [SPLIT.findall(t.lower()) if t and has_letter(t) else [] for t in texts]
        if len(self.at) > REMEMBERED:
            self.at, self.table = {}, self.table[:0]
        if new := [w for w in set().union(*words) if w not in self.at]:
            self.learn(new)
        out = []
        for ws in words:
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            s = self.table[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            k = int(p.argmax())  # ties: the first label in sorted order
            out.append((self.net.labels[k], float(p[k])))
        return out


def train(labelled: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Network:
    """A network from (text, lang) rows with a non-null lang; every lang is learned."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    # of each lang, first the texts in the lowest part of the hashes, four times what is wanted: few rows meet. Texts are
    # counted, not rows, as a lang may consist of copies; all of a lang's texts meet where it has few
    part, counts = F.pmod("h", F.lit(1 << 40)), rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("count"))
    low = rows.select("lang", "h").join(counts, "lang").where(part.cast("double") * F.col("count") < 4.0 * per_label * (1 << 40))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(part, "h"))
    some = low.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_label).select("lang", "h")
    texts = rows.join(F.broadcast(some), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("t"))  # per_label rows of each lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in SPLIT.findall(t.lower()))
            yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "w", "n"])

    found = texts.select("lang", "t").mapInArrow(run, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).toArrow()
    words = Counter(dict(zip(zip(found["w"].to_pylist(), found["lang"].to_pylist(), strict=True), found["n"].to_pylist(), strict=True)))
    langs = sorted({lang for _, lang in words})
    return learn(words, langs) if langs else Network.new([])


_predictors: dict = {}


def predictor_of(name: str, net: Network) -> Predictor:
    """The worker's predictor for a network: the words it has met serve its later tasks too."""
    if name not in _predictors:
        _predictors.clear()
        _predictors[name] = Predictor(net)
    return _predictors[name]


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row of `docs`."""
    sent, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex  # a few hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = predictor_of(name, sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = model.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["k", "lang_pred", "score"])

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
