"""Token counts by a two-tier lookup on the map side: no pre-token is shuffled.

A text's tokens are those of its pre-tokens, each alone: the vocabulary's split pattern matches no white
space, its special strings hold none, and its normal form and lower case are made letter by letter. What
ASCII white space parts is looked up first; what is not found is split further, as the pattern does, and
its parts are looked up. Counts come from

1. the frequent tier: strings of a bounded sample of rows (`SAMPLE_ROWS`) with their token counts, the
   `FREQUENT` most common, packed into two buffers and broadcast: at most FREQUENT entries of ENTRY_BYTES;
2. the worker's tier: what the first lacks is encoded by the library, and remembered, up to `REMEMBERED`
   strings, after which a worker begins anew.

Both tiers only spare work: whatever the sample holds, counts are the library's. Strings with characters
beyond Latin-1, and those that may hold a special string, go to the library as they are.

A null text counts as empty: no byte, no token. Texts are read whole. Repeated rows and repeated or null
keys give a row each; other columns are dropped, so their names can't clash; an empty table gives an
empty result. Ties in frequency go to the smaller bytes.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from colloquy.llm.common import chunks, table, tokenizer_path
from colloquy.llm.sstable import LOWER, PRETOKEN

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
SAMPLE_ROWS, SAMPLE_TASKS, FREQUENT, ENTRY_BYTES = 8192, 8, 1 << 16, 64
#: Strings that one worker remembers; longer ones than ENTRY_BYTES are encoded each time. Bounds memory, never results.
REMEMBERED = 1 << 18
#: The byte-level alphabet of the vocabulary, by rule: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: b if b in _PRINTABLE else 256 + sum(c not in _PRINTABLE for c in range(b)) for b in range(256)}


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Tokenizer.from_file(path)


def pretokens(word: bytes) -> list[bytes] | None:
    """The parts into which the vocabulary splits a string, lower-cased; None if only the library can tell."""
    if b"<|" in word:
        return None
    if word.isascii():
        return PRETOKEN.findall(word.lower())
    try:
        parts = PRETOKEN.findall(word.decode().encode("latin-1").translate(LOWER))
    except UnicodeEncodeError:
        return None
    return [p.decode("latin-1").encode() for p in parts]


def length_of(tok: Tokenizer, part: bytes) -> int:
    """Tokens of one pre-token, by the library's merges."""
    return len(tok.model.tokenize(part.decode("latin-1").translate(BYTE_LEVEL)))


class Lengths:
    """Token counts of pre-tokens, as two flat buffers for the broadcast and one hash table in the worker that opens them."""

    def __init__(self, counts: dict[bytes, int]):
        self.words, self.counts = b" ".join(counts), np.array(list(counts.values()), np.uint16).tobytes()

    def open(self) -> dict[bytes, int]:
        return dict(zip(self.words.split(), np.frombuffer(self.counts, np.uint16).tolist(), strict=True))


def frequent(docs: DataFrame, path: str, text: str = "text", rows: int = SAMPLE_ROWS, top: int = FREQUENT) -> Lengths:
    """The most common pre-tokens of about `rows` rows, those with the lowest hashes of key-less content."""
    total = docs.count()
    some = docs.select(F.col(text).cast("binary").alias("t")).where("t is not null")
    if total > rows:
        some = some.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < int(rows / total * (1 << 40))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in (p for b in batches for p in chunks(b, 0)):
            for t in part.column(0).to_pylist():
                seen.update(t.split())
            if len(seen) > REMEMBERED:  # what is rare so far is no loss: it would go to the workers' tier
                seen = Counter(dict(seen.most_common(REMEMBERED // 2)))
        for w, n in list(seen.items()):
            for p in pretokens(w) or ():
                if p != w:
                    seen[p] += n
        best = sorted((w for w in seen if len(w) <= ENTRY_BYTES), key=lambda w: (-seen[w], w))[:top]
        counts = Counts(path, Lengths({}))
        yield pa.record_batch([pa.array(best, pa.binary()), pa.array([seen[w] for w in best], pa.int64()), pa.array([counts.of(w) for w in best], pa.int32())], ["w", "n", "tokens"])

    # a table of SAMPLE_TASKS * top entries at most, whatever the corpus
    tables = some.repartition(SAMPLE_TASKS).mapInArrow(run, "w binary, n long, tokens int").toArrow()
    counts, tokens = Counter(), {}
    for w, n, k in zip(*(tables.column(c).to_pylist() for c in ("w", "n", "tokens")), strict=True):
        counts[w] += n
        tokens[w] = k
    return Lengths({w: tokens[w] for w in sorted(counts, key=lambda w: (-counts[w], w))[:top]})


class Counts:
    """A worker's two tiers."""

    def __init__(self, path: str, known: Lengths):
        self.tok, self.known = tokenizer(path), known.open()
        self.seen: dict[bytes, int] = {}

    def of(self, word: bytes) -> int:
        """Tokens of a string without white space."""
        n = self.known.get(word)
        if n is None:
            n = self.seen.get(word)
        if n is None:
            parts = pretokens(word)
            if parts is None:
                n = len(self.tok.encode(word.decode(), add_special_tokens=False))
            elif parts == [word]:
                n = length_of(self.tok, word)
            else:
                n = sum(map(self.of, parts))
            if len(word) <= ENTRY_BYTES:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = n
        return n

    def count(self, text: bytes) -> int:
        words, known, total = text.split(), self.known, 0
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for w in words:
            total += known[w] if w in known else self.of(w)
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    path = vocabulary or tokenizer_path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, shared.value)
        for part in (p for b in batches for p in chunks(b, 1)):
            raw = [t or b"" for t in part.column(1).to_pylist()]
            n = list(map(counts.count, raw))
            yield pa.record_batch([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(n, pa.int64())], ["k", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
