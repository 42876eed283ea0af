"""Byte-level BPE with the tiktoken library and a local rank file.

Input: any DataFrame with a key column and a text column; other columns are dropped, so their names
cannot clash. A null text counts as empty; repeated rows and repeated or null keys stay as they are;
an empty table gives an empty result. Texts are encoded whole: a long one is cut only where no match
of the split pattern can span, so its ids equal those of the uncut text. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import chunks, table, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from which a text is encoded in pieces.
LONG_TEXT = 1 << 16


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cut before a space that follows a letter or digit: no match of the pattern holds both, and none looks back."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = LONG_TEXT) -> np.ndarray:
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text, size)]).astype("<u4", copy=False)


def encode(docs: DataFrame, ranks_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens): ids holds each document's ids as little-endian unsigned 32-bit integers."""
    path = ranks_path or tokenizer_path(RANKS)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for part in (p for b in batches for p in chunks(b, 1)):
            ids = [encode_text(enc, t or "") for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.size for x in ids], pa.int64())], ["k", "ids", "n_tokens"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, T.StructType([T.StructField("k", kind.dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))
    return out.withColumnRenamed("k", key)


def decode(encoded: DataFrame, ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id", "ids", "n_tokens")) -> DataFrame:
    """The columns of `keep` and `decoded`, the raw bytes of `ids`; bytes need not be valid UTF-8."""
    path = ranks_path or tokenizer_path(RANKS)
    fields = [encoded.schema[c] for c in keep]
    at = list(keep).index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], [*keep, "decoded"])

    return encoded.select(*keep).mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: (key, ids, n_tokens, decoded), the last from the ids alone."""
    path = ranks_path or tokenizer_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for part in (p for b in batches for p in chunks(b, 1)):
            ids = [encode_text(enc, t or "") for t in part.column(1).to_pylist()]
            raw = [enc.decode_bytes(x.tolist()) for x in ids]
            yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.size for x in ids], pa.int64()), pa.array(raw, pa.binary())], ["k", "ids", "n_tokens", "decoded"])

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
