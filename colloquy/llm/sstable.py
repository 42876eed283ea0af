"""Token ids in sorted-string-table shards: a file format with binary-search lookup, its writer and reader.

A shard holds entries in ascending key order:

    data block*   entries (shared, unshared, value length as varints, key suffix, value), zlib, crc32
    index block   for each data block its first and last key, offset and length
    Bloom filter  over all keys
    footer        offsets and lengths of index and filter, entry and token counts, magic

Keys are order-preserving bytes. Values are one byte of width (2 or 4) and the ids, little-endian.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from colloquy.llm.common import shared_dir, table, tokenizer_path

MAGIC = b"CQSSTB01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Words that one worker remembers before it starts afresh; bounds its memory, never its results.
WORDS = 1_000_000
#: The vocabulary file's split pattern over lower-cased Latin-1, with its letters, numbers and spaces.
LETTERS, NUMBERS, SPACES = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
PRETOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[^%b%b%b]+" % (LETTERS, NUMBERS, SPACES, LETTERS, NUMBERS))
LOWER = bytes(ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else i for i, c in enumerate(map(chr, range(256))))
LETTER_SET = frozenset(b for b in range(256) if re.match(rb"[%b]" % LETTERS, bytes([b])))


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def long_key(x: int | None) -> bytes:
    """Order-preserving: null, then negative, then positive."""
    return b"" if x is None else struct.pack(">Q", x + (1 << 63))


def key_long(k: bytes) -> int | None:
    return struct.unpack(">Q", k)[0] - (1 << 63) if k else None


def pack_ids(ids: np.ndarray) -> bytes:
    wide = ids.size and int(ids.max()) > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


def bloom_at(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes (key, value) in ascending key order and writes one shard to a binary file object."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.at = out, block_bytes, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.hashes, self.n, self.tokens = [], [], 0, 0

    def add(self, key: bytes, value: bytes, tokens: int = 0) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last, self.n, self.tokens = key, self.n + 1, self.tokens + tokens
        self.hashes.append(key)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def flush(self) -> None:
        if self.block:
            packed = zlib.compress(bytes(self.block), 1)
            self.index.append((self.first, self.last, *self._put(packed + struct.pack("<I", zlib.crc32(packed)))))
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = bytearray()
        for first, last, at, size in self.index:
            for k in (first, last):
                put_varint(index, len(k))
                index += k
            put_varint(index, at)
            put_varint(index, size)
        bits = max(64, BLOOM_BITS_PER_KEY * self.n)
        bloom = np.zeros(bits, bool)
        for k in self.hashes:
            bloom[bloom_at(k, bits)] = True
        where = [*self._put(bytes(index)), *self._put(np.packbits(bloom, bitorder="little").tobytes())]
        self._put(FOOTER.pack(*where, self.n, self.tokens, MAGIC))


class Reader:
    """One shard; `get` reads the footer, index and filter once, then one block per lookup."""

    def __init__(self, file, size: int):
        self.file = file
        i, ni, b, nb, self.n, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, self.bloom, self.index, at = self._read(i, ni), self._read(b, nb), [], 0
        self.bits = max(64, BLOOM_BITS_PER_KEY * self.n)
        while at < len(raw):
            keys = []
            for _ in range(2):
                n, at = get_varint(raw, at)
                keys.append(raw[at : at + n])
                at += n
            off, at = get_varint(raw, at)
            length, at = get_varint(raw, at)
            self.index.append((*keys, off, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, _, at, n = self.index[block]
        data = self._read(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        buf, at, key = zlib.decompress(data[:-4]), 0, b""
        while at < len(buf):
            shared, at = get_varint(buf, at)
            unshared, at = get_varint(buf, at)
            size, at = get_varint(buf, at)
            key = key[:shared] + buf[at : at + unshared]
            at += unshared
            yield key, buf[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.entries(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in bloom_at(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """All values of the key, in file order."""
        if not self.n or not self.may_hold(key):
            return []
        found, block = [], bisect.bisect_left(self.index, key, key=lambda x: x[1])
        while block < len(self.index) and self.index[block][0] <= key:
            found += [v for k, v in self.entries(block) if k == key]
            block += 1
        return found


def open_shard(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    f = fs.open_input_file(path)
    return Reader(f, f.size())


class Encoder:
    """Ids of whole texts by the tokenizers library, which meets each distinct word once.

    The vocabulary's file splits a text, lower-cased, by PRETOKEN before it merges bytes, so a text's ids
    are those of its words in order. In texts of Latin-1 characters (where lower case, normal form and
    the pattern's classes are plain tables) words are cut here and looked up; a word not met before goes
    to the library, as do, whole, all other texts and those that may hold a special token.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.seen: dict[bytes, bytes] = {}
        ends = np.zeros(1 + max(self.tok.get_vocab(with_added_tokens=True).values()), bool)
        ends[[i for t, i in self.tok.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]] = True
        self.ends = ends

    def learn(self, new: list[bytes]) -> None:
        words = [w for w in new if w[0] in LETTER_SET]  # one run of letters: its last id, and no other, ends a word
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tok.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(part, (4 * cuts).tolist(), strict=True):
                self.seen[w] = raw[begin:end]
                begin = end
        rest = [w for w in new if w[0] not in LETTER_SET]
        for w, e in zip(rest, self.tok.encode_batch([w.decode("latin-1") for w in rest], add_special_tokens=False), strict=True):
            self.seen[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            text = text or ""
            try:
                raw = text.encode("latin-1").translate(LOWER)
            except UnicodeEncodeError:
                raw = b"<|"
            if b"<|" in raw:
                yield np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            words = PRETOKEN.findall(raw)
            try:
                yield b"".join(map(self.seen.__getitem__, words))
            except KeyError:
                if len(self.seen) > WORDS:
                    self.seen = {}
                self.learn([w for w in set(words) if w not in self.seen])
                yield b"".join(map(self.seen.__getitem__, words))


@functools.cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Encoder(path)


MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, out: str, vocabulary: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, add `end_id`, and write shards under the URI `out` in ascending key order.

    Returns the manifest (shard, path, n_docs, n_tokens), itself a table under `out`. The one shuffle
    deals documents by key range; equal keys are ordered, and dealt, by their text. A shard gets its
    name from the attempt that wrote it and only the manifest of finished tasks names it, so a retried
    or speculative task does no harm. Null texts are empty, null keys come first, an empty table gives an
    empty manifest.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(path), TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(out)
        name, w, f = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst", None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if w is None:
                    fs.create_dir(folder, recursive=True)
                    f = fs.open_output_stream(f"{folder}/{name}")
                    w = Writer(f)
                ids = np.frombuffer(ids + end, "<u4")
                w.add(long_key(k), pack_ids(ids), ids.size)
        if w is not None:
            w.close()
            f.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{out}/{name}"]), pa.array([w.n], pa.int64()), pa.array([w.tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    tie = F.xxhash64("t")
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k", tie).sortWithinPartitions("k", tie, "t")
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): the entries of all shards; `start` counts the ids of all entries before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                for block in range(len(shard.index)):
                    keys, starts, values = [], [], []
                    for k, v in shard.entries(block):
                        ids = unpack_ids(v)
                        keys.append(key_long(k))
                        starts.append(start)
                        values.append(ids.tobytes())
                        start += ids.size
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], [key, "start", "ids"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("start"))  # one row per shard, far fewer than documents
    return shards.repartition(max(1, manifest.count())).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]))


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the given keys: each shard answers by filter, index and one block a hit, without a scan.

    `keys` is a small table of identifiers; it is sent to every shard.
    """
    wanted = sorted({r[0] for r in keys.select(F.col(key).cast("long")).distinct().limit(100_001).collect()}, key=long_key)
    if len(wanted) > 100_000:
        raise ValueError("join read_shards() instead of looking up so many keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = open_shard(path)
                found = [(k, unpack_ids(v).tobytes()) for k in wanted for v in shard.get(long_key(k))]
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], [key, "ids"])

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.BinaryType())]))


def op3_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_shards(write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "sstable")))
    n = (F.length("ids") / 4).cast("long")
    return back.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
