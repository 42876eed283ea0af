"""Contexts, relation searches and chained digests of recordings that grow, in a state of bounded size.

Of every utterance: the CONTEXT utterances before it, the SEARCH acts before it, and a digest of it and of the
digest before. What is kept of a recording is that and no more, however long it gets; the same step runs
over whole tables and over streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.streaming.bounded import CONTEXT, SEARCH

FIRST = "0" * 64


class Recording:
    """The bounded state of one recording."""

    def __init__(self, context: list[int] | None = None, acts: list[str] | None = None, digest: str = FIRST):
        self.context, self.acts, self.digest = list(context or []), list(acts or []), digest

    def step(self, pos: int, act: str | None, most: int = CONTEXT, search: int = SEARCH) -> tuple[list[int], list[str], str] | None:
        """(context, acts, digest) of the next utterance; None for one that is not after the last."""
        if self.context and pos <= self.context[-1]:
            return None
        self.digest = hashlib.sha256(f"{self.digest}\n{pos}\n{act or ''}".encode()).hexdigest()
        told = list(self.context), list(self.acts), self.digest
        self.context = [*self.context, pos][-most:]
        if act is not None:
            self.acts = [*self.acts, act][-search:]
        return told


def contexts(rows: DataFrame, key: str = "corpus_id", most: int = CONTEXT, search: int = SEARCH) -> DataFrame:
    """(key, pos, context, acts, digest) of rows (key, pos, act), null acts being none; of equal positions one counts, that with the smallest act.

    One sort of each recording; its rows stream past the state.
    """
    schema = T.StructType([rows.schema[key], T.StructField("pos", T.LongType()), T.StructField("context", T.ArrayType(T.LongType())), T.StructField("acts", T.ArrayType(T.StringType())), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, Recording()
        for batch in batches:
            at, told = [], []
            for i, (k, pos, act) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if now != (k,):
                    now, of = (k,), Recording()
                got = of.step(pos, act, most, search)
                if got:
                    at.append(i)
                    told.append(got)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([t[0] for t in told], pa.list_(pa.int64())), pa.array([t[1] for t in told], pa.list_(pa.string())), pa.array([t[2] for t in told], pa.string())], [key, "pos", "context", "acts", "digest"])

    sound = rows.where(F.col("pos").isNotNull()).select(key, F.col("pos").cast("long").alias("pos"), F.col("act").cast("string").alias("act"))
    return sound.repartition(key).sortWithinPartitions(key, "pos", F.col("act").asc_nulls_last()).mapInArrow(run, schema)


def stream(rows: DataFrame, late: str, idle_ms: int, most: int = CONTEXT, search: int = SEARCH) -> DataFrame:
    """The same of a stream (corpus_id, pos, act, at), at being the time of the utterance.

    Rows wait until the watermark, `late` behind the newest, has passed them, and are then taken in order of
    position; so rows that come late or in disorder by less than that give what the whole table would. Later
    ones are dropped, repeats give nothing. The state of a recording is what waits and its Recording; it is
    removed once nothing waits and no row has come for idle_ms of event time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        context, acts, digest, waiting, last = state.get if state.exists else ([], [], FIRST, [], 0)
        mark = state.getCurrentWatermarkMs()
        of, waiting = Recording(context, acts, digest), [tuple(w) for w in waiting]
        for part in parts:
            times = part["at"].astype("datetime64[ms]").astype("int64")
            waiting += [(int(t), int(p), None if pd.isna(a) else str(a)) for t, p, a in zip(times, part["pos"], part["act"], strict=True)]
        last = max([last, *(w[0] for w in waiting)])
        ready = sorted((w for w in waiting if w[0] <= mark), key=lambda w: (w[1], w[2] is None, w[2] or ""))
        waiting = [w for w in waiting if w[0] > mark]
        told = [(key[0], pos, *got) for _, pos, act in ready if (got := of.step(pos, act, most, search))]
        if not waiting and mark >= last + idle_ms:
            state.remove()
        else:
            state.update((of.context, of.acts, of.digest, waiting, last))
            state.setTimeoutTimestamp(max(mark + 1, min([w[0] for w in waiting], default=last + idle_ms)))
        yield pd.DataFrame(told, columns=["corpus_id", "pos", "context", "acts", "digest"])

    held = "context array<long>, acts array<string>, digest string, waiting array<struct<at: bigint, pos: bigint, act: string>>, last long"
    timed = rows.select("corpus_id", F.col("pos").cast("long").alias("pos"), "act", "at").where("pos is not null and at is not null").withWatermark("at", late)
    return timed.groupBy("corpus_id").applyInPandasWithState(step, "corpus_id long, pos long, context array<long>, acts array<string>, digest string", held, "append", GroupStateTimeout.EventTimeTimeout)
