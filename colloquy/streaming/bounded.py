"""Streams of utterances: sessions that close by watermark, and contexts in a state of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Utterances of a context, and those a relation is searched in.
CONTEXT, SEARCH = 12, 20


def sessions(stream: DataFrame, gap: str, late: str, key: str = "corpus_id", at: str = "at") -> DataFrame:
    """(key, start, end, n): runs of rows less than `gap` apart; rows later than `late` are dropped by the watermark."""
    w = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def contexts(stream: DataFrame, most: int = CONTEXT) -> DataFrame:
    """(corpus_id, pos, context, digest) of (corpus_id, pos): the utterances before, `most` at most, and their digest.

    The state of a recording is its last `most` positions, however long it gets. Rows of a micro-batch are
    taken in order; a position not above the last one taken is a repeat and gives no row.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for pos in sorted(int(p) for part in parts for p in part["pos"]):
            if held and pos <= held[-1]:
                continue
            out.append((key[0], pos, list(held), hashlib.sha256(",".join(map(str, held)).encode()).hexdigest()))
            held = [*held, pos][-most:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["corpus_id", "pos", "context", "digest"])

    return stream.select("corpus_id", "pos").groupBy("corpus_id").applyInPandasWithState(step, "corpus_id long, pos long, context array<long>, digest string", "held array<long>", "append", GroupStateTimeout.NoTimeout)
