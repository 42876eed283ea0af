"""Context of utterances: windows of six kinds, selection under budgets, boundaries where labels change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import token_estimate
from colloquy.operators.sequence import runs

#: Policy defaults of context windows.
PRECEDING, FOLLOWING, SAME_SPEAKER = 4, 4, 6
RADIUS_US = 30_000_000
UTTERANCES, TOKENS, DURATION_US = 12, 1200, 120_000_000


def windows(u: DataFrame) -> DataFrame:
    """(corpus_id, pos, kind, member): preceding, following, same_speaker, exchange, current_turn and temporal members.

    A same_speaker window needs a speaker. The temporal one holds all that lie within RADIUS_US, the target too.
    """

    def near(kind: str, keys: list[str], low: int, high: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(low, high)
        held = u.where(F.col(keys[-1]).isNotNull()).select("corpus_id", "pos", F.collect_list("pos").over(w).alias("held"))
        return held.select("corpus_id", "pos", F.lit(kind).alias("kind"), F.explode("held").alias("member"))

    out = near("preceding", ["corpus_id"], -PRECEDING, -1).union(near("following", ["corpus_id"], 1, FOLLOWING)).union(near("same_speaker", ["corpus_id", "speaker"], -SAME_SPEAKER, -1)).union(near("exchange", ["corpus_id"], -1, 1))
    r = runs(u, "speaker", order=("pos",))
    turn = r.groupBy("corpus_id", "run").agg(F.collect_list("pos").alias("held")).withColumn("member", F.explode("held"))
    out = out.union(r.select("corpus_id", "pos", "run").join(turn, ["corpus_id", "run"]).select("corpus_id", "pos", F.lit("current_turn"), "member"))
    return out.union(within(u, RADIUS_US))


def within(u: DataFrame, radius_us: int) -> DataFrame:
    """(corpus_id, pos, kind, member): what lies at most radius_us away, by bins of it."""

    def binned(df: DataFrame, name: str, by: int) -> DataFrame:
        bins = F.sequence(F.floor((F.col("start_us") - by) / radius_us), F.floor((F.col("end_us") + by) / radius_us))
        return df.select("corpus_id", F.col("pos").alias(name), F.col("start_us").alias(f"{name}_s"), F.col("end_us").alias(f"{name}_e"), F.explode(bins).alias("bin"))

    pairs = binned(u, "pos", radius_us).join(binned(u, "member", 0), ["corpus_id", "bin"])
    gap = F.greatest(F.col("pos_s") - F.col("member_e"), F.col("member_s") - F.col("pos_e"), F.lit(0))
    # kept in the first bin that both are in
    first = F.greatest(F.floor((F.col("pos_s") - radius_us) / radius_us), F.floor(F.col("member_s") / radius_us))
    return pairs.where((gap <= radius_us) & (F.col("bin") == first)).select("corpus_id", "pos", F.lit("temporal").alias("kind"), "member")


class TargetTooLarge(ValueError):
    """Of a window whose target alone exceeds a budget; `budget` names it."""

    def __init__(self, target: int, budget: str):
        super().__init__(f"utterance {target} alone exceeds its budget of {budget}")
        self.budget = budget


def selected(target: int, rows: list[tuple], utterances: int = UTTERANCES, tokens: int = TOKENS, duration_us: int = DURATION_US) -> dict[int, str]:
    """{member: 'member' or the first budget it breaks} of (pos, speaker, tokens, start_us, end_us), the target's row included.

    The target comes first; then always the one whose speaker has been taken least, the nearest of those, the
    earliest of those. What breaks a budget is passed over. The target must fit alone.
    """
    left = {r[0]: r for r in rows}
    taken, out, used = [], {}, 0
    speakers: dict = {}
    while left:
        pos = target if target in left else min(left, key=lambda p: (speakers.get(left[p][1], 0), abs(p - target), p))
        row = left.pop(pos)
        spans, covered, reach = sorted((r[3], r[4]) for r in [*taken, row]), 0, None
        for s, e in spans:
            covered += max(0, e - (s if reach is None else max(s, reach)))
            reach = e if reach is None else max(reach, e)
        why = "utterances" if len(taken) + 1 > utterances else "tokens" if used + row[2] > tokens else "duration" if covered > duration_us else "member"
        if why != "member" and pos == target:
            raise TargetTooLarge(target, why)
        out[pos] = why
        if why == "member":
            taken.append(row)
            used += row[2]
            speakers[row[1]] = speakers.get(row[1], 0) + 1
    return out


def decided(target: int, rows: list[tuple], utterances: int = UTTERANCES, tokens: int = TOKENS, duration_us: int = DURATION_US) -> dict[int, str]:
    """As `selected`; where the target alone exceeds a budget, it is left out for that, and the others for `target`."""
    try:
        return selected(target, rows, utterances, tokens, duration_us)
    except TargetTooLarge as no:
        return {r[0]: no.budget if r[0] == target else "target" for r in rows}


def budgeted(u: DataFrame, members: DataFrame, utterances: int = UTTERANCES, tokens: int = TOKENS, duration_us: int = DURATION_US) -> DataFrame:
    """(corpus_id, pos, member, decision): each window's members under its budgets.

    Every choice depends on those before, so a window is one call; windows stream past, sorted, a few thousand rows
    at a time, and no more than one is held besides. A target too large for its budget has no members; that is
    a decision of its window, no error of the job.
    """
    facts = u.select("corpus_id", F.col("pos").alias("member"), "speaker", token_estimate(F.col("text")).alias("tokens"), "start_us", "end_us")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(window: tuple[int, int], rows: list[tuple]) -> list[tuple]:
            return [(*window, member, why) for member, why in decided(window[1], rows, utterances, tokens, duration_us).items()]

        now, held, out = None, [], []
        for part in parts:
            for corpus, pos, *row in part.itertuples(index=False, name=None):
                if now != (corpus, pos):
                    if held:
                        out += done(now, held)
                    now, held = (corpus, pos), []
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["corpus_id", "pos", "member", "decision"])
            out = []
        if held:
            yield pd.DataFrame(done(now, held), columns=["corpus_id", "pos", "member", "decision"])

    rows = members.select("corpus_id", "pos", "member").distinct().join(facts, ["corpus_id", "member"]).select("corpus_id", "pos", "member", "speaker", "tokens", "start_us", "end_us")
    return rows.repartition("corpus_id", "pos").sortWithinPartitions("corpus_id", "pos").mapInPandas(run, "corpus_id long, pos long, member long, decision string")


def change_boundaries(df: DataFrame, key: str = "corpus_id", at: str = "at_us", tie: str = "event_id", label: str = "label") -> DataFrame:
    """(key, at): the different times at which the label changes, null being a label too."""
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = df.select(key, at, label, F.lag(label).over(w).alias("before"), F.lag(F.lit(1)).over(w).alias("any"))
    return rows.where(F.col("any").isNotNull() & ~F.col(label).eqNullSafe(F.col("before"))).select(key, at).distinct()
