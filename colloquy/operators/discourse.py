"""Discourse structures over tagged utterances: links of answers, qualifications, context, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import token_estimate

#: Earlier positions that an answer may answer, and questions kept of them.
REACH, NEAREST = 20, 5


def families(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys, "family").agg(F.count("*").alias("n"), F.max("strength").alias("strength"))


def unclassified(utterances: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    return utterances.join(hits.select(*keys).distinct(), keys, "left_anti")


def question_answers(utterances: DataFrame, hits: DataFrame, reach: int = REACH, nearest: int = NEAREST) -> DataFrame:
    """Candidate questions of each answer: earlier positions within reach, by another speaker, nearest first.

    An answer is an utterance without a question. One window gathers the reachable questions, so a
    conversation is sorted once and no pairs of utterances are joined.
    """
    is_q = hits.where("family = 'question'").select("corpus_id", "pos").distinct().withColumn("is_q", F.lit(True))
    rows = utterances.join(is_q, ["corpus_id", "pos"], "left").withColumn("is_q", F.coalesce("is_q", F.lit(False)))
    w = Window.partitionBy("corpus_id").orderBy("pos").rangeBetween(-reach, -1)
    asked = F.collect_list(F.when(F.col("is_q"), F.struct(F.col("pos").alias("q"), F.col("speaker").alias("by"), F.col("end_us").alias("q_end")))).over(w)
    found = rows.withColumn("asked", asked).where(~F.col("is_q"))
    found = found.withColumn("asked", F.slice(F.reverse(F.array_sort(F.filter("asked", lambda x: x["by"] != F.col("speaker")))), 1, nearest))
    return found.select("corpus_id", F.col("pos").alias("answer_pos"), "start_us", F.posexplode("asked").alias("rank", "a")).select("corpus_id", "answer_pos", F.col("a.q").alias("question_pos"), (F.col("rank") + 1).alias("rank"), (F.col("start_us") - F.col("a.q_end")).alias("distance_us"))


def qualified_concessions(hits: DataFrame) -> DataFrame:
    """Concessions with the qualifications of the same utterance."""
    c = hits.where("family = 'concession'").select("corpus_id", "pos", F.col("rule").alias("concession"))
    q = hits.where("family = 'qualification'").select("corpus_id", "pos", F.col("rule").alias("qualification"))
    return c.join(q, ["corpus_id", "pos"])


def preceding_context(utterances: DataFrame, n: int, same_speaker: bool = False) -> DataFrame:
    """(corpus_id, pos, members, tokens): the n utterances before each, of all speakers or its own."""
    keys = ["corpus_id", "speaker"] if same_speaker else ["corpus_id"]
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-n, -1)
    rows = utterances.withColumn("tokens", token_estimate(F.col("text")))
    return rows.select("corpus_id", "pos", F.count("pos").over(w).alias("members"), F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long").alias("context_tokens"), F.min("pos").over(w).alias("first_pos"))


def procedural_state(hits: DataFrame) -> DataFrame:
    """After each procedural event: last time warning and topic transition, whether time has run out, whether the floor is granted."""
    w = Window.partitionBy("corpus_id").orderBy("pos", "rule_no").rowsBetween(Window.unboundedPreceding, 0)

    def last(rule: str):
        return F.last(F.when(F.col("rule") == rule, F.col("pos")), ignorenulls=True).over(w)

    floor = F.last(F.when(F.col("rule") == "procedural.floor_grant", True).when(F.col("rule") == "procedural.time_expired", False), ignorenulls=True).over(w)
    expired = F.max((F.col("rule") == "procedural.time_expired").cast("int")).over(w) == 1
    rows = hits.where("family = 'procedural'")
    return rows.select("corpus_id", "pos", "rule", last("procedural.time_warning").alias("last_warning"), last("procedural.topic_transition").alias("last_transition"), expired.alias("time_expired"), F.coalesce(floor, F.lit(False)).alias("floor_granted"))
