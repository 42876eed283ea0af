"""What a model proposes about an utterance, taken only where the utterance and its context bear it out.

proposals: keys of the utterance, response_id, proposal_id, family, quote, start (offset or null), alternative_group
(null: none) and targets, an array of structs (type, status, id, alternatives: array of ids). Offsets count
code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Proposals of a response, at most, and the statuses of a target that must be in context.
BUDGET = 5
CERTAIN = ["identified", "probable"]
REASONS = ["over_budget", "unknown_utterance", "empty_quote", "span_mismatch", "quote_absent", "target_outside_context", "alternative_outside_context"]


def offsets(text: Column, quote: Column) -> Column:
    """All offsets at which `quote` stands in `text`, overlapping ones too; empty for an empty quote."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(quote) + 1))
    found = F.filter(places, lambda i: F.substr(text, i, F.length(quote)) == quote)
    return F.when(F.coalesce((F.length(quote) > 0) & text.contains(quote), F.lit(False)), F.transform(found, lambda i: (i - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def normalized(proposals: DataFrame, utterances: DataFrame, context: DataFrame, keys: list[str], text: str = "text", member: str = "member") -> DataFrame:
    """(keys, response_id, proposal_id, family, quote, places, alternatives, reason): every proposal, reason null where it is taken.

    utterances: keys and text; context: keys and `member`, the ids that a target may name. places are all
    offsets of the quote, or the one that is given if the quote stands there. alternatives are the other
    proposals of the same group and response, sorted, whatever became of them. Of several reasons the first of
    REASONS stands: a response of more than BUDGET proposals is refused whole. Targets of other types than
    utterances, and uncertain ones, are not looked up; their alternatives are, if they are utterances.
    """
    n = proposals.groupBy("response_id").agg(F.count("*").alias("n"))
    peers = proposals.where("alternative_group is not null").groupBy("response_id", "alternative_group").agg(F.array_sort(F.collect_set("proposal_id")).alias("peers"))
    targets = proposals.select("response_id", "proposal_id", *keys, F.explode("targets").alias("t")).where("t.type = 'utterance'")
    named = targets.select("response_id", "proposal_id", *keys, F.explode(F.concat(
        F.when(F.col("t.status").isin(CERTAIN), F.array(F.struct(F.lit("target_outside_context").alias("why"), F.col("t.id").cast("string").alias("id")))).otherwise(F.array().cast("array<struct<why: string, id: string>>")),
        F.coalesce(F.transform("t.alternatives", lambda a: F.struct(F.lit("alternative_outside_context").alias("why"), a.cast("string").alias("id"))), F.array().cast("array<struct<why: string, id: string>>")),
    )).alias("x")).select("response_id", "proposal_id", *keys, "x.*")
    inside = context.select(*keys, F.col(member).cast("string").alias("id")).distinct()
    outside = named.join(inside, [*keys, "id"], "left_anti").groupBy("response_id", "proposal_id").agg(F.max("why").alias("outside"))  # `target` stands before `alternative`
    rows = proposals.join(utterances.select(*keys, F.col(text).alias("__text"), F.lit(True).alias("known")), keys, "left").join(n, "response_id").join(peers, ["response_id", "alternative_group"], "left").join(outside, ["response_id", "proposal_id"], "left")
    quote, given = F.col("quote"), F.col("start")
    body = F.coalesce("__text", F.lit(""))
    there = F.coalesce((given >= 0) & (F.substr(body, given + 1, F.length(quote)) == quote), F.lit(False))
    places = F.when(given.isNotNull(), F.when(there, F.array(given.cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(offsets(body, quote))
    rows = rows.withColumn("places", places)
    tests = [F.col("n") > BUDGET, F.col("known").isNull(), F.coalesce(quote, F.lit("")) == "", given.isNotNull() & ~there, F.size("places") == 0, F.col("outside") == REASONS[5], F.col("outside") == REASONS[6]]
    reason = F.coalesce(*(F.when(test, name) for test, name in zip(tests, REASONS, strict=True)))
    others = F.array_except(F.coalesce("peers", F.array().cast(peers.schema["peers"].dataType)), F.array("proposal_id"))
    return rows.select(*keys, "response_id", "proposal_id", "family", "quote", "places", others.alias("alternatives"), reason.alias("reason"))
