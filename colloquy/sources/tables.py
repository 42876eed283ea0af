"""Normalized evidence tables from raw ones: intervals, utterances, words, ledgers, clusters.

Times are integer microseconds and intervals are half-open, [start_us, end_us).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, interval_id, label, start_us, end_us) of events that last a whole unit at least."""
    e = read(spark, sf_dir, "events")
    seconds = F.floor(F.col("value") * 300).cast("long")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("corpus_id"), F.col("event_id").alias("interval_id"), F.col("event_type").alias("label"), start.alias("start_us"), (start + seconds * 1_000_000).alias("end_us"), seconds.alias("seconds")).where("seconds >= 1").drop("seconds")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, event_id, label, at_us, value) of all events."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("corpus_id"), "event_id", F.col("event_type").alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "value")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, pos, speaker, text, start_us, end_us) of conversations; some overlap the one before."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("corpus_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text", (60_000 * F.length("text")).cast("long").alias("dur"))
    before = F.coalesce(F.sum("dur").over(Window.partitionBy("corpus_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + 300_000 * F.col("pos") - F.when(F.col("pos") % 3 == 2, 500_000).otherwise(0)
    return c.withColumn("start_us", start.cast("long")).withColumn("end_us", F.col("start_us") + F.col("dur")).drop("dur")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, pos, speaker, word_no, word, n_words, start_us, end_us): the words of utterances, each with its even share of the time."""
    u = utterances(spark, sf_dir).withColumn("ws", F.expr("filter(split(text, '[ \\t\\r\\n]+'), w -> w <> '')")).where("size(ws) > 0")
    u = u.withColumn("each", F.expr("(end_us - start_us) div size(ws)"))
    w = u.select("corpus_id", "pos", "speaker", F.size("ws").cast("long").alias("n_words"), F.col("start_us").alias("s"), "each", F.posexplode("ws").alias("i", "word"))
    at = F.col("s") + F.col("i") * F.col("each")
    return w.select("corpus_id", "pos", "speaker", (F.col("i") + 1).cast("long").alias("word_no"), "word", "n_words", at.alias("start_us"), (at + F.col("each")).alias("end_us"))


def heard(text: str = "text") -> Column:
    """A transcript of `text` that drops every seventh word and takes every fifth for another."""
    return F.expr(f"array_join(transform(filter(split({text}, ' '), (w, i) -> i % 7 <> 3), (w, i) -> if(i % 5 = 2, 'word', w)), ' ')")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_id, entry_id, predecessor_id, action, at_us): orders as an append-only ledger of each customer."""
    o = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("entry_id"), F.lag("o_orderkey").over(w).alias("predecessor_id"), F.col("o_orderstatus").alias("action"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, reference, predicted): labelled vectors with a derived clustering."""
    e = read(spark, sf_dir, "embeddings").where("label is not null")
    return e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("reference"), F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("predicted"))


#: The same tables for a SQL engine, as common table expressions.
EV = "ev AS (SELECT user_id AS corpus_id, event_id AS interval_id, event_type AS label, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(value * 300) AS BIGINT) * 1000000 AS end_us FROM events WHERE floor(value * 300) >= 1)"
PT = "pt AS (SELECT user_id AS corpus_id, event_id, event_type AS label, epoch_us(ts) AS at_us, value FROM events)"
U = """u AS (SELECT conv_id AS corpus_id, turn AS pos, role AS speaker, text,
    CAST(coalesce(sum(60000 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 300000 * turn - CASE WHEN turn % 3 = 2 THEN 500000 ELSE 0 END AS BIGINT) AS start_us,
    60000 * length(text) AS dur FROM conversations), ut AS (SELECT corpus_id, pos, speaker, text, start_us, start_us + dur AS end_us FROM u)"""
WD = U + r""", ws AS (SELECT *, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM ut),
    wn AS (SELECT *, (end_us - start_us) // len(ws) AS each FROM ws WHERE len(ws) > 0),
    wd AS (SELECT corpus_id, pos, speaker, word_no, ws[word_no] AS word, CAST(len(ws) AS BIGINT) AS n_words, CAST(start_us + (word_no - 1) * each AS BIGINT) AS start_us, CAST(start_us + word_no * each AS BIGINT) AS end_us
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS word_no FROM wn))"""
LG = "lg AS (SELECT o_custkey AS target_id, o_orderkey AS entry_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor_id, o_orderstatus AS action, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS at_us FROM orders)"
CL = "cl AS (SELECT vec_id AS item_id, label AS reference, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS predicted FROM embeddings WHERE label IS NOT NULL)"
