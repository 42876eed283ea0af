"""The corpus pipeline: documents through five stages, each on all that the one before has kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, rows that share a doc_id or
have none, empty tables, and further columns of any name, and returns the columns it was given (the last:
its own). What each makes of them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import byte_bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from colloquy.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, scores under 0.5.

    A null or empty text has no term and scores as the model's base does; repeated rows score alike and go
    or stay together; texts are read whole. Without labels of both kinds nothing is toxic.
    """
    return toxicity.clean_rows(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal or similar texts: that of the smallest doc_id, rows without one last.

    Repeated rows, rows that share a doc_id and rows without one are rows like others: one of a class stays.
    Empty texts are equal texts. Rows with a null text are no copies of each other: all stay.
    """
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without byte strings that occurred before.

    Null texts stay null, empty ones empty; a text that repeats others throughout becomes empty. Rows with
    equal doc_id and text are one document, and get equal texts; null doc_ids come first. n_chars is counted
    anew where it was not null and the text isn't.
    """
    return suffix_dedup.cleaned(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows are judged by their own text, also where they share a doc_id or have none; null and empty texts
    stay. Without items all stay.
    """
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again for the record.

    Null texts count as empty: no ids. Every row gives a row, also repeated ones and those without a doc_id.
    """
    both = byte_bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: Trained, tree- and byte-level stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
