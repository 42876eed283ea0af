"""Append-only ledgers: current rows, chains, conflicts, corrections and what a change invalidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of both sides of a join in one part.
PART_ROWS = 1 << 20


def active(ledger: DataFrame, entry: str = "entry_id", predecessor: str = "predecessor_id") -> DataFrame:
    """Entries that no other supersedes."""
    superseded = ledger.where(F.col(predecessor).isNotNull()).select(F.col(predecessor).alias(entry))
    return ledger.join(superseded, entry, "left_anti")


def latest(ledger: DataFrame, key: str = "target_id", order: tuple[str, ...] = ("at_us", "entry_id")) -> DataFrame:
    """The last entry of each target, by partial aggregation: no sort of a target's history."""
    rest = [c for c in ledger.columns if c != key and c not in order]
    return ledger.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose current rows name different values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    return child.join(parent.select(on), on, "left_anti")


def sides(child: DataFrame, parent: DataFrame, on: str, share: int = PART_ROWS) -> DataFrame:
    """Child and parent rows that share `on`, and those of either side alone, with booleans child and parent.

    One pass over both: rows are dealt by key to as many parts as there are `share` rows, so the rows that a task
    sorts do not grow with the tables. Rows without a key are alone.
    """
    rows = child.count() + parent.count()  # of Parquet files, read from their footers
    parts = max(int(child.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // share))
    c, p = (df.repartition(parts, on).withColumn(name, F.lit(True)) for df, name in ((child, "child"), (parent, "parent")))
    no = F.lit(False)
    return c.hint("merge").join(p, on, "full").withColumns({"child": F.coalesce("child", no), "parent": F.coalesce("parent", no)})


def corrected(rows: DataFrame, corrections: DataFrame, key: list[str], column: str) -> DataFrame:
    """`column` replaced where a correction (key, expected, replacement, seq) expects the value it finds; the last one wins.

    `status` tells: unchanged, applied, or stale where the expectation fails.
    """
    last = corrections.groupBy(*key).agg(F.max(F.struct("seq", "expected", "replacement")).alias("c"))
    both = rows.join(last, key, "left")
    status = F.when(F.col("c").isNull(), "unchanged").when(F.col(column).eqNullSafe(F.col("c.expected")), "applied").otherwise("stale")
    return both.withColumn("status", status).withColumn(column, F.when(F.col("status") == "applied", F.col("c.replacement")).otherwise(F.col(column))).drop("c")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed, changed or same rows of two versions."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def chain_depth(ledger: DataFrame, key: str = "target_id", order: tuple[str, ...] = ("at_us", "entry_id")) -> DataFrame:
    """Each entry's place in its target's chain, from 0."""
    return ledger.withColumn("depth", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
