"""Proofs that derived parts cover what they were made from: words exactly once, one lineage, one attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of a span's attribution, and the statuses of an utterance that roll up from them.
REVIEWED, MACHINE, SEVERAL = "reviewed", "machine_cluster", ("multiple_candidates", "conflicted")
BOUND, CLUSTERED, CONFLICTING, UNKNOWN = "manually_bound", "machine_clustered", "conflicting", "unknown"


def word_faults(source: DataFrame, owned: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, word_id, finding) of words for which the utterances are no partition of the source's.

    source: key, word_id, place; owned: key, utterance, n (place in it), word_id. missing: in no utterance; twice: in
    several, or several times in one; foreign: not in the source; repeated: twice in the source itself;
    out_of_order: after a word of its utterance that comes later in the source (ties of n are in order). A null word_id is foreign.
    Words are counted in one aggregation of both sides, so a word that many utterances claim is summed before
    it is shuffled.
    """
    both = source.select(key, "word_id", F.lit(1).alias("s"), F.lit(0).alias("o")).unionAll(owned.select(key, "word_id", F.lit(0), F.lit(1)))
    n = both.groupBy(key, "word_id").agg(F.sum("s").alias("s"), F.sum("o").alias("o"))
    null = F.col("word_id").isNull()
    found = F.array_compact(F.array(
        F.when((F.col("o") == 0) & (F.col("s") > 0), "missing"), F.when((F.col("o") > 1) & (F.col("s") > 0) & ~null, "twice"), F.when((F.col("o") > 0) & ((F.col("s") == 0) | null), "foreign"), F.when(F.col("s") > 1, "repeated"),
    ))
    counted = n.select(key, "word_id", F.explode(found).alias("finding"))
    w = Window.partitionBy(key, "utterance").orderBy("n", "place").rowsBetween(Window.unboundedPreceding, -1)
    first = source.groupBy(key, "word_id").agg(F.min("place").alias("place"))
    late = owned.join(first, [key, "word_id"]).withColumn("before", F.max("place").over(w)).where("place < before")
    return counted.union(late.select(key, "word_id", F.lit("out_of_order")).distinct())


def cover_proofs(source: DataFrame, owned: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, n_source, n_owned, missing, twice, foreign, repeated, out_of_order, exact) of every recording of either side."""
    kinds = ["missing", "twice", "foreign", "repeated", "out_of_order"]
    n = source.groupBy(key).agg(F.count("*").alias("n_source")).join(owned.groupBy(key).agg(F.count("*").alias("n_owned")), key, "full")
    faults = word_faults(source, owned, key).groupBy(key).agg(*(F.count_if(F.col("finding") == k).alias(k) for k in kinds))
    out = n.join(faults, key, "left").na.fill(0, ["n_source", "n_owned", *kinds])
    bad: Column = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return out.withColumn("exact", (bad == 0) & (F.col("n_source") == F.col("n_owned")))


def lineage_faults(parts: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(key, part, column, expected, found) where a part's lineage differs from the first part's, or the first lacks the key.

    Values are compared as strings, null-safe; parts with several rows of a key are judged row by row.
    """
    names = list(parts)
    base = parts[names[0]].select(key, F.struct(*columns).alias("a"), F.lit(True).alias("known"))
    out = None
    for name in names[1:]:
        rows = parts[name].select(key, F.struct(*columns).alias("b")).join(base, key, "left")
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("expected"), F.col(f"b.{c}").cast("string").alias("found")) for c in columns]
        seen = rows.select(key, "known", F.explode(F.array(*cells)).alias("x")).select(key, "known", "x.*")
        bad = seen.where(F.col("known").isNull() | ~F.col("expected").eqNullSafe(F.col("found"))).select(key, F.lit(name).alias("part"), "column", "expected", "found").distinct()
        out = bad if out is None else out.union(bad)
    return out


def attributions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, target, candidates, label, degraded): who an utterance's spans say speaks.

    spans: keys, n (place), kind, identities, entries, reviewed and machine (arrays of labels). The first span's
    kind decides. A reviewed one with a single identity over all spans is bound, one of a machine goes to the
    first of its labels, several candidates are a conflict if two are stable; else it is `degraded` to unknown.
    The label joins people's labels, else machines'. Null arrays count as empty.
    """
    none = F.expr("cast(array() as array<string>)")

    def all_of(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none))))).alias(c)

    each = spans.groupBy(*keys).agg(F.min_by("kind", "n").alias("kind"), *(all_of(c) for c in ("identities", "entries", "reviewed", "machine")))
    one, machine = (F.col("kind") == REVIEWED) & (F.size("identities") == 1), (F.col("kind") == MACHINE) & (F.size("machine") > 0)
    several = F.col("kind").isin(*SEVERAL)
    candidates = F.array_distinct(F.concat("identities", "entries", "reviewed", "machine"))
    stable = several & (F.size(candidates) >= 2)
    status = F.when(one, BOUND).when(machine, CLUSTERED).when(stable, CONFLICTING).otherwise(UNKNOWN)
    target = F.when(one, F.get("identities", F.lit(0))).when(machine, F.get("machine", F.lit(0)))
    labels = F.when(F.size("reviewed") > 0, F.col("reviewed")).otherwise(F.col("machine"))
    label = F.when(F.size(labels) > 0, F.array_join(labels, " + ")).otherwise("UNKNOWN")
    return each.select(*keys, status.alias("status"), target.alias("target"), F.when(stable, candidates).otherwise(none).alias("candidates"), label.alias("label"), F.coalesce(several & ~stable, F.lit(False)).alias("degraded"))
