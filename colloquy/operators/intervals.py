"""Interval operators: union, coverage, overlap joins, elementary intervals, chunk plans.

All take half-open [start_us, end_us) rows with a key column and shuffle on the key once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, start_us, end_us, n): unions of overlapping and touching intervals; empty ones are left out."""
    order = Window.partitionBy(key).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where("end_us > start_us").withColumn("fresh", F.when(F.col("start_us") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("island")


def union_duration(df: DataFrame, key: str = "corpus_id") -> DataFrame:
    return merge_intervals(df, key).groupBy(key).agg(F.count("*").alias("islands"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


def coverage_multiplicity(df: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, multiplicity): the most intervals that hold one instant; ends count before starts."""
    steps = df.select(key, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))).alias("s")).select(key, "s.*")
    steps = steps.groupBy(key, "at", "d").agg(F.sum("d").alias("step"))
    level = F.sum("step").over(Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("level", level).groupBy(key).agg(F.max("level").cast("long").alias("multiplicity"))


def elementary_intervals(df: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, start_us, end_us, active): pieces between neighbouring ends, and how many intervals cover each."""
    steps = df.where("end_us > start_us").select(key, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))).alias("s")).select(key, "s.*")
    at = steps.groupBy(key, "at").agg(F.sum("d").alias("step"))
    w = Window.partitionBy(key).orderBy("at")
    pieces = at.select(key, F.col("at").alias("start_us"), F.lead("at").over(w).alias("end_us"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("active"))
    return pieces.where("end_us is not null")


def overlap_pairs(left: DataFrame, right: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """Inner join on key and a shared instant, by bins: an interval is dealt to each bin it touches.

    A pair is kept in the first bin that both touch, so none occurs twice. Columns get _l and _r; overlap_us
    is the length of the intersection.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start_us") / bin_us), F.floor((F.col("end_us") - 1) / bin_us))
        named = df.where("end_us > start_us").withColumn("bin", F.explode(bins))
        return named.select(key, "bin", *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c != key))

    pairs = binned(left, "l").join(binned(right, "r"), [key, "bin"]).where("start_us_l < end_us_r and start_us_r < end_us_l")
    latest = F.greatest("start_us_l", "start_us_r")
    return pairs.where(F.col("bin") == F.floor(latest / bin_us)).drop("bin").withColumn("overlap_us", F.least("end_us_l", "end_us_r") - latest)


def intersection_duration(left: DataFrame, right: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """(key, overlap_us): how long both sets' unions last together."""
    pairs = overlap_pairs(merge_intervals(left, key).drop("n"), merge_intervals(right, key).drop("n"), bin_us, key)
    return pairs.groupBy(key).agg(F.sum("overlap_us").alias("overlap_us"))


def activity_metrics(predicted: DataFrame, reference: DataFrame, bin_us: int, key: str = "corpus_id") -> DataFrame:
    """Durations of agreement, precision, recall and F1; null where a denominator is zero."""
    p = union_duration(predicted, key).select(key, F.col("total_us").alias("predicted_us"))
    r = union_duration(reference, key).select(key, F.col("total_us").alias("reference_us"))
    both = p.join(r, key, "full").join(intersection_duration(predicted, reference, bin_us, key), key, "left").na.fill(0, ["predicted_us", "reference_us", "overlap_us"])
    tp = F.col("overlap_us")
    return both.select(
        key, tp.alias("tp_us"), (F.col("predicted_us") - tp).alias("fp_us"), (F.col("reference_us") - tp).alias("fn_us"),
        F.round(F.try_divide(tp, "predicted_us"), 9).alias("precision"), F.round(F.try_divide(tp, "reference_us"), 9).alias("recall"), F.round(F.try_divide(2 * tp, F.col("predicted_us") + F.col("reference_us")), 9).alias("f1"),
    )


def chunk_plan(spark: SparkSession, duration_us: int, target_us: int, overlap_us: int) -> DataFrame:
    """(ordinal, start_us, end_us, own_start_us, own_end_us, terminal_short): overlapping chunks that own disjoint parts."""
    if not 0 <= overlap_us < target_us or duration_us <= 0:
        raise ValueError("need 0 <= overlap < target and a positive duration")
    step = target_us - overlap_us
    n = max(1, -(-(duration_us - overlap_us) // step))
    start = F.col("ordinal") * step
    end = F.least(start + target_us, F.lit(duration_us))
    last = F.col("ordinal") == n - 1
    half = overlap_us // 2
    rows = spark.range(n).withColumnRenamed("id", "ordinal")
    return rows.select("ordinal", start.alias("start_us"), end.alias("end_us"), F.when(F.col("ordinal") == 0, F.lit(0)).otherwise(start + half).cast("long").alias("own_start_us"), F.when(last, F.lit(duration_us)).otherwise(start + step + half).cast("long").alias("own_end_us"), (last & (end - start < target_us)).alias("terminal_short"))


def owned_by(points: DataFrame, at: str, duration_us: int, target_us: int, overlap_us: int) -> DataFrame:
    """Points with the ordinal of the chunk of chunk_plan that owns them, by division; points outside the recording go."""
    step = target_us - overlap_us
    last = max(1, -(-(duration_us - overlap_us) // step)) - 1
    ordinal = F.least(F.greatest(F.floor((F.col(at) - overlap_us // 2) / step), F.lit(0)), F.lit(last)).cast("long")
    return points.where((F.col(at) >= 0) & (F.col(at) < duration_us)).withColumn("ordinal", ordinal)


def map_interval(df: DataFrame, offset_us: int, low_us: int, high_us: int, breaks: tuple[int, ...] = ()) -> DataFrame:
    """Source time from corpus time by one offset: exact, clipped to the bounds, discontinuous or unavailable.

    An interval with one of the recording's few `breaks` inside is discontinuous, clipped or not.
    """
    s, e = F.col("start_us") + offset_us, F.col("end_us") + offset_us
    broken = F.exists(F.array(*map(F.lit, breaks)), lambda b: (b > s) & (b < e)) if breaks else F.lit(False)
    status = F.when((e <= low_us) | (s >= high_us), "unavailable").when(broken, "discontinuous").when((s < low_us) | (e > high_us), "clipped").otherwise("exact")
    out = df.withColumn("mapping", status)
    gone = F.col("mapping") == "unavailable"
    return out.withColumn("source_start_us", F.when(~gone, F.greatest(s, F.lit(low_us)))).withColumn("source_end_us", F.when(~gone, F.least(e, F.lit(high_us))))
