"""Evaluation metrics as aggregations; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 9)


def pair_confusion(df: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """Pairwise clustering agreement from the contingency table: no pair is formed."""
    cells = df.groupBy(reference, predicted).agg(F.count("*").alias("n"))

    def pairs(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("long")

    both = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    rows = cells.groupBy(reference).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("r"), F.sum("n").alias("items"))
    cols = cells.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("p"))
    tp, r, p = F.col("tp"), F.col("r"), F.col("p")
    total = pairs(F.col("items"))
    one = both.join(rows).join(cols)  # one row each
    return one.select("tp", (p - tp).alias("fp"), (r - tp).alias("fn"), (total - p - r + tp).alias("tn"), ratio(tp, p).alias("precision"), ratio(tp, r).alias("recall"), ratio(2 * tp, p + r).alias("f1"), ratio(total - p - r + 2 * tp, total).alias("rand_index"))


def label_scores(df: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """Per label: true and false positives, false negatives, precision, recall, F1 (0 if either is null)."""
    sides = df.select(F.explode(F.array(F.struct(F.col(reference).alias("label"), F.lit("r").alias("side"), (F.col(reference) == F.col(predicted)).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side"), (F.col(reference) == F.col(predicted)).alias("hit")))).alias("s")).select("s.*").where("label is not null")
    hit = F.coalesce("hit", F.lit(False))
    n = sides.groupBy("label").agg(F.sum(((F.col("side") == "r") & hit).cast("long")).alias("tp"), F.sum(((F.col("side") == "p") & ~hit).cast("long")).alias("fp"), F.sum(((F.col("side") == "r") & ~hit).cast("long")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def set_jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def reliability_bins(df: DataFrame, claimed: str, correct: str, bins: int = 5) -> DataFrame:
    """Claimed confidence against accuracy: lower edges inclusive, the last bin's upper edge too."""
    number = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        number = F.when(F.col(claimed) * bins < k + 1, k).otherwise(number)
    rows = df.where(F.col(claimed).isNotNull() & F.col(correct).isNotNull()).withColumn("bin", number.cast("long"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(claimed), 9).alias("mean_claimed"), F.round(F.avg(F.col(correct).cast("double")), 9).alias("mean_correct"))


def char_error_rate(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    d = F.levenshtein(F.col(reference), F.col(hypothesis)).cast("long")
    return df.withColumn("distance", d).withColumn("cer", ratio(d, F.length(reference)))


def timing_errors(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Per keys: rows, rows without a partner, and mean, median and longest error of the others."""
    rows = df.select(*keys, error.alias("e"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") - F.count("e")).alias("unmatched"), F.round(F.avg("e"), 3).alias("mean_us"), F.median("e").alias("median_us"), F.max("e").alias("longest_us"))


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], of_a: str, of_b: str) -> DataFrame:
    """(keys, of_a, of_b): rows of two sides by their place in order, as far as the shorter goes."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return a.select(*keys, of_a, rank.alias("k")).join(b.select(*keys, of_b, rank.alias("k")), [*keys, "k"]).drop("k")


def multiset_scores(reference: DataFrame, system: DataFrame, item: str, label: str) -> DataFrame:
    """Per label: agreement of the two sides' counts of it on each item."""
    r = reference.groupBy(item, label).agg(F.count("*").alias("r"))
    p = system.groupBy(item, label).agg(F.count("*").alias("p"))
    n = r.join(p, [item, label], "full").na.fill(0, ["r", "p"]).groupBy(label).agg(F.sum(F.least("r", "p")).alias("tp"), F.sum("p").alias("n_p"), F.sum("r").alias("n_r"))
    tp, n_p, n_r = F.col("tp"), F.col("n_p"), F.col("n_r")
    return n.select(label, "tp", (n_p - tp).alias("fp"), (n_r - tp).alias("fn"), ratio(tp, n_p).alias("precision"), ratio(tp, n_r).alias("recall"), ratio(2 * tp, n_p + n_r).alias("f1"))


def set_agreement(reference: DataFrame, system: DataFrame, item: str, label: str) -> DataFrame:
    """Items on both sides, those with equal label sets, and the mean Jaccard similarity of the sets."""
    r = reference.groupBy(item).agg(F.collect_set(label).alias("r"))
    p = system.groupBy(item).agg(F.collect_set(label).alias("p"))
    both = r.join(p, item).select(set_jaccard(F.col("r"), F.col("p")).alias("j"))
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("j") == 1).cast("long")), F.lit(0)).alias("exact"), F.round(F.avg("j"), 9).alias("mean_jaccard"))


def confidence_bands(df: DataFrame, score: str) -> DataFrame:
    """(band, n): low < 0.5 <= medium < 0.8 <= high, and unavailable; every band has a row."""
    s = F.col(score)
    bands = {"low": s < 0.5, "medium": (s >= 0.5) & (s < 0.8), "high": s >= 0.8, "unavailable": s.isNull()}
    counts = df.agg(*(F.count_if(c).alias(b) for b, c in bands.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in bands))).alias("r")).select("r.*")


def activity_class(score: Column) -> Column:
    return F.when(score >= 0.65, "speech").when(score <= 0.35, "non_speech").otherwise("uncertain")


def text_confidence(mean_log_probability: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(mean_log_probability)))


def region_severity(confidence: Column, least: float) -> Column:
    """What a reader should look at: warning under the threshold, information where there is no confidence, else null."""
    return F.when(confidence.isNull(), "information").when(confidence < least, "warning")


def activity_summary(df: DataFrame, key: str = "corpus_id", label: str = "label") -> DataFrame:
    """Per key and label: intervals, their summed time, and its share of the key's."""
    n = df.groupBy(key, label).agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))
    return n.withColumn("share", ratio(F.col("total_us"), F.sum("total_us").over(Window.partitionBy(key))))
