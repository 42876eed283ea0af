"""Reports of metrics against a controlled reference: numerator, denominator, value, or why there is none.

All metrics of one table come from one aggregation over it; tables are joined on their keys first, so no report
runs through a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.metrics import ratio

#: Metrics of an act family, by whether its type or its targets must agree.
TYPE_ACCURACY = {"question_type_accuracy": "question", "concession_scope_accuracy": "concession", "qualification_scope_accuracy": "qualification", "definition_span_accuracy": "definition", "quotation_use_accuracy": "quotation_and_attribution", "procedural_act_accuracy": "procedural", "unknown_state_appropriateness": "unknown"}
TARGET_ACCURACY = {"answer_link_accuracy": "answer", "objection_target_accuracy": "objection", "rebuttal_target_accuracy": "rebuttal", "example_target_accuracy": "example"}


def metric_rows(df: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, numerator, denominator, value, not_applicable) of sums over `df`, a row a metric, in one pass.

    A value is null, and not applicable, where the denominator is zero: also over an empty table.
    """
    sums = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"{side}{i}") for i, pair in enumerate(metrics.values()) for side, c in zip("nd", pair, strict=True)]
    one = df.agg(*sums)
    cells = [F.struct(F.lit(name).alias("metric"), F.round(f"n{i}", 9).alias("numerator"), F.col(f"d{i}").alias("denominator")) for i, name in enumerate(metrics)]
    rows = one.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return rows.withColumn("value", ratio(F.col("numerator"), F.col("denominator"))).withColumn("not_applicable", F.col("denominator") == 0)


def _prf(reference: DataFrame, system: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Precision, recall and F1 of labels as multisets by utterance."""
    both = reference.groupBy(*keys, label).agg(F.count("*").alias("r")).join(system.groupBy(*keys, label).agg(F.count("*").alias("s")), [*keys, label], "full").na.fill(0, ["r", "s"])
    hit, r, s = F.least("r", "s"), F.col("r"), F.col("s")
    return metric_rows(both, {f"{name}_precision": (hit, s), f"{name}_recall": (hit, r), f"{name}_f1": (2 * hit, r + s)})


def discourse_report(reference: DataFrame, system: DataFrame, candidates: DataFrame, keys: list[str], spans: DataFrame, span_counts: DataFrame, observed: DataFrame, invalidated: DataFrame, preserved: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The 28 metrics of discourse acts.

    reference: keys, family, type, targets and alternatives (arrays), affected and review (booleans); system: keys,
    act_id, family, type, targets, confidence; candidates: keys, type; spans: iou of one-to-one matched spans;
    span_counts: one row (n_reference, n_system); observed and reviewed: keys of utterances with invalidated acts,
    and with review actions; invalidated and preserved: act_id. A target agrees if the set that acts of
    the reference's type name is the reference's; alternatives count if a candidate of that type was kept.
    """
    none = F.expr("cast(array() as array<string>)")

    def as_set(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(c, none)))

    parts = [_prf(reference, system, keys, "family", "act_family"), _prf(reference, system, keys, "type", "act_type")]
    labels = reference.groupBy(*keys).agg(F.collect_set("type").alias("r")).join(system.groupBy(*keys).agg(F.collect_set("type").alias("s")), keys, "full")
    r, s = as_set(F.col("r")), as_set(F.col("s"))
    union = F.size(F.array_union(r, s))
    shared = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(r, s)) / union)
    parts.append(metric_rows(labels, {"multi_label_exact_match": ((r == s).cast("int"), F.lit(1)), "multi_label_partial_match": (shared, F.lit(1))}))
    n = spans.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou")).join(span_counts.select("n_reference", "n_system"))  # one row each
    parts.append(metric_rows(n, {"evidence_span_precision": (F.col("pairs"), F.col("n_system")), "evidence_span_recall": (F.col("pairs"), F.col("n_reference")), "evidence_span_overlap": (F.col("iou"), F.col("pairs"))}))
    said = system.groupBy(*keys, "type").agg(F.flatten(F.collect_list(F.coalesce("targets", none))).alias("named"), F.lit(True).alias("there"))
    rows = reference.join(said, [*keys, "type"], "left").withColumns({"there": F.coalesce("there", F.lit(False)), "agree": as_set(F.col("named")) == as_set(F.col("targets")), "asked": F.size(F.coalesce("targets", none)) > 0})
    one, family = F.lit(1), F.col("family")

    def count(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    accuracies = {"relation_target_accuracy": (count(F.col("asked") & F.col("agree")), count(F.col("asked")))}
    accuracies |= {m: (count((family == f) & F.col("there")), count(family == f)) for m, f in TYPE_ACCURACY.items()}
    accuracies |= {m: (count((family == f) & F.col("asked") & F.col("agree")), count((family == f) & F.col("asked"))) for m, f in TARGET_ACCURACY.items()}
    parts.append(metric_rows(rows, accuracies))
    kept = candidates.select(*keys, F.col("type").alias("alternative"), F.lit(True).alias("kept")).distinct()
    alternatives = reference.select(*keys, F.explode("alternatives").alias("alternative")).join(kept, [*keys, "alternative"], "left")
    parts.append(metric_rows(alternatives, {"alternative_candidate_recall": (count(F.col("kept")), one)}))
    right = system.where("confidence is not null").join(reference.select(*keys, "type", F.lit(1.0).alias("right")).distinct(), [*keys, "type"], "left")
    parts.append(metric_rows(right, {"confidence_reliability": (1 - F.abs(F.col("confidence") - F.coalesce("right", F.lit(0.0))), one)}))

    def found(expected: str, seen: DataFrame, name: str) -> DataFrame:
        of = reference.where(expected).select(*keys).distinct().join(seen.select(*keys, F.lit(True).alias("seen")).distinct(), keys, "left")
        return metric_rows(of, {name: (count(F.col("seen")), one)})

    parts.append(found("affected", observed, "correction_propagation_completeness"))
    acts = system.select("act_id").join(invalidated.select("act_id").distinct(), "act_id", "left_anti").join(preserved.select("act_id", F.lit(True).alias("seen")).distinct(), "act_id", "left")
    parts.append(metric_rows(acts, {"unaffected_artifact_stability": (count(F.col("seen")), one)}))
    parts.append(found("review", reviewed, "human_review_impact"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def utterance_report(matched: DataFrame, interruptions: tuple[DataFrame, DataFrame], continuations: tuple[DataFrame, DataFrame], boundaries: DataFrame, agreement: DataFrame, windows: DataFrame) -> DataFrame:
    """The 20 metrics of utterances.

    matched: a row a matched pair, with status, target, completeness, overlap, self_repair, quoted, quotation, quoted_speaker,
    affected, stable and review of the reference (r_) and of the system (s_); interruptions and continuations: (reference,
    system) rows (left, right) of utterances, the reference's mapped; boundaries: one row (n_reference, n_system, matched,
    error_us); agreement: one row (agreeing, pairs) of word pairs; windows: a row a window, reproduced, truncated and
    excluded (booleans). Statuses and completeness are compared null-safe; quotations count where the reference has one.
    """
    one = F.lit(1)

    def count(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    def same(c: str) -> Column:
        return F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}"))

    def of(test: Column, agree: Column) -> tuple[Column, Column]:
        return count(test & agree), count(test)

    true = F.lit(True)
    has = F.col("r_quotation").isNotNull()
    parts = [
        metric_rows(boundaries, {"utterance_boundary_precision": (F.col("matched"), F.col("n_system")), "utterance_boundary_recall": (F.col("matched"), F.col("n_reference")), "boundary_timing_error_microseconds": (F.col("error_us"), F.col("matched"))}),
        metric_rows(agreement, {"utterance_segmentation_similarity": (F.col("agreeing"), F.col("pairs"))}),
        metric_rows(matched, {
            "speaker_attribution_accuracy": of(true, same("status") & same("target")), "unknown_attribution_appropriateness": of(F.col("r_status") == "unknown", same("status")),
            "incomplete_utterance_classification_accuracy": of(F.coalesce(F.col("r_completeness") != "complete", F.lit(False)), same("completeness")), "overlap_preservation_accuracy": of(true, same("overlap")), "self_repair_detection_accuracy": of(true, same("self_repair")),
            "quotation_span_accuracy": of(has, same("quoted")), "quotation_type_accuracy": of(has, same("quotation")), "quoted_speaker_attribution_accuracy": of(has & F.col("r_quoted_speaker").isNotNull(), same("quoted_speaker")),
            "correction_propagation_completeness": of(F.col("r_affected"), F.col("s_affected")), "unaffected_artifact_stability": of(~F.col("r_affected"), F.col("s_stable")), "manual_review_impact": of(F.col("r_review"), F.col("s_review")),
        }),
        metric_rows(windows, {"context_window_reproducibility": (count(F.col("reproduced")), one), "context_truncation_correctness": (count(F.col("truncated").eqNullSafe(F.col("excluded"))), one)}),
    ]
    for name, (reference, system) in (("interruption_detection", interruptions), ("continuation_link", continuations)):
        r, s = (df.select("left", "right", F.lit(1).alias(side)).distinct() for df, side in ((reference, "r"), (system, "s")))
        both = r.join(s, ["left", "right"], "full").na.fill(0, ["r", "s"])
        hit = F.col("r") * F.col("s")
        parts.append(metric_rows(both, {f"{name}_precision": (hit, F.col("s")), f"{name}_recall": (hit, F.col("r"))} if name == "interruption_detection" else {f"{name}_accuracy": (hit, F.col("r"))}))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
