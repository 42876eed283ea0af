"""Graphs of evidence: groups of overlapping rows, lanes, and what lies downstream in a stage graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overlap_groups(df: DataFrame, key: str = "corpus_id", tie: str = "pos") -> DataFrame:
    """Rows with `group_no` and `lane`: on a line, components of overlap are islands, so windows suffice."""
    order = Window.partitionBy(key).orderBy("start_us", tie)
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_us") < reach, 0).otherwise(1)
    rows = df.withColumn("fresh", fresh).withColumn("group_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh")
    lane = F.row_number().over(Window.partitionBy(key, "group_no").orderBy("start_us", tie)) - 1
    return rows.withColumn("lane", lane)


#: The stages of the discourse recovery graph and those that depend on each directly.
STAGES = {
    "deterministic_classification": ("evidence_span_normalization",),
    "provider_analysis": ("evidence_span_normalization",),
    "evidence_span_normalization": ("candidate_consolidation",),
    "candidate_consolidation": ("question_construction", "objection_rebuttal_linking", "definition_example", "procedural_state", "review_assembly", "correction_propagation"),
    "question_construction": ("answer_linking",),
    "answer_linking": ("controlled_evaluation", "corpus_export"),
    "objection_rebuttal_linking": ("concession_qualification",),
    "concession_qualification": ("controlled_evaluation", "corpus_export"),
    "definition_example": ("controlled_evaluation", "corpus_export"),
    "procedural_state": ("controlled_evaluation", "corpus_export"),
    "review_assembly": ("controlled_evaluation", "corpus_export"),
    "correction_propagation": ("controlled_evaluation", "corpus_export"),
    "controlled_evaluation": ("corpus_export",),
}


def downstream(spark: SparkSession, edges: DataFrame | None = None) -> DataFrame:
    """(stage, affected): every stage with all that depends on it, by a recursive query."""
    e = edges if edges is not None else spark.createDataFrame([(a, b) for a, after in STAGES.items() for b in after], "src string, dst string")
    return spark.sql(
        """
        WITH RECURSIVE r(stage, affected) AS (
            SELECT src, dst FROM {e}
            UNION ALL SELECT r.stage, e.dst FROM r JOIN {e} e ON r.affected = e.src
        ) SELECT DISTINCT stage, affected FROM r""",
        e=e,
    )
