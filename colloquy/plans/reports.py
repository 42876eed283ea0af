"""Queries that evaluate: reports of discourse and utterance metrics, diarization error after the best mapping.

References are conversations and events as they are; systems hear them otherwise, by what they hold.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from colloquy.operators import evaluation, matching
from colloquy.plans.discussion import COLLAR_US, _unions, error_sql
from colloquy.plans.queries import BIN_US, query
from colloquy.sources import tables
from colloquy.sources.tables import EV, U

KEYS = ["corpus_id", "pos"]
FAMILIES = ["question", "answer", "objection", "rebuttal", "concession", "qualification", "definition", "example", "quotation_and_attribution", "procedural", "unknown"]
#: An act is a sentence of n characters; its family follows from n. The system errs where sentences are short, and misses some.
FAMILY = "CASE n % 11 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILIES)) + " END"
TYPE = "CASE WHEN n > 60 THEN concat(family, '.long') ELSE concat(family, '.short') END"


def acts(spark, d):
    u = tables.utterances(spark, d)
    cut = u.select(*KEYS, F.posexplode(F.expr("regexp_extract_all(text, '[^.\\n]+', 0)")).alias("k", "raw")).select(*KEYS, "k", F.trim("raw").alias("text")).where("text <> ''").withColumn("n", F.length("text"))
    rows = cut.withColumn("family", F.expr(FAMILY)).withColumn("type", F.expr(TYPE)).withColumn("comma", F.col("text").like("%,%"))
    return rows.withColumn("act_id", F.concat_ws("/", *KEYS, F.col("k").cast("string")))


_ACTS = f"""{U}, cu AS (SELECT corpus_id, pos, k - 1 AS k, trim(raw[k]) AS text FROM (SELECT corpus_id, pos, raw, unnest(range(1, len(raw) + 1)) AS k FROM (SELECT corpus_id, pos, regexp_extract_all(text, '[^.\\n]+') AS raw FROM ut))),
r0 AS (SELECT *, {FAMILY} AS family FROM (SELECT *, length(text) AS n, text LIKE '%,%' AS comma FROM cu WHERE text <> '')), rf AS (SELECT *, {TYPE} AS type FROM r0),
sy AS (SELECT *, CASE WHEN n < 25 THEN family || '.other' ELSE type END AS stype, CASE WHEN comma THEN CASE WHEN n % 2 = 0 THEN pos - 1 ELSE pos - 2 END END AS starget FROM rf WHERE n NOT BETWEEN 30 AND 32)"""


def _prf_sql(name: str, label: str, slabel: str) -> str:
    of = f"(SELECT sum(least(coalesce(r, 0), coalesce(s, 0))) AS hit, sum(coalesce(r, 0)) AS r, sum(coalesce(s, 0)) AS s FROM (SELECT corpus_id, pos, {label} AS l, count(*) AS r FROM rf GROUP BY ALL) FULL JOIN (SELECT corpus_id, pos, {slabel} AS l, count(*) AS s FROM sy GROUP BY ALL) USING (corpus_id, pos, l))"
    return f"SELECT '{name}_precision' AS metric, hit AS a, s AS b FROM {of} UNION ALL SELECT '{name}_recall', hit, r FROM {of} UNION ALL SELECT '{name}_f1', 2 * hit, r + s FROM {of}"


_TYPED = " UNION ALL ".join(f"SELECT '{m}', count(*) FILTER (WHERE there), count(*) FROM j WHERE family = '{f}'" for m, f in evaluation.TYPE_ACCURACY.items())
_AIMED = " UNION ALL ".join(f"SELECT '{m}', count(*) FILTER (WHERE agree), count(*) FROM j WHERE family = '{f}' AND comma" for m, f in evaluation.TARGET_ACCURACY.items())


@query(f"""WITH {_ACTS}, lb AS (SELECT list_distinct(coalesce(r, [])) AS r, list_distinct(coalesce(s, [])) AS s FROM (SELECT corpus_id, pos, list(type) AS r FROM rf GROUP BY ALL) FULL JOIN (SELECT corpus_id, pos, list(stype) AS s FROM sy GROUP BY ALL) USING (corpus_id, pos)),
sd AS (SELECT corpus_id, pos, stype AS type, list_sort(list_distinct(list(starget) FILTER (WHERE starget IS NOT NULL))) AS named FROM sy GROUP BY ALL), j AS (SELECT rf.*, sd.type IS NOT NULL AS there, coalesce(named = [rf.pos - 1], false) AS agree FROM rf LEFT JOIN sd USING (corpus_id, pos, type)),
m AS ({_prf_sql('act_family', 'family', 'family')} UNION ALL {_prf_sql('act_type', 'type', 'stype')}
UNION ALL SELECT 'multi_label_exact_match', count(*) FILTER (WHERE list_sort(r) = list_sort(s)), count(*) FROM lb UNION ALL SELECT 'multi_label_partial_match', sum(len(list_intersect(r, s)) / (len(r) + len(s) - len(list_intersect(r, s)))), count(*) FROM lb
UNION ALL SELECT 'evidence_span_precision', count(*) FILTER (WHERE n > 40), count(*) FROM sy UNION ALL SELECT 'evidence_span_recall', (SELECT count(*) FROM sy WHERE n > 40), count(*) FROM rf UNION ALL SELECT 'evidence_span_overlap', sum((n - 1) / n), count(*) FROM sy WHERE n > 40
UNION ALL SELECT 'relation_target_accuracy', count(*) FILTER (WHERE agree), count(*) FROM j WHERE comma UNION ALL {_TYPED} UNION ALL {_AIMED}
UNION ALL SELECT 'alternative_candidate_recall', count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sy WHERE sy.corpus_id = rf.corpus_id AND sy.pos = rf.pos AND sy.stype = rf.family || '.other')), count(*) FROM rf WHERE n < 40
UNION ALL SELECT 'confidence_reliability', sum(1 - abs(n % 10 / 10.0 - CASE WHEN EXISTS (SELECT 1 FROM rf WHERE rf.corpus_id = sy.corpus_id AND rf.pos = sy.pos AND rf.type = sy.stype) THEN 1 ELSE 0 END)), count(*) FROM sy WHERE n % 10 <> 0
UNION ALL SELECT 'correction_propagation_completeness', count(DISTINCT corpus_id || '/' || pos) FILTER (WHERE seen), count(DISTINCT corpus_id || '/' || pos) FROM (SELECT *, EXISTS (SELECT 1 FROM sy WHERE sy.corpus_id = rf.corpus_id AND sy.pos = rf.pos AND sy.n > 100) AS seen FROM rf WHERE n > 90)
UNION ALL SELECT 'unaffected_artifact_stability', count(*) FILTER (WHERE n > 20), count(*) FROM sy WHERE n <= 100
UNION ALL SELECT 'human_review_impact', count(DISTINCT corpus_id || '/' || pos) FILTER (WHERE seen), count(DISTINCT corpus_id || '/' || pos) FROM (SELECT *, EXISTS (SELECT 1 FROM sy WHERE sy.corpus_id = rf.corpus_id AND sy.pos = rf.pos AND sy.comma) AS seen FROM rf WHERE n < 15))
SELECT metric, round(CAST(coalesce(a, 0) AS DOUBLE), 9) AS numerator, CAST(coalesce(b, 0) AS DOUBLE) AS denominator, round(CAST(coalesce(a, 0) AS DOUBLE) / nullif(CAST(coalesce(b, 0) AS DOUBLE), 0), 9) AS value, coalesce(b, 0) = 0 AS not_applicable FROM m""")
def discourse_metrics(spark, d):
    """All 28 metrics of discourse acts."""
    r = acts(spark, d)
    s = r.where("n not between 30 and 32").withColumns({"type": F.when(F.col("n") < 25, F.concat("family", F.lit(".other"))).otherwise(F.col("type")), "targets": F.when(F.col("comma"), F.array(F.when(F.col("n") % 2 == 0, F.col("pos") - 1).otherwise(F.col("pos") - 2).cast("string"))), "confidence": F.when(F.col("n") % 10 != 0, (F.col("n") % 10 / 10.0).cast("double"))})
    r = r.withColumns({"targets": F.when(F.col("comma"), F.array((F.col("pos") - 1).cast("string"))), "alternatives": F.when(F.col("n") < 40, F.array(F.concat("family", F.lit(".other")))), "affected": F.col("n") > 90, "review": F.col("n") < 15})
    counts = r.agg(F.count("*").alias("n_reference")).join(s.agg(F.count("*").alias("n_system")))
    spans = s.where("n > 40").select(((F.col("n") - 1) / F.col("n")).alias("iou"))
    return evaluation.discourse_report(r, s, s.select(*KEYS, "type"), KEYS, spans, counts, s.where("n > 100"), s.where("n > 100"), s.where("n between 21 and 100"), s.where("comma"))


_SAME = "count(*) FILTER (WHERE {}), count(*)"


@query(f"""WITH {U}, x AS (SELECT *, length(text) AS n, lead(pos) OVER w AS np, lead(start_us) OVER w AS ns FROM ut WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos)),
p AS (SELECT *, CASE WHEN n < 60 THEN 'unknown' ELSE 'bound' END AS rs, CASE WHEN n < 80 THEN 'unknown' ELSE 'bound' END AS ss, CASE WHEN text LIKE '%.' THEN 'complete' ELSE 'fragment' END AS rc, CASE WHEN text LIKE '%e.' THEN 'complete' ELSE 'fragment' END AS sc, coalesce(ns < end_us, false) AS ro, coalesce(ns < end_us - 300000, false) AS so FROM x),
ir AS (SELECT corpus_id, pos, np, n FROM p WHERE ro), m AS (
SELECT 'utterance_boundary_precision' AS metric, CAST(count(*) FILTER (WHERE n > 50) AS DOUBLE) AS a, count(*) AS b FROM p UNION ALL SELECT 'utterance_boundary_recall', count(*) FILTER (WHERE n > 50), count(*) + 10 FROM p UNION ALL SELECT 'boundary_timing_error_microseconds', sum(n) FILTER (WHERE n > 50), count(*) FILTER (WHERE n > 50) FROM p
UNION ALL SELECT 'utterance_segmentation_similarity', sum(n), sum(n + 1) FROM p UNION ALL SELECT 'speaker_attribution_accuracy', {_SAME.format('rs = ss')} FROM p UNION ALL SELECT 'unknown_attribution_appropriateness', {_SAME.format('rs = ss')} FROM p WHERE rs = 'unknown'
UNION ALL SELECT 'incomplete_utterance_classification_accuracy', {_SAME.format('rc = sc')} FROM p WHERE rc <> 'complete' UNION ALL SELECT 'overlap_preservation_accuracy', {_SAME.format('ro = so')} FROM p UNION ALL SELECT 'self_repair_detection_accuracy', {_SAME.format('(n % 2 = 0) = (n % 4 = 0)')} FROM p
UNION ALL SELECT 'quotation_span_accuracy', {_SAME.format('n > 300')} FROM p WHERE text LIKE '%,%' UNION ALL SELECT 'quotation_type_accuracy', {_SAME.format('n <= 900')} FROM p WHERE text LIKE '%,%' UNION ALL SELECT 'quoted_speaker_attribution_accuracy', {_SAME.format('n <= 500')} FROM p WHERE text LIKE '%,%' AND speaker = 'user'
UNION ALL SELECT 'correction_propagation_completeness', {_SAME.format('n < 90')} FROM p WHERE n < 120 UNION ALL SELECT 'unaffected_artifact_stability', {_SAME.format('n > 150')} FROM p WHERE n >= 120 UNION ALL SELECT 'manual_review_impact', {_SAME.format('n < 30')} FROM p WHERE n < 40
UNION ALL SELECT 'context_window_reproducibility', {_SAME.format('n > 20')} FROM p UNION ALL SELECT 'context_truncation_correctness', {_SAME.format('(n > 900) = (n > 1000)')} FROM p
UNION ALL SELECT 'interruption_detection_precision', count(*) FILTER (WHERE n > 100), count(*) FILTER (WHERE n > 100) FROM ir UNION ALL SELECT 'interruption_detection_recall', count(*) FILTER (WHERE n > 100), count(*) FROM ir
UNION ALL SELECT 'continuation_link_accuracy', count(*) FILTER (WHERE n < 200), count(*) FROM ir)
SELECT metric, round(CAST(coalesce(a, 0) AS DOUBLE), 9) AS numerator, CAST(coalesce(b, 0) AS DOUBLE) AS denominator, round(CAST(coalesce(a, 0) AS DOUBLE) / nullif(CAST(coalesce(b, 0) AS DOUBLE), 0), 9) AS value, coalesce(b, 0) = 0 AS not_applicable FROM m""")
def utterance_metrics(spark, d):
    """All 20 metrics of utterances."""
    from pyspark.sql import Window

    w = Window.partitionBy("corpus_id").orderBy("start_us", "pos")
    x = tables.utterances(spark, d).withColumns({"n": F.length("text"), "np": F.lead("pos").over(w), "ns": F.lead("start_us").over(w)})
    e = lambda **c: x.selectExpr("*", *(f"{v} AS {k}" for k, v in c.items()))
    p = e(
        r_status="CASE WHEN n < 60 THEN 'unknown' ELSE 'bound' END", s_status="CASE WHEN n < 80 THEN 'unknown' ELSE 'bound' END", r_target="cast(null as string)", s_target="cast(null as string)",
        r_completeness="CASE WHEN text LIKE '%.' THEN 'complete' ELSE 'fragment' END", s_completeness="CASE WHEN text LIKE '%e.' THEN 'complete' ELSE 'fragment' END", r_overlap="coalesce(ns < end_us, false)", s_overlap="coalesce(ns < end_us - 300000, false)",
        r_self_repair="n % 2 = 0", s_self_repair="n % 4 = 0", r_quotation="CASE WHEN text LIKE '%,%' THEN 'direct' END", s_quotation="CASE WHEN n <= 900 THEN 'direct' END", r_quoted="text", s_quoted="CASE WHEN n > 300 THEN text END",
        r_quoted_speaker="CASE WHEN speaker = 'user' THEN 'x' END", s_quoted_speaker="CASE WHEN n <= 500 THEN 'x' END", r_affected="n < 120", s_affected="n < 90", s_stable="n > 150", r_review="n < 40", s_review="n < 30",
    )
    links = p.where("r_overlap").select(F.concat_ws("/", *KEYS).alias("left"), F.concat_ws("/", "corpus_id", "np").alias("right"), "n")
    bounds = p.agg((F.count("*") + 10).alias("n_reference"), F.count("*").alias("n_system"), F.count_if(F.col("n") > 50).alias("matched"), F.sum(F.when(F.col("n") > 50, F.col("n"))).alias("error_us"))
    agree = p.agg(F.sum("n").alias("agreeing"), F.sum(F.col("n") + 1).alias("pairs"))
    windows = p.selectExpr("n > 20 AS reproduced", "n > 900 AS truncated", "n > 1000 AS excluded")
    return evaluation.utterance_report(p, (links, links.where("n > 100")), (links, links.where("n < 200")), bounds, agree, windows)


#: The system hears two hours late and calls each type by the name of the next, in a circle; long events by the one after.
LABELS, LATE_US = ["click", "error", "purchase", "signup", "view"], 7_200_000_000
_NEXT = "CASE label " + " ".join(f"WHEN '{a}' THEN CASE WHEN end_us - start_us > 7200000000 THEN '{LABELS[(i + 2) % 5]}' ELSE '{LABELS[(i + 1) % 5]}' END" for i, a in enumerate(LABELS)) + " END"


def speakers(spark, d):
    ev = tables.intervals(spark, d)
    return ev, ev.select("corpus_id", "interval_id", F.expr(_NEXT).alias("label"), (F.col("start_us") + LATE_US).alias("start_us"), (F.col("end_us") + LATE_US).alias("end_us"))


_PERMUTED = ", ".join(f"({k}, '{s}', '{r}')" for k, p in enumerate(permutations(LABELS)) for s, r in zip(LABELS, p, strict=True))
_MAPPED = f"""{EV}, rr AS (SELECT corpus_id, interval_id, label, start_us, end_us FROM ev), sx AS (SELECT corpus_id, interval_id, {_NEXT} AS label, start_us + {LATE_US} AS start_us, end_us + {LATE_US} AS end_us FROM ev),
{_unions('rx', 'rr')}, {_unions('sz', 'sx')}, cw AS (SELECT sz.corpus_id, sz.label AS system, rx.label AS reference, CAST(sum(least(sz.e, rx.e) - greatest(sz.s, rx.s)) AS BIGINT) AS weight_us FROM sz JOIN rx ON sz.corpus_id = rx.corpus_id AND sz.s < rx.e AND rx.s < sz.e GROUP BY ALL),
pm(k, system, reference) AS (VALUES {_PERMUTED}), pt AS (SELECT corpus_id, k, sum(weight_us) AS w, string_agg(system || '>' || reference, ',' ORDER BY system) AS pairs FROM cw JOIN pm USING (system, reference) WHERE weight_us > 0 GROUP BY ALL),
be AS (SELECT corpus_id, k FROM pt QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY w DESC, pairs, k) = 1), mp AS (SELECT corpus_id, system, reference, weight_us FROM be JOIN pm USING (k) JOIN cw USING (corpus_id, system, reference)),
sm AS (SELECT sx.corpus_id, interval_id, coalesce(mp.reference, 'unmapped: ' || label) AS label, start_us, end_us FROM sx LEFT JOIN mp ON mp.corpus_id = sx.corpus_id AND mp.system = sx.label)"""


@query(f"WITH {_MAPPED} SELECT * FROM mp")
def best_speaker_mapping(spark, d):
    """Which reference speaker each system speaker is taken for."""
    return matching.speaker_mapping(matching.co_activity(*speakers(spark, d), BIN_US))


@query(f"WITH {_MAPPED}, {error_sql('rr', 'sm')}")
def mapped_diarization_error(spark, d):
    """The error rate after the best mapping, over all labels."""
    reference, system = speakers(spark, d)
    mapping = matching.speaker_mapping(matching.co_activity(reference, system, BIN_US))
    return matching.error_components(reference, matching.relabelled(system, mapping), COLLAR_US, BIN_US)
