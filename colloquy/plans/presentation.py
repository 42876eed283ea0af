"""Queries on what people read: six views of conversations with their losses, spliced marks, participants' cues.

Attributions follow from roles and lengths, corrections from commas, marks from neighbours.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import graph, views
from colloquy.plans.queries import query
from colloquy.sources import tables
from colloquy.sources.tables import U

KEYS = ["corpus_id", "pos"]
STATUS = "CASE WHEN length(text) < 30 THEN 'conflicting' WHEN speaker = 'user' THEN 'machine_clustered' WHEN speaker = 'assistant' THEN 'manually_bound' ELSE 'unknown' END"
CORRECTED = "CASE WHEN length(text) < 120 THEN replace(text, ',', '') END"
INTERVALS = "CASE WHEN text LIKE '%\n%' THEN 2 ELSE 1 END"


def utterances(spark, d):
    u = graph.overlap_groups(tables.utterances(spark, d))
    return u.select(*KEYS, "start_us", "end_us", F.col("start_us").alias("source_us"), F.col("speaker").alias("label"), F.col("text").alias("display"), F.expr(STATUS).alias("status"), F.expr(CORRECTED).alias("corrected"), F.expr(INTERVALS).alias("intervals"), "group_no", "lane")


def markers(u):
    w = Window.partitionBy("corpus_id").orderBy("start_us", "pos")
    near = u.withColumns({"next": F.lead("start_us").over(w), "before": F.lag("end_us").over(w)})
    return views.marked(
        KEYS, incomplete=u.where("display not like '%.'"), unknown_speaker=u.where("status = 'unknown'"), conflicting_speaker=u.where("status = 'conflicting'"), interrupted=near.where("next < end_us"), interrupting=near.where("start_us < before"),
        overlap=u.select(*KEYS, F.count("*").over(Window.partitionBy("corpus_id", "group_no")).alias("n"), F.concat(F.lit("group="), "group_no").alias("detail")).where("n > 1"), review_required=u.where("intervals > 1"),
    )


_VIEWED = f"""{U}, fr AS (SELECT *, CASE WHEN start_us < max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ut),
gr AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY corpus_id ORDER BY start_us, pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_no FROM fr),
ra AS (SELECT *, {STATUS} AS status, {CORRECTED} AS corrected, {INTERVALS} AS intervals, row_number() OVER (PARTITION BY corpus_id, group_no ORDER BY start_us, pos) - 1 AS lane, count(*) OVER (PARTITION BY corpus_id, group_no) AS of, row_number() OVER w AS place, lead(start_us) OVER w AS ns, lag(end_us) OVER w AS pe FROM gr WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos)),
mk AS (SELECT *, list_filter([CASE WHEN status = 'conflicting' THEN 'conflicting_speaker' END, CASE WHEN text NOT LIKE '%.' THEN 'incomplete' END, CASE WHEN ns < end_us THEN 'interrupted' END, CASE WHEN start_us < pe THEN 'interrupting' END, CASE WHEN of > 1 THEN 'overlap' END, CASE WHEN intervals > 1 THEN 'review_required' END, CASE WHEN status = 'unknown' THEN 'unknown_speaker' END], lambda x: x IS NOT NULL) AS markers FROM ra),
vw AS (SELECT unnest({views.VIEWS}) AS view, *, start_us // 1000 AS ms FROM mk),
vl AS (SELECT *, CASE WHEN view = 'machine_speaker_cluster' THEN CASE WHEN status = 'machine_clustered' THEN speaker ELSE 'UNKNOWN' END WHEN view = 'reviewed_participant_identity' THEN CASE WHEN status = 'manually_bound' THEN speaker ELSE 'UNKNOWN' END
    WHEN status = 'conflicting' THEN 'CONFLICT' WHEN status = 'unknown' THEN 'UNKNOWN' ELSE speaker END AS label, CASE WHEN view = 'correction_aware' THEN coalesce(corrected, text) ELSE text END AS shown FROM vw)"""


@query(f"""WITH {_VIEWED} SELECT view, corpus_id, pos, CAST(place AS INTEGER) AS place, shown AS text, rtrim(printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) || ' ' || CASE WHEN view = 'overlap_expanded' THEN '[lane=' || lane || '] ' ELSE '' END
|| CASE WHEN view = 'compact_reading' THEN '' ELSE '[' || pos || '] ' END || label || ': ' || array_to_string(list_transform(markers, lambda m: '<' || m || '>'), ' ') || ' ' || shown) AS line FROM vl""")
def rendered_views(spark, d):
    """Every utterance in six views, its line with time, lane, name, label and markers."""
    u = utterances(spark, d)
    return views.rendered(u, markers(u))[0]


@query(f"""WITH {_VIEWED}, lo AS (SELECT view, corpus_id, group_no, CAST(pos AS VARCHAR) AS utterances, unnest(list_filter([CASE WHEN view = 'machine_speaker_cluster' AND status <> 'machine_clustered' THEN 'machine_cluster_label_unavailable' END, CASE WHEN view = 'reviewed_participant_identity' AND status <> 'manually_bound' THEN 'reviewed_identity_label_unavailable' END,
CASE WHEN view = 'correction_aware' AND corrected IS NULL THEN 'corrected_text_unavailable' END, CASE WHEN view <> 'overlap_expanded' AND intervals > 1 THEN 'noncontiguous_intervals_linearized' END], lambda x: x IS NOT NULL)) AS kind FROM vl)
SELECT view, corpus_id, kind, group_no, utterances FROM lo UNION ALL SELECT view, corpus_id, 'overlap_linearized', group_no, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FROM vl WHERE of > 1 AND view <> 'overlap_expanded' GROUP BY view, corpus_id, group_no""")
def view_losses(spark, d):
    u = utterances(spark, d)
    return views.rendered(u, markers(u))[1].withColumn("utterances", F.array_join(F.col("utterances").cast("array<string>"), ","))


#: The first sentence of a text is a claim, its first comma's clause a part of it.
MARKS = "filter(array(named_struct('start', 0, 'end', cast(locate('.', text) as int), 'kind', 'claim'), named_struct('start', 0, 'end', cast(locate(',', text) as int), 'kind', 'part')), m -> m.end > 0)"


@query(f"""WITH {U}, aa AS (SELECT corpus_id, pos, text, CAST(strpos(text, '.') AS INTEGER) AS e, CAST(strpos(text, ',') AS INTEGER) AS c FROM ut),
sp AS (SELECT *, CASE WHEN e > 0 AND c > 0 AND c <= e THEN '<claim><part>' || left(text, c) || '</part>' || substring(text, c + 1, e - c) || '</claim>' || substring(text, e + 1) WHEN e > 0 AND c > 0 THEN '<part><claim>' || left(text, e) || '</claim>' || substring(text, e + 1, c - e) || '</part>' || substring(text, c + 1)
    WHEN e > 0 THEN '<claim>' || left(text, e) || '</claim>' || substring(text, e + 1) WHEN c > 0 THEN '<part>' || left(text, c) || '</part>' || substring(text, c + 1) ELSE text END AS spliced,
    CASE WHEN e = 0 THEN NULL WHEN c > e THEN 13 ELSE 7 END AS cs, CASE WHEN e = 0 THEN NULL WHEN c > e THEN 13 + e WHEN c > 0 THEN 7 + 6 + e + 7 ELSE 7 + e END AS ce FROM aa)
SELECT corpus_id, pos, spliced AS text, CAST(cs AS INTEGER) AS claim_start, CAST(ce AS INTEGER) AS claim_end FROM sp""")
def spliced_marks(spark, d):
    """Texts with marks put in, and where the claim stands afterwards."""
    u = tables.utterances(spark, d).withColumn("marks", F.expr(MARKS))
    out = views.spliced(u, KEYS, "text", "marks")
    at = u.select(*KEYS, F.when(F.expr("try_element_at(marks, 1).kind = 'claim'"), 0).alias("at"))
    return out.join(at, KEYS).select(*KEYS, "text", F.expr("try_element_at(places, at + 1).start").alias("claim_start"), F.expr("try_element_at(places, at + 1).end").alias("claim_end"))


_SPANS = "array(named_struct('kind', CASE speaker WHEN 'user' THEN 'machine_cluster' WHEN 'assistant' THEN 'manually_bound' ELSE 'unattributed' END, 'reviewed', CASE WHEN speaker = 'assistant' THEN array('REVIEWED: assistant') END, 'machine', CASE WHEN speaker = 'user' THEN array('user') END, 'overlap', text LIKE '%,%'))"
_SECOND = "CASE WHEN length(text) > 900 THEN array(named_struct('kind', 'unknown', 'reviewed', cast(null as array<string>), 'machine', cast(null as array<string>), 'overlap', false)) WHEN length(text) < 40 THEN array(named_struct('kind', 'conflicted', 'reviewed', cast(null as array<string>), 'machine', cast(null as array<string>), 'overlap', false)) ELSE cast(array() as array<struct<kind: string, reviewed: array<string>, machine: array<string>, overlap: boolean>>) END"


@query(f"""WITH {U}, x AS (SELECT *, CASE speaker WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'REVIEWED: assistant' ELSE 'UNATTRIBUTED' END || CASE WHEN length(text) > 900 THEN ' | REVIEWED: UNKNOWN' ELSE '' END AS l, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM ut),
y AS (SELECT *, CASE WHEN text LIKE '%,%' THEN 'OVERLAP: ' ELSE '' END || l AS label, start_us // 1000 AS s, greatest((end_us + 999) // 1000, start_us // 1000 + 1) AS e, length(text) < 40 AS no FROM x)
SELECT corpus_id, pos, CASE WHEN NOT no THEN s END AS start_ms, CASE WHEN NOT no THEN e END AS end_ms, CASE WHEN NOT no THEN label END AS label, CASE WHEN NOT no THEN label || ' ' || norm END AS body, CASE WHEN NOT no THEN speaker = 'system' OR length(text) > 900 END AS unresolved,
CASE WHEN NOT no THEN array_to_string(list_filter([CASE WHEN s * 1000 <> start_us OR e * 1000 <> end_us THEN 'millisecond_timestamp_rounding' END, CASE WHEN text <> norm THEN 'normalized_text_rendering' END, CASE WHEN length(text) > 900 THEN 'format_metadata_in_companion_manifest' END], lambda v: v IS NOT NULL), ',') END AS losses, CASE WHEN no THEN 'conflicted' END AS refused FROM y""")
def labelled_cues(spark, d):
    """Participants' cues of utterances; the SQL holds their words and all losses but those of length, which tests hold."""
    u = tables.utterances(spark, d).selectExpr(*KEYS, "start_us", "end_us", "text", "trim(regexp_replace(text, '\\\\s+', ' ')) AS normalized", f"concat({_SPANS}, {_SECOND}) AS spans")
    out = views.participant_cues(u, KEYS)
    kept = F.filter("losses", lambda x: ~x.isin(*views.CUE_LOSSES[3:]))
    return out.select(*KEYS, "start_ms", "end_ms", "label", F.array_join("lines", " ").alias("body"), "unresolved", F.array_join(kept, ",").alias("losses"), "refused")
