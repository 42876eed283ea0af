"""Queries over two versions of conversations: what changed, what it invalidates, corrections and their effect.

The second version is edited by what texts hold and how long they are. Observations are sentences, sets the
sentences of one family in an utterance, acts the sets of two or more; an act depends on the last act of its
family before it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import corrections, propagation, word_alignment
from colloquy.plans.queries import query
from colloquy.sources import tables
from colloquy.sources.shared import kept
from colloquy.sources.tables import U

KEYS = ["corpus_id", "pos"]
#: What the second version holds instead, in words that both SQL engines read.
EDITS = {
    "text": "CASE WHEN length(text) < 120 THEN replace(text, ',', '') ELSE text END",
    "end_us": "CASE WHEN length(text) > 900 THEN end_us - 1000 ELSE end_us END",
    "speaker": "CASE WHEN speaker = 'user' AND length(text) < 80 THEN 'assistant' ELSE speaker END",
    "label": "CASE WHEN length(text) BETWEEN 300 AND 500 THEN upper(speaker) ELSE speaker END",
    "quoted": "text LIKE '%,%' AND length(text) BETWEEN 500 AND 700",
    "interrupted": "length(text) BETWEEN 200 AND 260",
}
COLUMNS = {"text": ["text"], "boundary": ["start_us", "end_us"], "speaker_attribution": ["speaker"], "display_label_only": ["label"], "quotation_structure": ["quoted"], "interruption_or_continuation": ["interrupted"]}
#: Families of sentences, by their first trait that holds.
FAMILY = "CASE WHEN sentence LIKE '%,%' THEN 'qualification' WHEN length(sentence) < 20 THEN 'quotation_and_attribution' ELSE 'assertive' END"


def versions(spark, d):
    """Utterances before and after: the first lacks the system's, the second the shortest."""
    u = tables.utterances(spark, d)
    before = u.where("speaker <> 'system'").withColumns({"label": F.col("speaker"), "quoted": F.lit(False), "interrupted": F.lit(False)})
    after = u.where("length(text) >= 40").select(*KEYS, "start_us", *(F.expr(e).alias(c) for c, e in EDITS.items()))
    return before.select(*after.columns), after


def artifacts(spark, d):
    """(observations, sets, acts, relations) of the first version."""
    u = versions(spark, d)[0]
    cut = u.select(*KEYS, F.posexplode(F.expr("regexp_extract_all(text, '[^.\\n]+', 0)")).alias("n", "raw")).select(*KEYS, "n", F.trim("raw").alias("sentence")).where("sentence <> ''")
    obs = kept(cut.select(*KEYS, F.concat_ws("/", *KEYS, (F.col("n") + 1).cast("string")).alias("observation_id"), F.expr(FAMILY).alias("family")), "revision-observations")
    sets = kept(obs.groupBy(*KEYS, "family").agg(F.sort_array(F.collect_list("observation_id")).alias("observation_ids")).withColumn("set_id", F.concat_ws("/", *KEYS, "family")), "revision-sets")
    acts = sets.where("size(observation_ids) > 1").select(*KEYS, "family", "set_id", F.concat(F.lit("act:"), "set_id").alias("act_id"))
    w = Window.partitionBy("corpus_id", "family").orderBy("pos")
    relations = acts.select(F.lag("act_id").over(w).alias("src"), F.col("act_id").alias("dst")).where("src is not null")
    return obs, sets, acts, relations


_VERSIONS = f"""{U}, va AS (SELECT corpus_id, pos, start_us, text, end_us, speaker, speaker AS label, false AS quoted, false AS interrupted FROM ut WHERE speaker <> 'system'),
vb AS (SELECT corpus_id, pos, start_us, {', '.join(f'{e} AS {c}' for c, e in EDITS.items())} FROM ut WHERE length(text) >= 40),
ch AS (SELECT * FROM (SELECT coalesce(a.corpus_id, b.corpus_id) AS corpus_id, coalesce(a.pos, b.pos) AS pos, list_filter([
    CASE WHEN a.pos IS NULL THEN 'added_utterance' END, CASE WHEN b.pos IS NULL THEN 'removed_utterance' END,
    CASE WHEN a.text <> b.text THEN 'text' END, CASE WHEN a.start_us <> b.start_us OR a.end_us <> b.end_us THEN 'boundary' END,
    CASE WHEN a.speaker <> b.speaker THEN 'speaker_attribution' END, CASE WHEN a.speaker = b.speaker AND a.label <> b.label THEN 'display_label_only' END,
    CASE WHEN a.quoted <> b.quoted THEN 'quotation_structure' END, CASE WHEN a.interrupted <> b.interrupted THEN 'interruption_or_continuation' END], lambda x: x IS NOT NULL) AS kinds
    FROM va a FULL JOIN vb b ON a.corpus_id = b.corpus_id AND a.pos = b.pos) WHERE len(kinds) > 0)"""
_ARTIFACTS = f"""so AS (SELECT corpus_id, pos, n, trim(raw[n]) AS sentence FROM (SELECT corpus_id, pos, raw, unnest(range(1, len(raw) + 1)) AS n FROM (SELECT corpus_id, pos, regexp_extract_all(text, '[^.\\n]+') AS raw FROM va))),
ob AS (SELECT corpus_id, pos, corpus_id || '/' || pos || '/' || n AS observation_id, {FAMILY} AS family FROM so WHERE sentence <> ''),
se AS (SELECT corpus_id, pos, family, count(*) AS n, corpus_id || '/' || pos || '/' || family AS set_id FROM ob GROUP BY corpus_id, pos, family),
ac AS (SELECT corpus_id, pos, family, set_id, 'act:' || set_id AS act_id FROM se WHERE n > 1),
gone AS (SELECT *, len(list_intersect(kinds, ['text', 'boundary', 'removed_utterance', 'added_utterance'])) > 0 OR (list_contains(kinds, 'speaker_attribution') AND EXISTS (SELECT 1 FROM va WHERE va.corpus_id = ch.corpus_id AND va.pos = ch.pos AND va.text LIKE '% the %')) AS gone FROM ch),
bo AS (SELECT ob.*, kinds FROM ob JOIN gone USING (corpus_id, pos) WHERE gone OR (list_contains(kinds, 'quotation_structure') AND family = 'quotation_and_attribution')),
bs AS (SELECT DISTINCT corpus_id, pos, family, corpus_id || '/' || pos || '/' || family AS set_id FROM bo)"""


@query(f"WITH {_VERSIONS} SELECT corpus_id, pos, array_to_string(kinds, ',') AS kinds FROM ch")
def utterance_changes(spark, d):
    return propagation.change_kinds(*versions(spark, d), KEYS, COLUMNS).withColumn("kinds", F.array_join("kinds", ","))


def _impacts(spark, d):
    before, after = versions(spark, d)
    obs, sets, acts, _ = artifacts(spark, d)
    return propagation.impacts(propagation.change_kinds(before, after, KEYS, COLUMNS), obs, sets, acts, KEYS, before.where("text like '% the %'").select(*KEYS))


_IDS = "coalesce((SELECT string_agg({0}, ' ' ORDER BY {0}) FROM {1} WHERE x.corpus_id = ch.corpus_id AND x.pos = ch.pos {2}), '') AS {3}"
_GONE = "x.set_id {}IN (SELECT set_id FROM bs)"


@query(f"""WITH {_VERSIONS}, {_ARTIFACTS} SELECT corpus_id, pos, array_to_string(kinds, ',') AS kinds,
{_IDS.format('observation_id', 'bo x', '', 'invalidated_observations')}, {_IDS.format('set_id', 'bs x', '', 'invalidated_sets')},
{_IDS.format('act_id', 'ac x', 'AND ' + _GONE.format(''), 'invalidated_acts')}, {_IDS.format('act_id', 'ac x', 'AND ' + _GONE.format('NOT '), 'preserved_acts')},
{_IDS.format('act_id', 'ac x', "AND (list_contains(kinds, 'interruption_or_continuation') OR " + _GONE.format('') + ')', 'rebuild_relations')} FROM ch""")
def discourse_impacts(spark, d):
    out = _impacts(spark, d)
    return out.select(*KEYS, F.array_join("kinds", ",").alias("kinds"), *(F.array_join(c, " ").alias(c) for c in out.columns if c not in (*KEYS, "kinds")))


@query(f"""WITH RECURSIVE {_VERSIONS}, {_ARTIFACTS},
ed AS (SELECT observation_id AS src, corpus_id || '/' || pos || '/' || family AS dst FROM ob UNION ALL SELECT set_id, act_id FROM ac
    UNION ALL SELECT src, dst FROM (SELECT lag(act_id) OVER (PARTITION BY corpus_id, family ORDER BY pos) AS src, act_id AS dst FROM ac) WHERE src IS NOT NULL),
re(node, round) AS (SELECT observation_id, 0 FROM bo UNION SELECT ed.dst, re.round + 1 FROM re JOIN ed ON ed.src = re.node)
SELECT node, CAST(min(round) AS INTEGER) AS round FROM re GROUP BY node""")
def invalidated_artifacts(spark, d):
    """All that depends on a changed utterance's observations, through sets and acts and the acts after these."""
    obs, sets, acts, relations = artifacts(spark, d)
    seeds = _impacts(spark, d).select(F.explode("invalidated_observations").alias("node"))
    return propagation.reached(seeds, propagation.dependencies(obs, sets, acts, relations))


#: Sentences of a recording as segments of a timeline without gaps: 60 ms a character.
def segments(spark, d):
    u = tables.utterances(spark, d)
    cut = u.select(*KEYS, F.posexplode(F.expr("regexp_extract_all(text, '[^.\\n]+', 0)")).alias("n", "raw")).select(*KEYS, F.col("n") + 1, F.trim("raw").alias("text")).toDF(*KEYS, "n", "text").where("text <> ''")
    w = Window.partitionBy("corpus_id").orderBy("pos", "n")
    end = F.sum(60_000 * F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.select("corpus_id", F.concat(F.lit("s"), "pos", F.lit("."), "n").alias("segment_id"), (end - 60_000 * F.length("text")).alias("start_us"), end.alias("end_us"), "text", F.col("text").alias("normalized"), F.lit(None).cast("string").alias("language"), F.row_number().over(w).alias("rn"))
    return rows.withColumns({"alternatives": F.array(F.concat(F.lit("alt:"), "segment_id")), "annotations": F.expr("cast(array() as array<string>)")})


#: Which correction a segment gets, by its length in characters (n; of the next segment: m). `late` runs into the next segment, `stale` expects another text.
EDIT = """CASE WHEN n < 10 THEN 'deletion' WHEN n < 60 AND text LIKE '%,%' THEN 'replacement' WHEN n BETWEEN 60 AND 69 THEN 'boundary_adjustment' WHEN n BETWEEN 70 AND 74 THEN 'late'
WHEN n BETWEEN 75 AND 79 THEN 'stale' WHEN n BETWEEN 80 AND 84 AND m < 60 THEN 'merge' WHEN n BETWEEN 85 AND 89 THEN 'normalization_only' WHEN n BETWEEN 90 AND 94 THEN 'uncertainty_annotation'
WHEN n BETWEEN 95 AND 99 THEN 'restore_earlier_candidate' WHEN n >= 100 THEN 'split' END"""
KIND = "CASE edit WHEN 'late' THEN 'boundary_adjustment' WHEN 'stale' THEN 'replacement' ELSE edit END"


def corrections_of(segs):
    """Entries for `segments`: one by EDIT for each; a second for each split's first half; an insertion after each recording's last."""
    w = Window.partitionBy("corpus_id").orderBy("rn")
    s = segs.withColumns({"n": F.length("text"), "m": F.length(F.lead("text").over(w)), "next": F.lead(F.struct("segment_id", "end_us", "text", "start_us")).over(w)}).withColumn("edit", F.expr(EDIT))
    struct = "named_struct('start_us', {}, 'end_us', {}, 'text', {}, 'normalized', {}, 'language', cast({} as string))".format
    full = "named_struct('start_us', {}, 'end_us', {}, 'text', {}, 'normalized', {}, 'language', cast({} as string), 'annotation', cast({} as string), 'candidate', cast({} as string))".format
    half, left, right = "start_us + 30000 * n", "trim(left(text, n div 2))", "trim(substring(text, n div 2 + 1))"
    own, null = struct("start_us", "end_us", "text", "normalized", "null"), "null"
    proposed = {
        "deletion": f"cast(array() as {corrections.PROPOSED})",
        "replacement": f"array({full('start_us', 'end_us', 'replace(text, \",\", \"\")', 'replace(text, \",\", \"\")', null, null, null)})",
        "stale": f"array({full('start_us', 'end_us', '\"new\"', '\"new\"', null, null, null)})",
        "boundary_adjustment": f"array({full('start_us', 'end_us - 1000', 'text', 'text', null, null, null)})",
        "late": f"array({full('start_us', 'end_us + 5000000', 'text', 'text', null, null, null)})",
        "merge": f"array({full('start_us', 'next.end_us', 'text || \" \" || next.text', 'text || \" \" || next.text', null, null, null)})",
        "normalization_only": f"array({full('start_us', 'end_us', 'text', 'replace(text, \",\", \"\") || \"!\"', null, null, null)})",
        "uncertainty_annotation": f"array({full('start_us', 'end_us', 'text', 'text', null, '\"unclear\"', null)})",
        "restore_earlier_candidate": f"array({full('start_us', 'end_us', 'replace(text, \"e\", \"a\")', 'replace(text, \"e\", \"a\")', null, null, '\"alt:\" || segment_id')})",
        "split": f"array({full('start_us', half, left, left, null, null, null)}, {full(half, 'end_us', right, right, null, null, null)})",
    }
    case = "CASE edit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in proposed.items()) + " END"
    prior = f"CASE edit WHEN 'stale' THEN array({struct('start_us', 'end_us', '\"other\"', 'normalized', null)}) WHEN 'merge' THEN array({own}, {struct('next.start_us', 'next.end_us', 'next.text', 'next.text', null)}) ELSE array({own}) END"
    to = "CASE edit WHEN 'late' THEN end_us + 5000000 WHEN 'merge' THEN next.end_us ELSE end_us END"
    references = "CASE WHEN edit = 'uncertainty_annotation' AND text LIKE '%,%' THEN array() ELSE array('review') END"
    names = ["corpus_id", "seq", "kind", "actor", "references", "from_us", "to_us", "targets", "prior", "proposed"]
    first = s.where("edit is not null").selectExpr("corpus_id", "2 * rn AS seq", f"{KIND} AS kind", "'human' AS actor", f"{references} AS references", "start_us AS from_us", f"{to} AS to_us", "CASE edit WHEN 'merge' THEN array(segment_id, next.segment_id) ELSE array(segment_id) END AS targets", f"{prior} AS prior", f"{case} AS proposed")
    second = s.where("edit = 'split'").selectExpr("corpus_id", "2 * rn + 1 AS seq", "'language_correction' AS kind", "'automated_process' AS actor", "array('review') AS references", "start_us AS from_us", "end_us AS to_us", "array(concat('c', 2 * rn, '.0')) AS targets", f"array({struct('start_us', half, left, left, null)}) AS prior", f"array({full('start_us', half, left, left, '\"und\"', null, null)}) AS proposed")
    third = s.where("next is null and edit is null").selectExpr("corpus_id", "2 * rn AS seq", "'insertion' AS kind", "'human' AS actor", "array('review') AS references", "start_us AS from_us", "end_us + 1000000 AS to_us", "array(segment_id) AS targets", f"cast(array() as {corrections.PRIOR}) AS prior", f"array({full('end_us', 'end_us + 1000000', '\"added\"', '\"added\"', null, null, null)}) AS proposed")
    return first.select(*names).unionByName(second.select(*names)).unionByName(third.select(*names))


_SEGMENTS = f"""{U}, cu AS (SELECT corpus_id, pos, k, trim(raw[k]) AS text FROM (SELECT corpus_id, pos, raw, unnest(range(1, len(raw) + 1)) AS k FROM (SELECT corpus_id, pos, regexp_extract_all(text, '[^.\\n]+') AS raw FROM ut))),
sg AS (SELECT corpus_id, 's' || pos || '.' || k AS segment_id, CAST(sum(60000 * length(text)) OVER w - 60000 * length(text) AS BIGINT) AS start_us, CAST(sum(60000 * length(text)) OVER w AS BIGINT) AS end_us, text, length(text) AS n, row_number() OVER w AS rn,
    lead(text) OVER w AS next_text, lead(segment_id) OVER w AS next_id FROM (SELECT *, 's' || pos || '.' || k AS segment_id FROM cu WHERE text <> '') WINDOW w AS (PARTITION BY corpus_id ORDER BY pos, k)),
se AS (SELECT *, {EDIT} AS edit FROM (SELECT *, length(next_text) AS m FROM sg)),
sk AS (SELECT *, coalesce(lag(edit) OVER (PARTITION BY corpus_id ORDER BY rn) = 'merge', false) AS taken FROM se),
st AS (SELECT *, {KIND} AS kind, CASE WHEN taken THEN 'unknown_target' WHEN edit = 'stale' THEN 'stale_prior' WHEN edit = 'late' AND next_id IS NOT NULL THEN 'overlaps' WHEN edit = 'uncertainty_annotation' AND text LIKE '%,%' THEN 'no_reference' END AS reason FROM sk),
en AS (SELECT corpus_id, CAST(2 * rn AS INTEGER) AS seq, kind, reason FROM st WHERE kind IS NOT NULL UNION ALL SELECT corpus_id, CAST(2 * rn + 1 AS INTEGER), 'language_correction', NULL FROM st WHERE edit = 'split'
    UNION ALL SELECT corpus_id, CAST(2 * rn AS INTEGER), 'insertion', CASE WHEN taken THEN 'unknown_target' END FROM st WHERE next_id IS NULL AND edit IS NULL),
ok AS (SELECT *, 'c' || 2 * rn || '.' AS c FROM st WHERE edit IS NOT NULL AND reason IS NULL),
cs AS (SELECT corpus_id, segment_id, start_us, end_us, text, text AS normalized, NULL AS language, 0 AS notes FROM st WHERE NOT taken AND (edit IS NULL OR reason IS NOT NULL)
UNION ALL SELECT corpus_id, c || 0, start_us, CASE edit WHEN 'boundary_adjustment' THEN end_us - 1000 WHEN 'late' THEN end_us + 5000000 WHEN 'merge' THEN end_us + 60000 * m ELSE end_us END,
    CASE edit WHEN 'replacement' THEN replace(text, ',', '') WHEN 'merge' THEN text || ' ' || next_text WHEN 'restore_earlier_candidate' THEN replace(text, 'e', 'a') ELSE text END,
    CASE edit WHEN 'replacement' THEN replace(text, ',', '') WHEN 'merge' THEN text || ' ' || next_text WHEN 'restore_earlier_candidate' THEN replace(text, 'e', 'a') WHEN 'normalization_only' THEN replace(text, ',', '') || '!' ELSE text END,
    NULL, CASE edit WHEN 'uncertainty_annotation' THEN 1 ELSE 0 END FROM ok WHERE edit NOT IN ('deletion', 'split')
UNION ALL SELECT corpus_id, 'c' || (2 * rn + 1) || '.0', start_us, start_us + 30000 * n, trim(left(text, n // 2)), trim(left(text, n // 2)), 'und', 0 FROM ok WHERE edit = 'split'
UNION ALL SELECT corpus_id, c || 1, start_us + 30000 * n, end_us, trim(substring(text, n // 2 + 1)), trim(substring(text, n // 2 + 1)), NULL, 0 FROM ok WHERE edit = 'split'
UNION ALL SELECT corpus_id, 'c' || 2 * rn || '.0', end_us, end_us + 1000000, 'added', 'added', NULL, 0 FROM st WHERE next_id IS NULL AND edit IS NULL AND NOT taken)"""


def _replayed(spark, d):
    segs = kept(segments(spark, d), "revision-segments")
    return corrections.replay(segs, corrections_of(segs))


@query(f"WITH {_SEGMENTS} SELECT corpus_id, seq, kind, CASE WHEN reason IS NULL THEN 'applied' ELSE 'refused' END AS status, reason FROM en")
def correction_entries(spark, d):
    """What became of each entry of a batch of all ten kinds, in part upon results of entries before it."""
    return _replayed(spark, d)[1]


@query(f"WITH {_SEGMENTS} SELECT * FROM cs")
def corrected_segments(spark, d):
    return _replayed(spark, d)[0].select("corpus_id", "segment_id", "start_us", "end_us", "text", "normalized", "language", F.size("annotations").alias("notes"))


@query(f"""WITH {_SEGMENTS}, cu2 AS (SELECT corpus_id, segment_id, start_us, CASE WHEN text LIKE '%z%' THEN end_us + 1 ELSE end_us END AS end_us, text FROM cs WHERE length(text) <> 30),
ov AS (SELECT corpus_id, segment_id FROM (SELECT corpus_id, segment_id, start_us, lag(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, segment_id) AS p FROM cu2) WHERE p > start_us)
SELECT corpus_id, 'overlap' AS finding, segment_id AS id FROM ov
UNION ALL SELECT corpus_id, 'lost', segment_id FROM st WHERE n = 30 AND NOT taken AND (edit IS NULL OR reason IS NOT NULL)
UNION ALL SELECT st.corpus_id, 'altered', segment_id FROM st JOIN cu2 USING (corpus_id, segment_id) WHERE st.end_us <> cu2.end_us""")
def revision_faults(spark, d):
    """A revision spoilt on purpose: segments of one length are gone, others end too late."""
    segs = kept(segments(spark, d), "revision-segments")
    asked = kept(corrections_of(segs), "revision-corrections")
    current, entries = corrections.replay(segs, asked)
    spoilt = kept(current.where("length(text) <> 30").withColumn("end_us", F.expr("CASE WHEN text LIKE '%z%' THEN end_us + 1 ELSE end_us END")), "revision-spoilt")
    return corrections.revision_findings(segs, asked, entries, spoilt)


#: Tokens as a hearing takes them: every seventh is lost, of the rest every fifth is taken for a word that no text holds. The corrected version gets these back.
_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}]+', 0)"
TAGS = "array(speaker, if(length(text) > 500, 'long', 'short'), if(text like '%,%', 'comma', speaker))"
_HEARD = f"""{U}, tk AS (SELECT corpus_id, pos, speaker, text, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS n FROM ut),
er AS (SELECT *, n - lost AS heard, (n - lost + 2) // 5 AS wrong FROM (SELECT *, (n + 3) // 7 AS lost FROM tk))"""


def heard(spark, d):
    u = tables.utterances(spark, d).withColumn("w", F.expr(_TOKENS.replace("\\", "\\\\")))
    left = F.expr("filter(w, (x, i) -> i % 7 <> 3)")
    return u.select(*KEYS, "speaker", "text", F.array_join("w", " ").alias("reference"), left.alias("left")).select(
        *KEYS, F.expr(TAGS).alias("tags"), "reference", F.array_join("left", " ").alias("corrected"), F.expr("array_join(transform(left, (x, i) -> if(i % 5 = 2, 'qqmisheard', x)), ' ')").alias("original"))


@query(f"""WITH {_HEARD} SELECT corpus_id, CAST(sum(heard - wrong) AS BIGINT) AS matches, CAST(sum(wrong) AS BIGINT) AS substitutions, CAST(sum(lost) AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS insertions FROM er GROUP BY corpus_id HAVING sum(n) > 0""")
def alignment_ops(spark, d):
    """Steps of every utterance's alignment, by kind."""
    return word_alignment.word_rows(heard(spark, d), KEYS, "reference", "original").groupBy("corpus_id").agg(*word_alignment.op_counts())


@query(f"""WITH {_HEARD}, tg AS (SELECT *, unnest(list_distinct([speaker, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END, CASE WHEN text LIKE '%,%' THEN 'comma' ELSE speaker END])) AS tag FROM er)
SELECT tag, count(*) AS n_segments, CAST(sum(heard - wrong) AS BIGINT) AS matches, CAST(sum(wrong) AS BIGINT) AS substitutions, CAST(sum(lost) AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS insertions, CAST(sum(n) AS BIGINT) AS n_words, round(sum(wrong + lost) / sum(n), 9) AS wer FROM tg GROUP BY tag""")
def stratified_word_errors(spark, d):
    return word_alignment.stratified_wer(heard(spark, d), KEYS, "reference", "original", "tags")


@query(f"""WITH {_HEARD} SELECT corpus_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(wrong + lost) AS BIGINT) AS errors_before, CAST(sum(lost) AS BIGINT) AS errors_after,
round(sum(wrong + lost) / nullif(sum(n), 0), 9) AS wer_before, round(sum(lost) / nullif(sum(n), 0), 9) AS wer_after, coalesce(round(-sum(wrong) / nullif(sum(n), 0), 9), 0) AS wer_change FROM er GROUP BY corpus_id""")
def correction_impact(spark, d):
    return word_alignment.correction_impact(heard(spark, d), KEYS, "reference", "original", "corrected", ["corpus_id"])
