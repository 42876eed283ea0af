"""Registered queries on transcripts, contexts, matches and evaluation, each beside the same question in plain SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import metrics
from colloquy.operators import context, matching, transcript
from colloquy.plans.queries import BIN_US, query
from colloquy.sources import subtitles, tables
from colloquy.sources.tables import EV, PT, U, WD

_SPACE = "[ \\t\\r\\n]+"
_FLAT = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_TOKEN = "regexp_replace(lower({}), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')"


@query(f"WITH {U} SELECT corpus_id, pos, {_FLAT} AS display, {_TOKEN.format(_FLAT)} AS normalized, regexp_matches(rtrim(text), '[?][\"''”’)\\]}}]*$') AS asks FROM ut")
def text_views(spark, d):
    u = tables.utterances(spark, d)
    flat = transcript.collapsed(F.col("text"))
    return u.select("corpus_id", "pos", flat.alias("display"), transcript.token(flat).alias("normalized"), F.rtrim("text").rlike("[?][\"'”’)\\]}]*$").alias("asks"))


@query(f"""WITH {U}, t AS (SELECT corpus_id, pos, {_FLAT} AS t, end_us AS e, end_us - start_us AS lasts, max(end_us) OVER (PARTITION BY corpus_id) AS source_end FROM ut),
n AS (SELECT *, len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) AS tokens, regexp_matches(t, '[.?!]$') AS terminal FROM t)
SELECT corpus_id, pos, CASE WHEN tokens = 0 THEN 'non_lexical' WHEN t LIKE '%...' OR t LIKE '%…' OR regexp_matches(t, '[-—–]$') THEN 'unknown' WHEN NOT terminal AND e >= source_end - 1 THEN 'clipped_by_source_boundary'
WHEN lasts <= 500000 AND tokens = 1 AND NOT terminal THEN 'fragment' WHEN terminal THEN 'complete' ELSE 'unknown' END AS completeness FROM n""")
def completeness(spark, d):
    return transcript.completeness(tables.utterances(spark, d))


@query(f"""WITH {WD}, t AS (SELECT *, {_TOKEN.format('word')} AS token FROM wd), b AS (SELECT *, lag(token) OVER (PARTITION BY corpus_id, pos ORDER BY word_no) AS before, word_no < n_words AS more FROM t)
SELECT corpus_id, pos, word_no, 'filler' AS kind FROM b WHERE token IN ('um', 'uh', 'erm', 'hmm') UNION ALL SELECT corpus_id, pos, word_no, 'hesitation' FROM b WHERE word LIKE '%...%' OR word LIKE '%…%'
UNION ALL SELECT corpus_id, pos, word_no, 'repetition' FROM b WHERE token <> '' AND token = before UNION ALL SELECT corpus_id, pos, word_no, 'explicit_correction' FROM b WHERE token IN ('i mean', 'rather', 'sorry') AND before IS NOT NULL AND more
UNION ALL SELECT corpus_id, pos, word_no, 'false_start' FROM b WHERE regexp_matches(word, '[-—–]$') AND more""")
def disfluencies(spark, d):
    return transcript.disfluencies(tables.words(spark, d))


def _atoms(spark, d) -> DataFrame:
    """Lines of utterances: equal shares of the time, the end of each cut by 0, 0.4 or 0.8 seconds by position."""
    u = tables.utterances(spark, d).withColumn("ls", F.split("text", "\n"))
    a = u.withColumn("each", F.expr("(end_us - start_us) div size(ls)")).select("corpus_id", "pos", "speaker", "start_us", "each", F.posexplode("ls").alias("line_no", "text"))
    start = F.col("start_us") + F.col("line_no") * F.col("each")
    return a.select("corpus_id", "pos", "line_no", "speaker", "text", start.alias("start_us"), (start + F.greatest(F.lit(1), F.col("each") - F.col("line_no") % 3 * 400_000)).alias("end_us"))


_ATOMS = f"""{U}, ls AS (SELECT *, string_split(text, chr(10)) AS ls FROM ut), le AS (SELECT *, (end_us - start_us) // len(ls) AS each FROM ls),
atm AS (SELECT corpus_id, pos, speaker, line_no, ls[line_no + 1] AS text, start_us + line_no * each AS start_us, start_us + line_no * each + greatest(1, each - line_no % 3 * 400000) AS end_us FROM (SELECT *, unnest(range(0, len(ls))) AS line_no FROM le))"""


@query(f"""WITH {_ATOMS}, f AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER w BETWEEN 0 AND 750000 AND lag(speaker) OVER w = speaker AND NOT regexp_matches(rtrim(lag(text) OVER w), '[.?!]$') THEN 0 ELSE 1 END AS fresh FROM atm WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos, line_no)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY corpus_id ORDER BY start_us, pos, line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM f)
SELECT corpus_id, segment, min(speaker) AS speaker, count(*) AS n, CAST(min(start_us) AS BIGINT) AS start_us, CAST(max(end_us) AS BIGINT) AS end_us FROM s GROUP BY corpus_id, segment""")
def utterance_segments(spark, d):
    s = transcript.segments(_atoms(spark, d))
    return s.groupBy("corpus_id", "segment").agg(F.min("speaker").alias("speaker"), F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


_WORDS = f"list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '')"
_LAST = "split_part(a, chr(10), -1)"


@query(f"""WITH {U}, w AS (SELECT corpus_id, pos, {_WORDS} AS ws FROM ut), l AS (SELECT corpus_id, pos, CASE WHEN len(ws) = 0 THEN [] ELSE string_split(list_reduce(ws, lambda a, w: CASE WHEN length({_LAST}) + 1 + length(w) <= 42 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) END AS ls FROM w)
SELECT corpus_id, pos, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no, unnest(ls) AS line FROM l""")
def wrapped_lines(spark, d):
    u = tables.utterances(spark, d).select("corpus_id", "pos", F.posexplode(transcript.lines(F.col("text"))).alias("i", "line"))
    return u.select("corpus_id", "pos", (F.col("i") + 1).cast("long").alias("line_no"), "line")


_CUES = f"""{U}, w AS (SELECT corpus_id, pos, start_us, end_us, {_WORDS} AS ws FROM ut), e AS (SELECT *, (end_us - start_us) // len(ws) AS each FROM w WHERE len(ws) > 0),
l AS (SELECT *, string_split(list_reduce(ws, lambda a, w: CASE WHEN length({_LAST}) + 1 + length(w) <= 84 AND (len(string_split({_LAST}, ' ')) + 1) * each <= 7000000 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) AS ls FROM e),
c AS (SELECT corpus_id, pos, start_us, each, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS cue_no, unnest(ls) AS text FROM l),
n AS (SELECT *, len(string_split(text, ' ')) AS n FROM c), cu AS (SELECT corpus_id, pos, cue_no, text, CAST(start_us + each * (sum(n) OVER w - n) AS BIGINT) AS start_us, CAST(start_us + each * sum(n) OVER w AS BIGINT) AS end_us FROM n WINDOW w AS (PARTITION BY corpus_id, pos ORDER BY cue_no ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_CUES} SELECT * FROM cu")
def subtitle_cues(spark, d):
    return transcript.cues(tables.utterances(spark, d))


def _clock(ms: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


_BLOCK = f"""WITH {_CUES}, m AS (SELECT *, CAST(floor(start_us / 1000) AS BIGINT) AS s, greatest(CAST(ceil(end_us / 1000) AS BIGINT), CAST(floor(start_us / 1000) AS BIGINT) + 1) AS e, row_number() OVER (PARTITION BY corpus_id ORDER BY start_us, pos, cue_no) AS block_no FROM cu WHERE start_us >= 0)
SELECT corpus_id, block_no, {{}} || {{}} || ' --> ' || {{}} || chr(10) || text || chr(10) AS block FROM m"""


@query(_BLOCK.format("block_no || chr(10)", _clock("s", ","), _clock("e", ",")))
def srt_blocks(spark, d):
    return subtitles.blocks(transcript.cues(tables.utterances(spark, d)).where("start_us >= 0"), "srt")


@query(_BLOCK.format("''", _clock("s", "."), _clock("e", ".")))
def vtt_blocks(spark, d):
    return subtitles.blocks(transcript.cues(tables.utterances(spark, d)).where("start_us >= 0"), "vtt")


_SIDES = "ref AS (SELECT * FROM ev WHERE label = 'click'), st AS (SELECT * FROM ev WHERE label = 'view')"
_STATES = f"""{EV}, {_SIDES}, c AS (SELECT r.corpus_id, r.interval_id AS reference_id, s.interval_id AS state_id, greatest(0, least(r.end_us, s.end_us) - greatest(r.start_us, s.start_us)) AS o, abs(r.start_us + r.end_us - s.start_us - s.end_us) AS a, r.start_us AS rs, s.start_us AS ss FROM ref r LEFT JOIN st s ON r.corpus_id = s.corpus_id),
k AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, reference_id ORDER BY o DESC, a, state_id) AS k FROM c)"""


@query(f"WITH {_STATES} SELECT corpus_id, reference_id, state_id, CASE WHEN state_id IS NULL THEN 0 ELSE o END AS overlap_us FROM k WHERE k = 1")
def matching_states(spark, d):
    ev = tables.intervals(spark, d)
    return matching.matching_states(ev.where("label = 'click'"), ev.where("label = 'view'"), BIN_US)


@query(f"WITH {_STATES} SELECT corpus_id, count(*) AS n, count(*) - count(state_id) AS unmatched, round(avg(abs(rs - ss)), 3) AS mean_us, median(abs(rs - ss)) AS median_us, max(abs(rs - ss)) AS longest_us FROM k WHERE k = 1 GROUP BY corpus_id")
def segment_timing_error(spark, d):
    ev = tables.intervals(spark, d)
    ref, st = ev.where("label = 'click'"), ev.where("label = 'view'")
    m = matching.matching_states(ref, st, BIN_US).join(ref.select(F.col("interval_id").alias("reference_id"), F.col("start_us").alias("rs")), "reference_id")
    m = m.join(st.select(F.col("interval_id").alias("state_id"), F.col("start_us").alias("ss")), "state_id", "left")
    return metrics.timing_errors(m, ["corpus_id"], F.abs(F.col("rs") - F.col("ss")))


@query(f"""WITH {WD}, r AS (SELECT corpus_id, start_us, row_number() OVER (PARTITION BY corpus_id ORDER BY start_us, pos, word_no) AS k FROM wd),
h AS (SELECT corpus_id, start_us + (word_no * 37) % 101 * 1000 AS start_us, row_number() OVER (PARTITION BY corpus_id ORDER BY start_us, pos, word_no) AS k FROM wd WHERE word_no % 9 <> 0), e AS (SELECT corpus_id, abs(r.start_us - h.start_us) AS e FROM r JOIN h USING (corpus_id, k))
SELECT corpus_id, count(*) AS n, 0 AS unmatched, round(avg(e), 3) AS mean_us, median(e) AS median_us, max(e) AS longest_us FROM e GROUP BY corpus_id""")
def word_timing_error(spark, d):
    """Words of two transcripts by position, as far as the shorter goes: the other drops every ninth word and is late."""
    w = tables.words(spark, d)
    heard = w.where("word_no % 9 <> 0").withColumn("heard_us", F.col("start_us") + F.col("word_no") * 37 % 101 * 1000)
    pairs = metrics.zipped(w, heard, ["corpus_id"], ["start_us", "pos", "word_no"], "start_us", "heard_us")
    return metrics.timing_errors(pairs, ["corpus_id"], F.abs(F.col("start_us") - F.col("heard_us")))


@query(f"""WITH {EV}, {_SIDES}, x AS (SELECT r.corpus_id, r.interval_id AS segment_id, r.start_us AS rs, r.end_us AS re, greatest(r.start_us, s.start_us) AS s, least(r.end_us, s.end_us) AS e FROM ref r JOIN st s ON r.corpus_id = s.corpus_id AND s.start_us < r.end_us AND r.start_us < s.end_us),
c AS (SELECT corpus_id, interval_id AS segment_id, start_us AS t FROM ref UNION SELECT corpus_id, interval_id, end_us FROM ref UNION SELECT corpus_id, segment_id, s FROM x UNION SELECT corpus_id, segment_id, e FROM x),
p AS (SELECT corpus_id, segment_id, t AS start_us, lead(t) OVER (PARTITION BY corpus_id, segment_id ORDER BY t) AS end_us FROM c)
SELECT p.corpus_id, p.segment_id, p.start_us, p.end_us, count(x.s) AS active FROM p LEFT JOIN x ON x.corpus_id = p.corpus_id AND x.segment_id = p.segment_id AND x.s < p.end_us AND x.e > p.start_us WHERE p.end_us IS NOT NULL GROUP BY ALL""")
def cut_spans(spark, d):
    ev = tables.intervals(spark, d)
    return matching.cut_spans(ev.where("label = 'click'"), ev.where("label = 'view'"), BIN_US)


HOUR_US = 3_600_000_000


@query(f"WITH {PT} SELECT l.corpus_id, l.event_id AS left_id, r.event_id AS right_id, r.at_us - l.at_us AS delta_us FROM pt l JOIN pt r ON l.corpus_id = r.corpus_id AND r.at_us <> l.at_us AND abs(r.at_us - l.at_us) <= {HOUR_US}")
def competing_boundaries(spark, d):
    return matching.band_pairs(tables.points(spark, d), HOUR_US)


_NEW_ID = "CASE WHEN pos % 6 IN (2, 3) THEN concat('m', CAST({half} AS {text})) WHEN pos % 6 = 4 THEN concat('s', CAST(pos AS {text}), CASE WHEN word_no * 2 <= n_words THEN 'a' ELSE 'b' END) ELSE concat('u', CAST(pos AS {text})) END"


@query(f"""WITH {WD}, o AS (SELECT corpus_id, concat('u', CAST(pos AS VARCHAR)) AS old_id, concat(pos, '.', word_no) AS w FROM wd), n AS (SELECT corpus_id, {_NEW_ID.format(half='pos // 6', text='VARCHAR')} AS new_id, concat(pos, '.', word_no) AS w FROM wd WHERE pos % 6 <> 5 AND NOT (pos % 6 = 1 AND word_no = 1)),
no AS (SELECT corpus_id, old_id, count(*) AS n_old FROM o GROUP BY ALL), nn AS (SELECT corpus_id, new_id, count(*) AS n_new FROM n GROUP BY ALL), sh AS (SELECT corpus_id, old_id, new_id, count(*) AS n FROM o JOIN n USING (corpus_id, w) GROUP BY ALL),
t AS (SELECT no.corpus_id, no.old_id, sh.new_id, CASE WHEN n = n_old AND n = n_new THEN 3 WHEN n > 0 THEN 2 END AS tier FROM no LEFT JOIN sh USING (corpus_id, old_id) LEFT JOIN nn ON nn.corpus_id = no.corpus_id AND nn.new_id = sh.new_id),
b AS (SELECT * FROM t QUALIFY tier IS NULL OR tier = max(tier) OVER (PARTITION BY corpus_id, old_id)), k AS (SELECT *, count(new_id) OVER (PARTITION BY corpus_id, old_id) AS t2, count(old_id) OVER (PARTITION BY corpus_id, new_id) AS f2 FROM b)
SELECT corpus_id, old_id, new_id, CAST(tier AS BIGINT) AS tier, CASE WHEN new_id IS NULL THEN 'removed' WHEN t2 > 1 THEN 'split' WHEN f2 > 1 THEN 'merged' WHEN tier = 3 THEN 'unchanged' ELSE 'one_to_one' END AS change FROM k""")
def utterance_versions(spark, d):
    """Every sixth utterance is dropped, two are merged, one is split and one loses its first word."""
    w = tables.words(spark, d).withColumn("word_id", F.concat_ws(".", "pos", "word_no"))
    old = w.select("corpus_id", F.concat(F.lit("u"), "pos").alias("utterance_id"), "word_id")
    new = w.where("pos % 6 <> 5 and not (pos % 6 = 1 and word_no = 1)").select("corpus_id", F.expr(_NEW_ID.format(half="pos div 6", text="STRING")).alias("utterance_id"), "word_id")
    return matching.versions(old, new)


#: Speakers of the two sides: three labels; the system hears two hours late and takes every fourth for the next.
SPEAKERS, LATE_US = ["click", "error", "view"], 7_200_000_000


def _speakers(spark, d) -> tuple[DataFrame, DataFrame]:
    ev = tables.intervals(spark, d).where(F.col("label").isin(SPEAKERS))
    turned = F.when(F.col("label") == "click", "error").when(F.col("label") == "error", "view").otherwise("click")
    label = F.when(F.col("interval_id") % 4 == 0, turned).otherwise(F.col("label"))
    return ev, ev.select("corpus_id", "interval_id", label.alias("label"), (F.col("start_us") + LATE_US).alias("start_us"), (F.col("end_us") + LATE_US).alias("end_us"))


_SPEAKERS = f"""{EV}, rr AS (SELECT corpus_id, interval_id, label, start_us, end_us FROM ev WHERE label IN ('click', 'error', 'view')),
sy AS (SELECT corpus_id, interval_id, CASE WHEN interval_id % 4 <> 0 THEN label WHEN label = 'click' THEN 'error' WHEN label = 'error' THEN 'view' ELSE 'click' END AS label, start_us + {LATE_US} AS start_us, end_us + {LATE_US} AS end_us FROM rr)"""


def _unions(name: str, of: str, label: str = "label") -> str:
    by = f"corpus_id, {label}"
    return f"""{name}_f AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY {by} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {of}),
{name}_g AS (SELECT *, sum(f) OVER (PARTITION BY {by} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f), {name} AS (SELECT {by}, min(start_us) AS s, max(end_us) AS e FROM {name}_g GROUP BY {by}, g)"""


_WEIGHTS = f"{_SPEAKERS}, {_unions('ru', 'rr')}, {_unions('su', 'sy')}, cw AS (SELECT su.corpus_id, su.label AS system, ru.label AS reference, CAST(sum(least(su.e, ru.e) - greatest(su.s, ru.s)) AS BIGINT) AS weight_us FROM su JOIN ru ON su.corpus_id = ru.corpus_id AND su.s < ru.e AND ru.s < su.e GROUP BY ALL)"


@query(f"WITH {_WEIGHTS} SELECT * FROM cw")
def speaker_weights(spark, d):
    return matching.co_activity(*_speakers(spark, d), BIN_US)


_PAIRINGS = ", ".join(f"({k}, '{s}', '{r}')" for k, p in enumerate(permutations(SPEAKERS)) for s, r in zip(SPEAKERS, p, strict=True))


@query(f"WITH {_WEIGHTS}, pm(k, system, reference) AS (VALUES {_PAIRINGS}), pt AS (SELECT corpus_id, k, sum(weight_us) AS w FROM cw JOIN pm USING (system, reference) GROUP BY ALL) SELECT corpus_id, CAST(max(w) AS BIGINT) AS mapped_us FROM pt GROUP BY corpus_id")
def speaker_mapping(spark, d):
    """How long mapped speakers agree, under the best one-to-one mapping of each recording."""
    return matching.speaker_mapping(matching.co_activity(*_speakers(spark, d), BIN_US)).groupBy("corpus_id").agg(F.sum("weight_us").alias("mapped_us"))


COLLAR_US = 600_000_000


def error_sql(reference: str, system: str) -> str:
    return f"""{_unions('ru', reference)}, {_unions('su', system)}, cl AS (SELECT DISTINCT corpus_id, '' AS label, greatest(t - {COLLAR_US}, 0) AS start_us, t + {COLLAR_US} AS end_us FROM (SELECT corpus_id, unnest([start_us, end_us]) AS t FROM {reference})), {_unions('cu', 'cl')},
al AS (SELECT corpus_id, 'r' AS side, label, s, e FROM ru UNION ALL SELECT corpus_id, 's', label, s, e FROM su UNION ALL SELECT corpus_id, 'c', label, s, e FROM cu), bp AS (SELECT DISTINCT corpus_id, unnest([s, e]) AS s FROM al),
pc AS (SELECT corpus_id, s, lead(s) OVER (PARTITION BY corpus_id ORDER BY s) AS e FROM bp), ac AS (SELECT p.corpus_id, p.s, p.e, a.side, a.label FROM pc p JOIN al a ON a.corpus_id = p.corpus_id AND a.s < p.e AND p.s < a.e),
ct AS (SELECT corpus_id, e - s AS l, count(*) FILTER (WHERE side = 'r') AS nr, count(*) FILTER (WHERE side = 's') AS ns, count(*) FILTER (WHERE side <> 'c') - count(DISTINCT CASE WHEN side <> 'c' THEN label END) AS hit FROM ac GROUP BY corpus_id, s, e HAVING count(*) FILTER (WHERE side = 'c') = 0),
t AS (SELECT corpus_id, CAST(sum(nr * l) AS BIGINT) AS reference_us, CAST(sum(hit * l) AS BIGINT) AS correct_us, CAST(sum(greatest(nr - ns, 0) * l) AS BIGINT) AS missed_us, CAST(sum(greatest(ns - nr, 0) * l) AS BIGINT) AS false_alarm_us, CAST(sum((least(nr, ns) - hit) * l) AS BIGINT) AS confusion_us FROM ct GROUP BY corpus_id)
SELECT *, round((missed_us + false_alarm_us + confusion_us) / nullif(reference_us, 0), 9) AS der FROM t"""


@query(f"WITH {_SPEAKERS}, {error_sql('rr', 'sy')}")
def diarization_error(spark, d):
    return matching.error_components(*_speakers(spark, d), COLLAR_US, BIN_US)


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    p = tables.points(spark, d)
    return p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1")


@query(f"""WITH {PT}, a AS (SELECT corpus_id, label, count(*) AS r FROM pt WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT corpus_id, label, count(*) AS p FROM pt WHERE event_id % 2 = 1 GROUP BY ALL), j AS (SELECT label, coalesce(r, 0) AS r, coalesce(p, 0) AS p FROM a FULL JOIN b USING (corpus_id, label)),
s AS (SELECT label, CAST(sum(least(r, p)) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS n_p, CAST(sum(r) AS BIGINT) AS n_r FROM j GROUP BY label)
SELECT label, tp, n_p - tp AS fp, n_r - tp AS fn, round(tp / nullif(n_p, 0), 9) AS precision, round(tp / nullif(n_r, 0), 9) AS recall, round(2 * tp / nullif(n_p + n_r, 0), 9) AS f1 FROM s""")
def multiset_prf(spark, d):
    return metrics.multiset_scores(*_halves(spark, d), "corpus_id", "label")


@query(f"""WITH {PT}, a AS (SELECT corpus_id, list_distinct(list(label)) AS r FROM pt WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT corpus_id, list_distinct(list(label)) AS p FROM pt WHERE event_id % 2 = 1 GROUP BY ALL), j AS (SELECT len(list_intersect(r, p)) AS i, len(r) + len(p) - len(list_intersect(r, p)) AS u FROM a JOIN b USING (corpus_id))
SELECT count(*) AS n, CAST(sum(CASE WHEN i = u THEN 1 ELSE 0 END) AS BIGINT) AS exact, round(avg(round(i / u, 9)), 9) AS mean_jaccard FROM j""")
def label_set_agreement(spark, d):
    return metrics.set_agreement(*_halves(spark, d), "corpus_id", "label")


_SCORE = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value - floor(value) END"


@query(f"""WITH {PT}, s AS (SELECT CASE WHEN score IS NULL THEN 'unavailable' WHEN score < 0.5 THEN 'low' WHEN score < 0.8 THEN 'medium' ELSE 'high' END AS band FROM (SELECT {_SCORE} AS score FROM pt))
SELECT band, count(s.band) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('unavailable')) v(band) LEFT JOIN s USING (band) GROUP BY band""")
def confidence_histogram(spark, d):
    return metrics.confidence_bands(tables.points(spark, d).select(F.expr(_SCORE).alias("score")), "score")


@query(f"""WITH {PT}, s AS (SELECT corpus_id, event_id, {_SCORE} AS score FROM pt) SELECT corpus_id, event_id, CASE WHEN score >= 0.65 THEN 'speech' WHEN score <= 0.35 THEN 'non_speech' ELSE 'uncertain' END AS activity,
round(least(1, greatest(0, exp(-coalesce(score, 9)))), 9) AS text_confidence, CASE WHEN score IS NULL THEN 'information' WHEN score < 0.5 THEN 'warning' END AS region FROM s""")
def activity_classes(spark, d):
    s = tables.points(spark, d).select("corpus_id", "event_id", F.expr(_SCORE).alias("score"))
    return s.select("corpus_id", "event_id", metrics.activity_class(F.col("score")).alias("activity"), F.round(metrics.text_confidence(-F.coalesce("score", F.lit(9.0))), 9).alias("text_confidence"), metrics.region_severity(F.col("score"), 0.5).alias("region"))


_OBS = f"""{EV}, ob AS (SELECT interval_id, corpus_id, label, start_us, end_us, (interval_id * 37) % 101 / 100.0 AS confidence, interval_id % 2 AS method FROM ev)"""


@query(f"""WITH RECURSIVE {_OBS}, nx AS (SELECT a.interval_id AS a, b.interval_id AS b FROM ob a JOIN ob b ON a.corpus_id = b.corpus_id AND a.label = b.label AND a.start_us < b.end_us AND b.start_us < a.end_us AND (least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us)) * 2 >= greatest(a.end_us - a.start_us, b.end_us - b.start_us)),
re(a, b) AS (SELECT a, b FROM nx UNION SELECT re.a, nx.b FROM re JOIN nx ON re.b = nx.a), gr AS (SELECT a AS interval_id, min(b) AS group_id FROM re GROUP BY a)
SELECT corpus_id, label, group_id, count(*) AS n, round(least(1, CAST(max(confidence) AS DOUBLE) + CASE WHEN count(DISTINCT method) > 1 THEN 0.05 ELSE 0 END), 9) AS score FROM ob JOIN gr USING (interval_id) GROUP BY corpus_id, label, group_id""")
def act_candidates(spark, d):
    ob = tables.intervals(spark, d).select("interval_id", "corpus_id", "label", "start_us", "end_us", (F.col("interval_id") * 37 % 101 / 100).alias("confidence"), (F.col("interval_id") % 2).alias("method"))
    return matching.grouped_observations(ob)


_KIND = "SELECT corpus_id, pos, '{}' AS kind, unnest(list(pos) OVER (PARTITION BY {} ORDER BY pos ROWS BETWEEN {} AND {})) AS member FROM ut"


@query(f"""WITH {U}, fr AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY corpus_id ORDER BY pos) = speaker THEN 0 ELSE 1 END AS f FROM ut), rn AS (SELECT *, sum(f) OVER (PARTITION BY corpus_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM fr)
{_KIND.format('preceding', 'corpus_id', '4 PRECEDING', '1 PRECEDING')} UNION ALL {_KIND.format('following', 'corpus_id', '1 FOLLOWING', '4 FOLLOWING')} UNION ALL {_KIND.format('same_speaker', 'corpus_id, speaker', '6 PRECEDING', '1 PRECEDING')} UNION ALL {_KIND.format('exchange', 'corpus_id', '1 PRECEDING', '1 FOLLOWING')}
UNION ALL SELECT a.corpus_id, a.pos, 'current_turn', b.pos FROM rn a JOIN rn b ON a.corpus_id = b.corpus_id AND a.run = b.run
UNION ALL SELECT a.corpus_id, a.pos, 'temporal', b.pos FROM ut a JOIN ut b ON a.corpus_id = b.corpus_id AND greatest(a.start_us - b.end_us, b.start_us - a.end_us, 0) <= 30000000""")
def context_windows(spark, d):
    return context.windows(tables.utterances(spark, d))


@query()
def budgeted_context(spark, d):
    """Temporal windows under their budgets, with why each omitted member was left out; tested against a plain loop."""
    u = tables.utterances(spark, d)
    return context.budgeted(u, context.windows(u).where("kind = 'temporal'"))


@query()
def word_error_rate(spark, d):
    """Whole utterances against a hearing that drops every seventh word and takes every fifth for another; tested against a plain table."""
    u = tables.utterances(spark, d)
    return matching.word_errors(u.withColumn("heard", tables.heard()), ["corpus_id", "pos"], "text", "heard")


@query(f"WITH {EV} SELECT corpus_id, interval_id, name, CASE name WHEN 'early' THEN start_us WHEN 'middle' THEN start_us + greatest(0, (end_us - start_us - 5000000) // 2) ELSE start_us + greatest(0, end_us - start_us - 5000000) END AS at_us FROM ev, (VALUES ('early'), ('middle'), ('late')) v(name)")
def probe_positions(spark, d):
    ev = tables.intervals(spark, d)
    rest = F.greatest(F.lit(0), F.col("end_us") - F.col("start_us") - 5_000_000)
    places = [("early", F.col("start_us")), ("middle", F.col("start_us") + F.floor(rest / 2)), ("late", F.col("start_us") + rest)]
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("long").alias("at_us")) for n, c in places)))
    return ev.select("corpus_id", "interval_id", at.alias("p")).select("corpus_id", "interval_id", "p.name", "p.at_us")


@query(f"WITH {PT}, n AS (SELECT corpus_id, event_id, at_us, label, lag(label) OVER w AS before, lag(event_id) OVER w AS b FROM pt WINDOW w AS (PARTITION BY corpus_id ORDER BY at_us, event_id)) SELECT DISTINCT corpus_id, at_us FROM n WHERE b IS NOT NULL AND label IS DISTINCT FROM before")
def change_boundaries(spark, d):
    return context.change_boundaries(tables.points(spark, d))


@query(f"WITH {EV} SELECT corpus_id, label, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, round(sum(end_us - start_us) / sum(sum(end_us - start_us)) OVER (PARTITION BY corpus_id), 9) AS share FROM ev GROUP BY corpus_id, label")
def activity_summary(spark, d):
    return metrics.activity_summary(tables.intervals(spark, d))
