"""Registered queries on quotations, boundaries, candidates, repairs and labels, each beside the same question in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import alignment, context, intervals, ledger, matching, quotation, review
from colloquy.plans.discussion import _SPEAKERS, COLLAR_US, _speakers, _unions, error_sql
from colloquy.plans.queries import BIN_US, KEYS, query
from colloquy.sources import tables
from colloquy.sources.tables import EV, PT, U, WD

#: Width of the bins of joins within a conversation: a minute.
TALK_US = 60_000_000


@query()
def quotations(spark, d):
    return quotation.quotations(tables.utterances(spark, d), KEYS)


_MARKERS = ", ".join(f"('{m}', '{s}', '{k}')" for m, s, k in quotation.EMBEDDED)


@query(f"WITH {U} SELECT corpus_id, pos, marker, source, kind FROM ut JOIN (VALUES {_MARKERS}) v(marker, source, kind) ON contains(lower(text), marker)")
def embedded_sources(spark, d):
    return quotation.embedded_sources(tables.utterances(spark, d), KEYS)


@query()
def definition_parts(spark, d):
    return quotation.definitions(tables.utterances(spark, d), KEYS)


def _marked(pattern: str) -> str:
    return f"WITH {U} SELECT DISTINCT corpus_id, pos, unnest(regexp_extract_all(text, '{pattern}', 0, 'i')) AS marker FROM ut"


@query(_marked(quotation.PRESUPPOSED))
def presuppositions(spark, d):
    return quotation.marked(tables.utterances(spark, d), KEYS, quotation.PRESUPPOSED)


@query(_marked(quotation.TEMPORAL))
def temporal_references(spark, d):
    return quotation.marked(tables.utterances(spark, d), KEYS, quotation.TEMPORAL)


def _sides(spark, d):
    p = tables.points(spark, d)
    late = p.where("event_id % 5 <> 0").select("corpus_id", (F.col("at_us") + (F.col("event_id") * 7919 % 601 - 300) * 1000).alias("at_us"))
    return p.select("corpus_id", "at_us"), late


@query()
def boundary_matches(spark, d):
    """Greedy matches of points with a hearing that misses every fifth and is up to 0.3 seconds off; tested against a plain loop."""
    return alignment.boundary_scores(*_sides(spark, d))


@query()
def boundary_alignment(spark, d):
    """The most matches in order with the least distance; tested against all ways on small sets."""
    return alignment.boundary_scores(*_sides(spark, d), best=True)


@query()
def span_matches(spark, d):
    """Intervals with those of a hearing that is late by a fifth of each; tested against a plain loop."""
    ev = tables.intervals(spark, d)
    fifth = F.expr("(end_us - start_us) div 5 * (interval_id % 4)")
    return alignment.span_matches(ev, ev.withColumn("start_us", F.col("start_us") + fifth).withColumn("end_us", F.col("end_us") + fifth), BIN_US)


EXCLUSIVE = [["click", "view"], ["error", "purchase"]]
_SCORE = "(interval_id * 37) % 101 / 100.0"
_GROUPS = " OR ".join(f"(a.label IN ('{x}', '{y}') AND b.label IN ('{x}', '{y}'))" for x, y in EXCLUSIVE)
_EXCLUSIVE = f"""{EV}, ca AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS score FROM ev), ex AS (SELECT a.corpus_id, a.interval_id AS left_id, b.interval_id AS right_id, a.score AS left_score, b.score AS right_score FROM ca a JOIN ca b ON a.corpus_id = b.corpus_id AND a.interval_id < b.interval_id AND a.start_us < b.end_us AND b.start_us < a.end_us WHERE {_GROUPS})"""


def _candidates(spark, d):
    return tables.intervals(spark, d).withColumn("score", F.col("interval_id") * 37 % 101 / 100)


@query(f"WITH {_EXCLUSIVE} SELECT * FROM ex")
def exclusive_candidates(spark, d):
    return review.exclusive_pairs(_candidates(spark, d), EXCLUSIVE, BIN_US)


@query(f"""WITH {_EXCLUSIVE}, bo AS (SELECT * FROM ex WHERE least(left_score, right_score) >= 0.8), sa AS (SELECT corpus_id, left_id, right_id, left_id AS interval_id, CASE WHEN round(abs(left_score - right_score), 9) < 0.15 THEN 'unresolved' WHEN left_score <= right_score THEN 'rejected' END AS says FROM bo
UNION ALL SELECT corpus_id, left_id, right_id, right_id, CASE WHEN round(abs(left_score - right_score), 9) < 0.15 THEN 'unresolved' WHEN left_score > right_score THEN 'rejected' END FROM bo),
la AS (SELECT corpus_id, interval_id, says FROM sa WHERE says IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corpus_id, interval_id ORDER BY left_id DESC, right_id DESC) = 1),
di AS (SELECT ca.corpus_id, interval_id, score, coalesce(says, CASE WHEN score >= 0.8 THEN 'selected' ELSE 'deferred' END) AS d FROM ca LEFT JOIN la USING (corpus_id, interval_id))
SELECT corpus_id, interval_id, CASE WHEN d = 'selected' AND row_number() OVER (PARTITION BY corpus_id, d ORDER BY score DESC, interval_id) > 12 THEN 'deferred' ELSE d END AS disposition FROM di""")
def candidate_dispositions(spark, d):
    ca = _candidates(spark, d)
    return review.dispositions(ca, review.exclusive_pairs(ca, EXCLUSIVE, BIN_US))


@query(f"""WITH {WD}, b AS (SELECT corpus_id, start_us AS at_us, pos % 3 = 2 AS overlapped FROM ut)
SELECT w.corpus_id, at_us, pos, word_no, CASE WHEN overlapped THEN 'preserve_mixed_speaker_interval' WHEN least(at_us - start_us, end_us - at_us) <= 150000 THEN 'move_boundary' ELSE 'mark_unresolved' END AS action,
CASE WHEN overlapped OR least(at_us - start_us, end_us - at_us) > 150000 THEN NULL WHEN at_us - start_us <= end_us - at_us THEN start_us ELSE end_us END AS position_us FROM wd w JOIN b ON w.corpus_id = b.corpus_id AND start_us < at_us AND at_us < end_us""")
def turn_repairs(spark, d):
    starts = tables.utterances(spark, d).select("corpus_id", F.col("start_us").alias("at_us"), (F.col("pos") % 3 == 2).alias("overlapped"))
    return review.turn_repairs(tables.words(spark, d), starts, TALK_US)


_PIECES = f"""{U}, tm AS (SELECT corpus_id, start_us AS t FROM ut WHERE end_us > start_us UNION SELECT corpus_id, end_us FROM ut WHERE end_us > start_us), pc AS (SELECT corpus_id, t AS s, lead(t) OVER (PARTITION BY corpus_id ORDER BY t) AS e FROM tm),
af AS (SELECT pc.corpus_id, s, e, pos, speaker, start_us, end_us, row_number() OVER (PARTITION BY pc.corpus_id, s ORDER BY start_us, pos) AS k, count(*) OVER (PARTITION BY pc.corpus_id, s) AS n FROM pc JOIN ut ON ut.corpus_id = pc.corpus_id AND start_us < e AND s < end_us)"""


@query(f"WITH {_PIECES} SELECT corpus_id, s AS start_us, max(e) AS end_us, count(*) AS utterances, count(DISTINCT speaker) AS speakers FROM af WHERE n > 1 GROUP BY corpus_id, s")
def overlap_projection(spark, d):
    o = review.overlap_projection(tables.utterances(spark, d), TALK_US)
    return o.select("corpus_id", "start_us", "end_us", F.size("affected").cast("long").alias("utterances"), F.size(F.array_distinct(F.transform("affected", lambda x: x["speaker"]))).cast("long").alias("speakers"))


@query(f"""WITH {_PIECES}, nx AS (SELECT corpus_id, pos, speaker, text, end_us, lead(pos) OVER w AS np, lead(speaker) OVER w AS ns, lead(start_us) OVER w AS na FROM ut WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos)), pr AS (SELECT a.corpus_id, a.pos, b.pos AS np FROM af a JOIN af b USING (corpus_id, s) WHERE a.k = 1 AND b.k = 2 AND a.n = 2)
SELECT a.corpus_id, a.pos AS interrupted, b.pos AS interrupting, CASE WHEN a.speaker <> b.speaker THEN 'actual_simultaneous' ELSE 'uncertain' END AS kind, greatest(a.start_us, b.start_us) AS onset_us, a.end_us > b.start_us AS continues FROM af a JOIN af b USING (corpus_id, s) WHERE a.k = 1 AND b.k = 2
UNION ALL SELECT corpus_id, pos, np, 'immediate_turn_takeover', na, false FROM nx WHERE regexp_matches(rtrim(text), '(\\.\\.\\.|…|[-—–])$') AND na - end_us BETWEEN 0 AND 250000 AND speaker IS NOT NULL AND speaker IS DISTINCT FROM ns AND (corpus_id, pos, np) NOT IN (SELECT corpus_id, pos, np FROM pr)""")
def interruptions(spark, d):
    return review.interruptions(tables.utterances(spark, d), TALK_US)


@query(f"WITH {_PIECES} SELECT corpus_id, s AS start_us, max(e) AS end_us, CASE WHEN count(*) > 1 THEN 'OVERLAP: ' ELSE '' END || CASE WHEN count(DISTINCT speaker) > 1 THEN string_agg(speaker, ' | ' ORDER BY k) FILTER (WHERE speaker IS DISTINCT FROM fs OR k = 1) ELSE max(speaker) END AS label FROM (SELECT *, first(speaker) OVER (PARTITION BY corpus_id, s ORDER BY k) AS fs FROM af) GROUP BY corpus_id, s")
def speaker_labels(spark, d):
    return review.speaker_labels(tables.utterances(spark, d), TALK_US)


@query(f"WITH {EV} SELECT a.corpus_id, a.label, a.interval_id AS left_id, b.interval_id AS right_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) AS overlap_us FROM ev a JOIN ev b ON a.corpus_id = b.corpus_id AND a.label = b.label AND a.interval_id < b.interval_id AND a.start_us < b.end_us AND b.start_us < a.end_us")
def self_conflicts(spark, d):
    return review.self_conflicts(tables.intervals(spark, d), BIN_US)


@query(f"WITH {PT} SELECT corpus_id, at_us // 86400000000 AS turn, CASE WHEN min(label) = max(label) THEN min(label) END AS label FROM pt GROUP BY ALL")
def turn_clusters(spark, d):
    return review.agreed(tables.points(spark, d).withColumn("turn", F.expr("at_us div 86400000000")), ["corpus_id", "turn"], "label")


_TWICE = f"{EV}, tw AS (SELECT * FROM ev UNION ALL SELECT corpus_id, interval_id + 1000000000, label, start_us + CASE WHEN interval_id % 10 = 0 THEN 1 ELSE 0 END, end_us FROM ev WHERE interval_id % 3 = 0)"


@query(f"WITH {_TWICE}, ow AS (SELECT corpus_id, label, start_us, end_us, min(interval_id) AS canonical_id FROM tw WHERE interval_id < 1000000000 GROUP BY ALL) SELECT interval_id, canonical_id FROM tw LEFT JOIN ow USING (corpus_id, label, start_us, end_us) WHERE interval_id >= 1000000000")
def canonical_aliases(spark, d):
    """Every third interval seen again by a chunk that doesn't own it, every tenth a microsecond late."""
    ev = tables.intervals(spark, d)
    again = ev.where("interval_id % 3 = 0").withColumn("start_us", F.col("start_us") + F.when(F.col("interval_id") % 10 == 0, 1).otherwise(0)).withColumn("interval_id", F.col("interval_id") + 1_000_000_000)
    return review.aliases(ev.unionByName(again), ["corpus_id", "label", "start_us", "end_us"], F.col("interval_id") < 1_000_000_000)


@query()
def speech_clips(spark, d):
    """Clips of utterances; tested against a plain loop."""
    return review.clips(tables.utterances(spark, d))


@query()
def clip_segments(spark, d):
    u = tables.utterances(spark, d)
    return review.clip_segments(review.clips(u), u.withColumn("interval_id", F.col("pos")), TALK_US)


@query(f"""WITH {PT}, s AS (SELECT event_id, value - floor(value) AS x FROM pt) SELECT event_id, CASE WHEN x >= 0.75 THEN 'supports' WHEN x >= 0.6 THEN 'weakly_supports' WHEN x <= 0.2 THEN 'contradicts' WHEN x <= 0.35 THEN 'weakly_contradicts' WHEN x IS NOT NULL THEN 'inconclusive' END AS result,
round(least(1, greatest(0, (x - 0.1) / (0.9 - 0.1))), 9) AS support FROM s""")
def voice_comparisons(spark, d):
    s = tables.points(spark, d).select("event_id", (F.col("value") - F.floor("value")).alias("x"))
    return s.select("event_id", review.voice_result(F.col("x"), 0.75, 0.6, 0.2, 0.35).alias("result"), F.round(review.acoustic_support(F.col("x"), 0.1, 0.9), 9).alias("support"))


@query("SELECT lower(p_type) AS label, count(DISTINCT p_brand) AS owners FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1")
def shared_labels(spark, d):
    return review.shared_labels(tables.read(spark, d, "part"), "p_type", "p_brand")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS sha, strlen(text) AS size FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS sha, strlen(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS size FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' WHEN a.sha = b.sha AND a.size = b.size THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id)""")
def inventory_diff(spark, d):
    """Digests and sizes of two versions of a set of files: a full outer join by path."""

    def inventory(rows):
        return rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))

    t = tables.read(spark, d, "documents").where("text is not null")
    after = t.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return ledger.changes(inventory(t.where("doc_id % 11 <> 0")), inventory(after), "doc_id", ["sha", "size"])


@query(f"WITH {EV}, f AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY corpus_id, label ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ev WHERE end_us - start_us >= 60000000), g AS (SELECT *, sum(f) OVER (PARTITION BY corpus_id, label ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM f), m AS (SELECT corpus_id, label, g, min(start_us) AS s, max(end_us) AS e, count(*) AS n FROM g GROUP BY ALL) SELECT corpus_id, label, CAST(sum(n) AS BIGINT) AS members, CAST(sum(e - s) AS BIGINT) AS speech_us FROM m GROUP BY ALL")
def cluster_formation(spark, d):
    """Clusters of one label's eligible observations, a minute long at least, with the time they cover."""
    ok = tables.intervals(spark, d).where("end_us - start_us >= 60000000").withColumn("who", F.struct("corpus_id", "label"))
    m = intervals.merge_intervals(ok, "who")
    return m.groupBy("who").agg(F.sum("n").alias("members"), F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us")).select("who.*", "members", "speech_us")


_BINDINGS = f"""{EV}, bi AS (SELECT 'turn' AS scope, CAST(interval_id AS VARCHAR) AS target, label AS identity FROM ev WHERE interval_id % 50 = 0 UNION ALL SELECT DISTINCT 'cluster', corpus_id || '/' || label, label FROM ev WHERE corpus_id % 3 = 0 UNION ALL SELECT DISTINCT 'recording', CAST(corpus_id AS VARCHAR), 'view' FROM ev WHERE corpus_id % 7 = 0),
me AS (SELECT interval_id, identity FROM ev JOIN bi ON (scope = 'turn' AND target = CAST(interval_id AS VARCHAR)) UNION ALL SELECT interval_id, identity FROM ev JOIN bi ON scope = 'cluster' AND target = corpus_id || '/' || label UNION ALL SELECT interval_id, identity FROM ev JOIN bi ON scope = 'recording' AND target = CAST(corpus_id AS VARCHAR))"""


@query(f"""WITH {_BINDINGS}, co AS (SELECT interval_id, count(DISTINCT identity) AS identities, count(*) AS bindings FROM me GROUP BY interval_id)
SELECT interval_id, coalesce(identities, 0) AS identities, coalesce(bindings, 0) AS bindings, CASE WHEN identities > 1 THEN 'conflict' WHEN identities = 1 THEN 'bound' ELSE 'unbound' END AS status FROM ev LEFT JOIN co USING (interval_id)""")
def applicable_bindings(spark, d):
    """Bindings of every fiftieth turn, of every third recording's clusters and of every seventh recording."""
    ev = tables.intervals(spark, d)
    of = lambda rows, scope, identity, *target: rows.select(F.lit(scope).alias("scope"), F.concat_ws("/", *target).alias("target"), identity.alias("identity"))
    bindings = of(ev.where("interval_id % 50 = 0"), "turn", F.col("label"), "interval_id").union(of(ev.where("corpus_id % 3 = 0"), "cluster", F.col("label"), "corpus_id", "label").distinct()).union(of(ev.where("corpus_id % 7 = 0"), "recording", F.lit("view"), "corpus_id").distinct())
    return review.applicable_bindings(ev, bindings, {"turn": ["interval_id"], "cluster": ["corpus_id", "label"], "recording": ["corpus_id"]})


_WINDOWS = f"{_SPEAKERS}, st AS (SELECT corpus_id, CAST(interval_id % 3 AS VARCHAR) AS label, start_us, end_us FROM rr), {_unions('wi', 'st')}"
_CLIP = "SELECT t.corpus_id || '/' || w.label AS corpus_id, t.interval_id, t.label, greatest(t.start_us, w.s) AS start_us, least(t.end_us, w.e) AS end_us FROM {} t JOIN wi w ON t.corpus_id = w.corpus_id AND t.start_us < w.e AND w.s < t.end_us"


@query(f"WITH {_WINDOWS}, cr AS ({_CLIP.format('rr')}), cs AS ({_CLIP.format('sy')}), {error_sql('cr', 'cs')}")
def stratum_error(spark, d):
    """Error components within the turns of each stratum, here the interval's number by three."""
    ref, sys = _speakers(spark, d)
    strata = ref.select(F.struct("corpus_id", (F.col("interval_id") % 3).cast("string").alias("stratum")).alias("who"), "start_us", "end_us")
    windows = intervals.merge_intervals(strata, "who").select("who.*", "start_us", "end_us")
    return matching.error_components(review.clipped(ref, windows, BIN_US), review.clipped(sys, windows, BIN_US), COLLAR_US, BIN_US)


@query(f"""WITH {U}, cu AS (SELECT *, CASE WHEN start_us < max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM ut), rn AS (SELECT *, sum(cut) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us, pos ROWS UNBOUNDED PRECEDING) AS run FROM cu),
me AS (SELECT DISTINCT a.corpus_id, a.pos, b.run FROM ut a JOIN rn b ON a.corpus_id = b.corpus_id AND b.pos BETWEEN a.pos - 4 AND a.pos - 1) SELECT m.corpus_id, m.pos, r.pos AS member FROM me m JOIN rn r ON m.corpus_id = r.corpus_id AND m.run = r.run""")
def simultaneity_closure(spark, d):
    u = tables.utterances(spark, d)
    return review.simultaneous(u, context.windows(u).where("kind = 'preceding'"))


@query(f"WITH {EV} SELECT interval_id, start_us, end_us FROM ev WHERE start_us % {BIN_US} + end_us - start_us <= {BIN_US}")
def chunk_local_intervals(spark, d):
    ev = tables.intervals(spark, d).select("interval_id", (F.col("start_us") % BIN_US).alias("local"), (F.col("end_us") - F.col("start_us")).alias("length"), (F.col("start_us") - F.col("start_us") % BIN_US).alias("chunk"))
    return review.local_to_source(ev, F.lit(BIN_US), F.col("local"), F.col("length"), F.col("chunk")).select("interval_id", "start_us", "end_us")


@query()
def utterance_matches(spark, d):
    """Utterances with those of a hearing that drops words and merges every fourth with the next; tested against a plain loop."""
    w = tables.words(spark, d).withColumn("word_id", F.concat_ws(".", "pos", "word_no"))
    heard = w.where("word_no % 7 <> 3").withColumn("utterance_id", F.when(F.col("pos") % 4 == 3, F.col("pos") - 1).otherwise(F.col("pos")))
    cols = ["corpus_id", "utterance_id", "word_id", "start_us", "end_us"]
    return alignment.utterance_matches(w.withColumn("utterance_id", F.col("pos")).select(cols), heard.select(cols))
