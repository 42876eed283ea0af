"""Registered queries over the driver tables, each beside the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import metrics, text
from colloquy.operators import discourse, graph, intervals, ledger, sequence
from colloquy.sources import tables
from colloquy.sources.tables import CL, EV, LG, PT, U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Width of the bins of interval joins: ten hours.
BIN_US = 36_000_000_000
GAP_US = 6 * 3_600_000_000
KEYS = ["corpus_id", "pos"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ISLANDS = """
isl AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ev),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM isl),
mi AS (SELECT corpus_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM num GROUP BY corpus_id, island)"""


@query(f"WITH {EV}, {_ISLANDS} SELECT * FROM mi")
def interval_union(spark, d):
    return intervals.merge_intervals(tables.intervals(spark, d))


@query(f"WITH {EV}, {_ISLANDS} SELECT corpus_id, count(*) AS islands, CAST(sum(end_us - start_us) AS BIGINT) AS total_us FROM mi GROUP BY corpus_id")
def speech_islands(spark, d):
    return intervals.union_duration(tables.intervals(spark, d))


_STEPS = "st AS (SELECT corpus_id, start_us AS t, 1 AS d FROM ev UNION ALL SELECT corpus_id, end_us, -1 FROM ev)"


@query(f"WITH {EV}, {_STEPS}, lv AS (SELECT corpus_id, sum(d) OVER (PARTITION BY corpus_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS level FROM st) SELECT corpus_id, CAST(max(level) AS BIGINT) AS multiplicity FROM lv GROUP BY corpus_id")
def interval_coverage_multiplicity(spark, d):
    return intervals.coverage_multiplicity(tables.intervals(spark, d))


@query(f"""WITH {EV}, {_STEPS}, a AS (SELECT corpus_id, t, sum(d) AS step FROM st GROUP BY corpus_id, t),
p AS (SELECT corpus_id, t AS start_us, lead(t) OVER (PARTITION BY corpus_id ORDER BY t) AS end_us, CAST(sum(step) OVER (PARTITION BY corpus_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM a)
SELECT * FROM p WHERE end_us IS NOT NULL""")
def elementary_intervals(spark, d):
    return intervals.elementary_intervals(tables.intervals(spark, d))


@query(f"""WITH {EV} SELECT l.corpus_id, l.interval_id AS interval_id_l, r.interval_id AS interval_id_r, least(l.end_us, r.end_us) - greatest(l.start_us, r.start_us) AS overlap_us
FROM ev l JOIN ev r ON l.corpus_id = r.corpus_id AND l.interval_id < r.interval_id AND l.start_us < r.end_us AND r.start_us < l.end_us""")
def interval_overlap_pairs(spark, d):
    ev = tables.intervals(spark, d)
    return intervals.overlap_pairs(ev, ev, BIN_US).where("interval_id_l < interval_id_r").select("corpus_id", "interval_id_l", "interval_id_r", "overlap_us")


@query(f"""WITH {EV}, p AS (SELECT corpus_id, start_us + 7200000000 AS start_us, end_us + 3600000000 AS end_us FROM ev WHERE end_us - start_us > 3600000000), q AS (SELECT * FROM ev WHERE label = 'click'),
pi AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM p),
pn AS (SELECT *, sum(f) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS i FROM pi), pm AS (SELECT corpus_id, min(start_us) AS s, max(end_us) AS e FROM pn GROUP BY corpus_id, i),
qi AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM q),
qn AS (SELECT *, sum(f) OVER (PARTITION BY corpus_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS i FROM qi), qm AS (SELECT corpus_id, min(start_us) AS s, max(end_us) AS e FROM qn GROUP BY corpus_id, i),
pt AS (SELECT corpus_id, CAST(sum(e - s) AS BIGINT) AS p FROM pm GROUP BY 1), qt AS (SELECT corpus_id, CAST(sum(e - s) AS BIGINT) AS r FROM qm GROUP BY 1),
o AS (SELECT pm.corpus_id, CAST(sum(least(pm.e, qm.e) - greatest(pm.s, qm.s)) AS BIGINT) AS tp FROM pm JOIN qm ON pm.corpus_id = qm.corpus_id AND pm.s < qm.e AND qm.s < pm.e GROUP BY 1),
b AS (SELECT coalesce(pt.corpus_id, qt.corpus_id) AS corpus_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(tp, 0) AS tp FROM pt FULL JOIN qt USING (corpus_id) LEFT JOIN o ON o.corpus_id = coalesce(pt.corpus_id, qt.corpus_id))
SELECT corpus_id, tp AS tp_us, p - tp AS fp_us, r - tp AS fn_us, round(tp / nullif(p, 0), 9) AS precision, round(tp / nullif(r, 0), 9) AS recall, round(2 * tp / nullif(p + r, 0), 9) AS f1 FROM b""")
def activity_metrics(spark, d):
    ev = tables.intervals(spark, d)
    hour = 3_600_000_000
    late = ev.where(F.col("end_us") - F.col("start_us") > hour).withColumn("start_us", F.col("start_us") + 2 * hour).withColumn("end_us", F.col("end_us") + hour)
    return intervals.activity_metrics(late, ev.where("label = 'click'"), BIN_US)


#: A plan over a thousand hours by ten-hour chunks that overlap by half an hour.
PLAN = (3_600_000_000_000, 36_000_000_000, 1_800_000_000)
_PLAN_SQL = f"""pl AS (SELECT ordinal, ordinal * {PLAN[1] - PLAN[2]} AS start_us, least(ordinal * {PLAN[1] - PLAN[2]} + {PLAN[1]}, {PLAN[0]}) AS end_us,
CASE WHEN ordinal = 0 THEN 0 ELSE ordinal * {PLAN[1] - PLAN[2]} + {PLAN[2] // 2} END AS own_start_us, CASE WHEN ordinal = {-(-(PLAN[0] - PLAN[2]) // (PLAN[1] - PLAN[2])) - 1} THEN {PLAN[0]} ELSE (ordinal + 1) * {PLAN[1] - PLAN[2]} + {PLAN[2] // 2} END AS own_end_us
FROM range({-(-(PLAN[0] - PLAN[2]) // (PLAN[1] - PLAN[2]))}) t(ordinal))"""


@query(f"WITH {_PLAN_SQL} SELECT *, ordinal = (SELECT max(ordinal) FROM pl) AND end_us - start_us < {PLAN[1]} AS terminal_short FROM pl")
def chunk_plan(spark, d):
    return intervals.chunk_plan(spark, *PLAN)


@query(f"""WITH {PT}, {_PLAN_SQL}, z AS (SELECT min(at_us) AS zero FROM pt) SELECT ordinal, count(*) AS n FROM (SELECT at_us - zero AS at_us FROM pt, z) p JOIN pl ON p.at_us >= own_start_us AND p.at_us < own_end_us GROUP BY ordinal""")
def chunk_ownership(spark, d):
    p = tables.points(spark, d)
    zero = p.agg(F.min("at_us")).first()[0]
    return intervals.owned_by(p.withColumn("at_us", F.col("at_us") - F.lit(zero)), "at_us", *PLAN).groupBy("ordinal").agg(F.count("*").alias("n"))


_MAP = (1_000_000, 1_704_067_200_000_000, 1_705_276_800_000_000)
_BREAKS = (1_704_412_800_000_000, 1_704_758_400_000_000)


@query(f"""WITH {EV}, m AS (SELECT interval_id, start_us + {_MAP[0]} AS s, end_us + {_MAP[0]} AS e FROM ev),
n AS (SELECT *, CASE WHEN e <= {_MAP[1]} OR s >= {_MAP[2]} THEN 'unavailable' WHEN {' OR '.join(f'(s < {b} AND e > {b})' for b in _BREAKS)} THEN 'discontinuous' WHEN s < {_MAP[1]} OR e > {_MAP[2]} THEN 'clipped' ELSE 'exact' END AS mapping FROM m)
SELECT interval_id, mapping, CASE WHEN mapping <> 'unavailable' THEN greatest(s, {_MAP[1]}) END AS source_start_us, CASE WHEN mapping <> 'unavailable' THEN least(e, {_MAP[2]}) END AS source_end_us FROM n""")
def interval_mapping(spark, d):
    return intervals.map_interval(tables.intervals(spark, d), *_MAP, _BREAKS).select("interval_id", "mapping", "source_start_us", "source_end_us")


@query(f"""WITH {PT}, f AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id) <= {GAP_US} THEN 0 ELSE 1 END AS fresh FROM pt),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM f)
SELECT corpus_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(at_us) AS start_us, max(at_us) AS end_us FROM s GROUP BY corpus_id, session""")
def event_sessions(spark, d):
    s = sequence.sessions(tables.points(spark, d), GAP_US)
    return s.groupBy("corpus_id", "session").agg(F.count("*").alias("n"), F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"))


_RUNS = """f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id) = label THEN 0 ELSE 1 END AS fresh FROM pt),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM f)"""


@query(f"WITH {PT}, {_RUNS} SELECT corpus_id, run, label, count(*) AS n FROM r GROUP BY corpus_id, run, label")
def run_length_types(spark, d):
    return sequence.runs(tables.points(spark, d), "label").groupBy("corpus_id", "run", "label").agg(F.count("*").alias("n"))


@query(f"WITH {PT}, {_RUNS}, c AS (SELECT *, max(at_us) OVER (PARTITION BY corpus_id, run) - min(at_us) OVER (PARTITION BY corpus_id, run) AS lasts FROM r) SELECT corpus_id, event_id, CASE WHEN lasts < {GAP_US} THEN 'uncertain' ELSE label END AS label FROM c")
def short_run_demotion(spark, d):
    return sequence.demote_short_runs(tables.points(spark, d), "label", GAP_US, "uncertain").select("corpus_id", "event_id", "label")


@query(f"""WITH {U}, n AS (SELECT corpus_id, pos AS left_id, end_us, start_us, lead(pos) OVER w AS right_id, lead(start_us) OVER w AS ns FROM ut WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos))
SELECT corpus_id, left_id, right_id, ns - end_us AS gap_us, CASE WHEN ns = start_us THEN 'simultaneous_start' WHEN ns < end_us THEN 'overlapping' WHEN ns = end_us THEN 'touching' ELSE 'before' END AS relation FROM n WHERE right_id IS NOT NULL""")
def utterance_adjacency(spark, d):
    return sequence.adjacency(tables.utterances(spark, d))


@query(f"""WITH {U}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY start_us, pos) AS rank FROM ut),
c AS (SELECT l.corpus_id, l.pos AS left_id, x.pos AS right_id, x.start_us - l.end_us AS gap_us, row_number() OVER (PARTITION BY l.corpus_id, l.pos ORDER BY x.rank) AS k
FROM r l JOIN r x ON l.corpus_id = x.corpus_id AND l.speaker = x.speaker AND x.rank >= l.rank + 2 AND x.start_us >= l.end_us WHERE length(l.text) % 2 = 0)
SELECT corpus_id, left_id, right_id, gap_us FROM c WHERE k = 1 AND gap_us <= 90000000""")
def asof_continuation(spark, d):
    return sequence.continuations(tables.utterances(spark, d), 90_000_000, F.expr("length(text) % 2 = 0"))


@query(f"""WITH {PT}, p AS (SELECT s.corpus_id, s.event_id AS source_id, t.event_id AS target_id, s.at_us - t.at_us AS distance_us, rank() OVER (PARTITION BY s.event_id ORDER BY t.at_us DESC) AS k
FROM pt s JOIN pt t ON s.corpus_id = t.corpus_id AND t.at_us < s.at_us AND t.label = 'view' WHERE s.label = 'purchase')
SELECT s.corpus_id, s.event_id AS source_id, target_id, distance_us FROM pt s LEFT JOIN p ON p.source_id = s.event_id AND k = 1 WHERE s.label = 'purchase'""")
def nearest_prior(spark, d):
    return sequence.nearest_prior(tables.points(spark, d), F.col("label") == "purchase", F.col("label") == "view")


_KINDS = ["click", "purchase", "view"]


@query(f"WITH {PT} SELECT corpus_id, event_id, " + ", ".join(f"last_value(CASE WHEN label = '{k}' THEN event_id END IGNORE NULLS) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS latest_{k}" for k in _KINDS) + " FROM pt")
def last_state_fold(spark, d):
    return sequence.latest_of_kind(tables.points(spark, d), _KINDS)


@query(f"""WITH {PT}, s AS (SELECT corpus_id, at_us - lag(at_us) OVER (PARTITION BY corpus_id ORDER BY at_us, event_id) AS step FROM pt)
SELECT corpus_id, count(*) AS points, CAST(sum(CASE WHEN step > {GAP_US} THEN 1 WHEN step IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN step = 0 THEN 1 WHEN step IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS repeats, max(step) AS longest_us FROM s GROUP BY corpus_id""")
def packet_gaps(spark, d):
    return sequence.gaps(tables.points(spark, d), GAP_US)


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, d):
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return sequence.top_per_group(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")], 3).drop("o_orderdate")


@query("""SELECT p_brand, p_partkey, CASE WHEN rank = 1 THEN 'selected' ELSE 'rejected' END AS disposition FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type, p_partkey) AS rank FROM part)""")
def stream_rank(spark, d):
    p = tables.read(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    return sequence.dispositions(p, "p_brand", [F.desc("p_size"), F.col("p_type"), F.col("p_partkey")]).select("p_brand", "p_partkey", "disposition")


#: Spans of half a minute that overlap by five seconds, for owners of words.
SPAN_US, LAP_US = 30_000_000, 5_000_000


@query(f"""WITH {U}, w AS (SELECT corpus_id, pos, unnest(range(1, len(ws) + 1)) AS word_no, ws, start_us, end_us FROM (SELECT *, string_split(text, ' ') AS ws FROM ut)),
wt AS (SELECT corpus_id, pos, word_no, CAST(start_us + (word_no - 1) * ((end_us - start_us) // len(ws)) AS BIGINT) AS s, CAST(start_us + word_no * ((end_us - start_us) // len(ws)) AS BIGINT) AS e FROM w),
c AS (SELECT corpus_id, pos, word_no, span_id, least(e, span_id * {SPAN_US - LAP_US} + {SPAN_US}) - greatest(s, span_id * {SPAN_US - LAP_US}) AS ov
FROM (SELECT *, unnest(range(greatest(0, CAST(floor((s - {SPAN_US}) / {SPAN_US - LAP_US}) AS BIGINT)), CAST(floor(e / {SPAN_US - LAP_US}) AS BIGINT) + 1)) AS span_id FROM wt)),
r AS (SELECT *, row_number() OVER w AS k, lead(ov) OVER w AS second FROM c WHERE ov > 0 WINDOW w AS (PARTITION BY corpus_id, pos, word_no ORDER BY ov DESC, span_id * {SPAN_US - LAP_US}, span_id DESC))
SELECT corpus_id, pos, span_id, count(*) AS words, CAST(sum(CASE WHEN coalesce(second = ov, false) THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous FROM r WHERE k = 1 GROUP BY corpus_id, pos, span_id""")
def word_ownership_argmax(spark, d):
    step = SPAN_US - LAP_US
    u = tables.utterances(spark, d).withColumn("ws", F.split("text", " "))
    each = F.expr("(end_us - start_us) div size(ws)")
    w = u.withColumn("each", each).select("corpus_id", "pos", "start_us", "each", F.posexplode("ws").alias("i", "word"))
    w = w.select("corpus_id", "pos", (F.col("i") + 1).alias("word_no"), (F.col("start_us") + F.col("i") * F.col("each")).alias("s"), (F.col("start_us") + (F.col("i") + 1) * F.col("each")).alias("e"))
    c = w.withColumn("span_id", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("s") - SPAN_US) / step)), F.floor(F.col("e") / step)))).withColumn("span_start_us", F.col("span_id") * step)
    c = c.withColumn("overlap_us", F.least(F.col("e"), F.col("span_start_us") + SPAN_US) - F.greatest("s", "span_start_us"))
    return sequence.owners(c, ["corpus_id", "pos", "word_no"]).groupBy("corpus_id", "pos", "span_id").agg(F.count("*").alias("words"), F.sum(F.col("ambiguous").cast("long")).alias("ambiguous"))


@query(f"""WITH {U}, r AS (SELECT *, max(end_us) OVER (PARTITION BY corpus_id ORDER BY start_us, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ut),
g AS (SELECT *, CAST(sum(CASE WHEN start_us < reach THEN 0 ELSE 1 END) OVER (PARTITION BY corpus_id ORDER BY start_us, pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_no FROM r)
SELECT corpus_id, pos, group_no, CAST(row_number() OVER (PARTITION BY corpus_id, group_no ORDER BY start_us, pos) - 1 AS INTEGER) AS lane FROM g""")
def overlap_components(spark, d):
    return graph.overlap_groups(tables.utterances(spark, d)).select("corpus_id", "pos", "group_no", "lane")


@query("WITH RECURSIVE e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, after in graph.STAGES.items() for b in after) + "), r(stage, affected) AS (SELECT src, dst FROM e UNION SELECT r.stage, e.dst FROM r JOIN e ON r.affected = e.src) SELECT * FROM r")
def downstream_stages(spark, d):
    return graph.downstream(spark)


_CONTEXT = "SELECT corpus_id, pos, count(pos) OVER w AS members, CAST(coalesce(sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) END) OVER w, 0) AS BIGINT) AS context_tokens, min(pos) OVER w AS first_pos FROM ut WINDOW w AS (PARTITION BY {} ORDER BY pos ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


@query(f"WITH {U} " + _CONTEXT.format("corpus_id", 4))
def context_preceding(spark, d):
    return discourse.preceding_context(tables.utterances(spark, d), 4)


@query(f"WITH {U} " + _CONTEXT.format("corpus_id, speaker", 6))
def context_same_role(spark, d):
    return discourse.preceding_context(tables.utterances(spark, d), 6, same_speaker=True)


@query(f"""WITH {U}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY corpus_id ORDER BY pos) = speaker THEN 0 ELSE 1 END AS fresh FROM ut), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY corpus_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM f)
SELECT corpus_id, run, speaker, count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us FROM r GROUP BY corpus_id, run, speaker""")
def turn_runs(spark, d):
    r = sequence.runs(tables.utterances(spark, d), "speaker", order=("pos",))
    return r.groupBy("corpus_id", "run", "speaker").agg(F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


_RULES_SQL = "rl(rule_no, rule, strength, rx) AS (VALUES " + ", ".join("({}, '{}', CAST({} AS DOUBLE), '{}')".format(i, n, s, "(?i)" + p.replace("'", "''")) for i, (n, p, s) in enumerate(text.RULES)) + ")"
#: The SQL engine's word boundaries know ASCII only: other characters stand as a letter there.
_HITS = f"WITH {U}, up AS (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS plain FROM ut), {_RULES_SQL}, h AS (SELECT corpus_id, pos, speaker, rule, split_part(rule, '.', 1) AS family, strength, rule_no FROM up JOIN rl ON regexp_matches(plain, rx))"


def _hits(spark, d):
    return text.rule_hits(tables.utterances(spark, d), "text")


@query(_HITS + " SELECT corpus_id, pos, rule, family, strength FROM h")
def rule_presence(spark, d):
    return _hits(spark, d).select("corpus_id", "pos", "rule", "family", "strength")


@query(_HITS + " SELECT corpus_id, family, count(*) AS n, max(strength) AS strength FROM h GROUP BY corpus_id, family")
def act_family_counts(spark, d):
    return discourse.families(_hits(spark, d), ["corpus_id"])


@query(_HITS + " SELECT corpus_id, pos FROM up WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.corpus_id = up.corpus_id AND h.pos = up.pos)")
def unclassified(spark, d):
    return discourse.unclassified(tables.utterances(spark, d), _hits(spark, d), KEYS).select(*KEYS)


@query(_HITS + f""", q AS (SELECT DISTINCT corpus_id, pos FROM h WHERE family = 'question'),
c AS (SELECT a.corpus_id, a.pos AS answer_pos, b.pos AS question_pos, a.start_us - b.end_us AS distance_us, row_number() OVER (PARTITION BY a.corpus_id, a.pos ORDER BY b.pos DESC) AS rank
FROM up a JOIN up b ON a.corpus_id = b.corpus_id AND b.pos BETWEEN a.pos - {discourse.REACH} AND a.pos - 1 AND b.speaker <> a.speaker JOIN q ON q.corpus_id = b.corpus_id AND q.pos = b.pos
WHERE NOT EXISTS (SELECT 1 FROM q z WHERE z.corpus_id = a.corpus_id AND z.pos = a.pos))
SELECT corpus_id, answer_pos, question_pos, CAST(rank AS INTEGER) AS rank, distance_us FROM c WHERE rank <= {discourse.NEAREST}""")
def question_answer_links(spark, d):
    return discourse.question_answers(tables.utterances(spark, d), _hits(spark, d))


@query(_HITS + " SELECT a.corpus_id, a.pos, a.rule AS concession, b.rule AS qualification FROM h a JOIN h b ON a.corpus_id = b.corpus_id AND a.pos = b.pos WHERE a.family = 'concession' AND b.family = 'qualification'")
def concession_qualifications(spark, d):
    return discourse.qualified_concessions(_hits(spark, d))


@query(_HITS + """, p AS (SELECT * FROM h WHERE family = 'procedural')
SELECT corpus_id, pos, rule, last_value(CASE WHEN rule = 'procedural.time_warning' THEN pos END IGNORE NULLS) OVER w AS last_warning, last_value(CASE WHEN rule = 'procedural.topic_transition' THEN pos END IGNORE NULLS) OVER w AS last_transition,
max(CASE WHEN rule = 'procedural.time_expired' THEN 1 ELSE 0 END) OVER w = 1 AS time_expired, coalesce(last_value(CASE WHEN rule = 'procedural.floor_grant' THEN true WHEN rule = 'procedural.time_expired' THEN false END IGNORE NULLS) OVER w, false) AS floor_granted
FROM p WINDOW w AS (PARTITION BY corpus_id ORDER BY pos, rule_no ROWS UNBOUNDED PRECEDING)""")
def procedural_state(spark, d):
    return discourse.procedural_state(_hits(spark, d).where("family = 'procedural'"))


@query()
def rule_spans(spark, d):
    return text.rule_spans(tables.utterances(spark, d), KEYS, "text")


@query(f"""WITH {CL}, t AS (SELECT reference, predicted, count(*) AS n FROM cl GROUP BY 1, 2), a AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS tp FROM t),
r AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS r, CAST(sum(n) AS BIGINT) AS items FROM (SELECT sum(n) AS n FROM t GROUP BY reference)), p AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS p FROM (SELECT sum(n) AS n FROM t GROUP BY predicted)),
x AS (SELECT *, items * (items - 1) // 2 AS total FROM a, r, p)
SELECT tp, p - tp AS fp, r - tp AS fn, total - p - r + tp AS tn, round(tp / p, 9) AS precision, round(tp / r, 9) AS recall, round(2 * tp / (p + r), 9) AS f1, round((total - p - r + 2 * tp) / total, 9) AS rand_index FROM x""")
def cluster_pair_metrics(spark, d):
    return metrics.pair_confusion(tables.clusters(spark, d))


@query(f"""WITH {CL}, l AS (SELECT DISTINCT reference AS label FROM cl UNION SELECT DISTINCT predicted FROM cl),
n AS (SELECT label, count(*) FILTER (WHERE reference = label AND predicted = label) AS tp, count(*) FILTER (WHERE predicted = label AND reference <> label) AS fp, count(*) FILTER (WHERE reference = label AND predicted <> label) AS fn FROM l, cl GROUP BY label)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0.0) AS f1 FROM n""")
def label_prf(spark, d):
    return metrics.label_scores(tables.clusters(spark, d))


@query(f"""WITH c AS (SELECT CAST((doc_id % 101) / 100.0 AS DOUBLE) AS claimed, quality FROM labels WHERE quality IS NOT NULL), b AS (SELECT CASE WHEN claimed * 5 < 1 THEN 0 WHEN claimed * 5 < 2 THEN 1 WHEN claimed * 5 < 3 THEN 2 WHEN claimed * 5 < 4 THEN 3 ELSE 4 END AS bin, * FROM c)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(claimed), 9) AS mean_claimed, round(avg(CAST(quality AS DOUBLE)), 9) AS mean_correct FROM b GROUP BY bin""")
def reliability_bins(spark, d):
    c = tables.read(spark, d, "labels").select(((F.col("doc_id") % 101).cast("double") / 100).alias("claimed"), "quality")
    return metrics.reliability_bins(c, "claimed", "quality")


@query()
def text_error_rate(spark, d):
    """Of whole texts, in code points. A SQL engine's levenshtein counts bytes, so a test holds it against brute force."""
    ref = tables.read(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"))
    hyp = tables.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("hyp"))
    return metrics.char_error_rate(ref.join(hyp, "item_id"), "ref", "hyp").select("item_id", "distance", "cer")


@query()
def char_error_rate(spark, d):
    """Whole utterances, in code points, against a hearing that drops every seventh word and takes every fifth for another."""
    both = tables.utterances(spark, d).withColumn("heard", tables.heard())
    return metrics.char_error_rate(both, "text", "heard").select("corpus_id", "pos", "distance", "cer")


@query(f"WITH {LG} SELECT * FROM lg WHERE NOT EXISTS (SELECT 1 FROM lg s WHERE s.predecessor_id = lg.entry_id)")
def active_ledger(spark, d):
    return ledger.active(tables.ledger(spark, d)).select("target_id", "entry_id", "predecessor_id", "action", "at_us")


@query(f"WITH {LG} SELECT target_id, at_us, entry_id, action FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY at_us DESC, entry_id DESC) AS k FROM lg) WHERE k = 1")
def latest_ledger(spark, d):
    return ledger.latest(tables.ledger(spark, d).drop("predecessor_id"))


@query("SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1")
def ledger_conflicts(spark, d):
    return ledger.conflicts(tables.read(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 0 THEN 'X' ELSE o_orderstatus END AS expected, 'C' AS replacement FROM orders WHERE o_orderkey % 7 = 0)
SELECT o.o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'unchanged' WHEN c.expected = o.o_orderstatus THEN 'applied' ELSE 'stale' END AS status, CASE WHEN c.expected = o.o_orderstatus THEN c.replacement ELSE o.o_orderstatus END AS o_orderstatus FROM orders o LEFT JOIN c USING (o_orderkey)""")
def correction_apply(spark, d):
    o = tables.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    c = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(1).alias("seq"), F.expr("if(o_orderkey % 14 = 0, 'X', o_orderstatus)").alias("expected"), F.lit("C").alias("replacement"))
    return ledger.corrected(o, c, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "status", "o_orderstatus")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def propagation_diff(spark, d):
    o = tables.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return ledger.changes(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 9 = 0, 'Z', o_orderstatus)")), "o_orderkey", ["o_orderstatus"])


@query("""SELECT 'orphan_lineitem' AS finding, l_orderkey AS id FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'order_without_lines', o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'shipped_before_ordered', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def integrity_violations(spark, d):
    li, o = tables.read(spark, d, "lineitem"), tables.read(spark, d, "orders")
    lines, orders = li.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("shipped")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ordered"))
    both = ledger.sides(lines, orders, "id")
    early = F.col("shipped") < F.col("ordered")
    finding = F.when(~F.col("parent"), "orphan_lineitem").when(~F.col("child"), "order_without_lines").when(early, "shipped_before_ordered")
    return both.select(finding.alias("finding"), "id").where("finding is not null")


@query(f"""WITH {PT}, m AS (SELECT event_id, (at_us % 86400000000) // 1000 AS ms FROM pt) SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp FROM m""")
def ts_render(spark, d):
    return tables.points(spark, d).select("event_id", text.timestamp(F.col("at_us") % 86_400_000_000).alias("stamp"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row per conversation: tagged acts, linked answers, overlapping neighbours."""
    u = tables.utterances(spark, d)
    hits = text.rule_hits(u, "text")
    acts = hits.groupBy("corpus_id").agg(F.count("*").alias("acts"), F.count_distinct("family").alias("families"))
    links = discourse.question_answers(u, hits).where("rank = 1").groupBy("corpus_id").agg(F.count("*").alias("answers"))
    near = sequence.adjacency(u).groupBy("corpus_id").agg(F.count("*").alias("neighbours"), F.sum((F.col("relation") == "overlapping").cast("long")).alias("overlapping"))
    out = u.groupBy("corpus_id").agg(F.count("*").alias("utterances")).join(acts, "corpus_id", "left").join(links, "corpus_id", "left").join(near, "corpus_id", "left")
    return out.na.fill(0)
