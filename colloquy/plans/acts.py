"""Registered queries on acts' attributes and targets, references, timelines and vectors, each beside the same question in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import acts
from colloquy.plans.queries import query
from colloquy.sources import tables
from colloquy.sources.tables import LG, PT

#: Act types that events stand for in turn, by their number.
TYPES = sorted({t for _, table, _ in acts.ATTRIBUTES for t in table} | {"case_citation", "hypothetical_example", "information_question"})


def _values(rows) -> str:
    return "(VALUES " + ", ".join(str(tuple(r)) for r in rows) + ")"


_TYPED = f"{PT}, ac AS (SELECT event_id, event_id % 5 = 0 AS quoted, {TYPES}[event_id % {len(TYPES)} + 1] AS act_type FROM pt)"
_SHOWN = ", ".join(f"coalesce({n}.v, '{d}') AS {n}" if d else f"{n}.v AS {n}" for n, _, d in acts.ATTRIBUTES)
_JOINS = " ".join(f"LEFT JOIN {_values(t.items())} {n}(k, v) ON {n}.k = act_type" for n, t, _ in acts.ATTRIBUTES)


@query(f"""WITH {_TYPED} SELECT event_id, act_type, {_SHOWN}, CASE WHEN act_type = 'hypothetical_example' THEN 'hypothetical' WHEN quoted THEN 'quoted' WHEN act_type = 'case_citation' THEN 'real' ELSE 'uncertain' END AS reality FROM ac {_JOINS}""")
def act_attributes(spark, d):
    """Attributes of acts; events stand for acts of all types in turn."""
    p = tables.points(spark, d).select("event_id", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % len(TYPES) + 1).cast("int")).alias("act_type"))
    return acts.attributes(p).withColumn("reality", acts.reality(F.col("act_type"), F.col("event_id") % 5 == 0))


@query(f"""WITH {PT}, pr AS (SELECT event_id AS act_id, ['question', 'discourse_act', 'utterance'][event_id % 3 + 1] AS t, ['identified', 'probable', 'multiple_candidate_targets', 'unresolved'][event_id % 4 + 1] AS s, event_id FROM pt WHERE label <> 'view'),
na AS (SELECT act_id, t, s, event_id - 1 AS id FROM pr UNION ALL SELECT act_id, t, s, event_id - 2 FROM pr UNION ALL SELECT act_id, t, s, event_id - 3 FROM pr),
qu AS (SELECT event_id AS q, event_id + 1 AS a, event_id // 4 * 4 AS u FROM pt WHERE label = 'view'),
hi AS (SELECT act_id, s, q FROM na JOIN qu ON t = 'question' AND id = q UNION ALL SELECT act_id, s, q FROM na JOIN qu ON t = 'discourse_act' AND id = a UNION ALL SELECT act_id, s, q FROM na JOIN qu ON t = 'utterance' AND id = u)
SELECT act_id, q AS question_id, CASE WHEN bool_or(s IN ('identified', 'probable')) THEN 'target' ELSE 'alternative' END AS role FROM hi GROUP BY ALL""")
def explicit_targets(spark, d):
    """Views stand for questions, up to four to an utterance; other events for acts that name the three before them."""
    p = tables.points(spark, d)
    e = F.col("event_id")
    proposals = p.where("label <> 'view'").select(
        e.alias("act_id"),
        F.element_at(F.array(*map(F.lit, ("question", "discourse_act", "utterance"))), (e % 3 + 1).cast("int")).alias("target_type"),
        F.element_at(F.array(*map(F.lit, ("identified", "probable", "multiple_candidate_targets", "unresolved"))), (e % 4 + 1).cast("int")).alias("target_status"),
        (e - 1).alias("target_id"),
        F.array(e - 2, e - 3).alias("alternative_ids"),
    )
    return acts.explicit_targets(proposals, p.where("label = 'view'").select(e.alias("question_id"), (e + 1).alias("source_act_id"), F.expr("event_id div 4 * 4").alias("utterance_id")))


@query("""WITH pa AS (SELECT p_partkey, lower(p_type) AS term FROM part WHERE p_type IS NOT NULL), n AS (SELECT term, count(DISTINCT p_partkey) - 1 AS peers, min(p_partkey) AS first FROM pa GROUP BY term) SELECT DISTINCT p_partkey, term, peers, first FROM pa JOIN n USING (term)""")
def definition_peers(spark, d):
    """Parts stand for acts that define the term of their type."""
    return acts.term_peers(tables.read(spark, d, "part"), "p_partkey", "p_type")


_LICENSES = ["licensed", "permission_granted", "public_domain", "restricted", "unknown"]
_BASES = ["consent_recorded", "lawful_basis_recorded", "pending"]
_QUALITIES = ["acceptable", "acceptable", "marginal", "unusable"]
_MIXES = ["clean", "clean", "possible", "contaminated", "unknown"]


@query(f"""WITH {PT}, r AS (SELECT event_id, {_LICENSES}[event_id % 5 + 1] AS l, {_BASES}[event_id // 5 % 3 + 1] AS b, {_QUALITIES}[event_id // 15 % 4 + 1] AS q, {_MIXES}[event_id // 60 % 5 + 1] AS m, CAST(floor(value * 100000) AS BIGINT) AS us FROM pt),
f AS (SELECT event_id, concat_ws(',', CASE WHEN l IN ('restricted', 'unknown') THEN 'license' END, CASE WHEN b = 'pending' THEN 'lawful_use' END, CASE WHEN q = 'unusable' THEN 'unusable_audio' END, CASE WHEN coalesce(us, 0) < 2000000 THEN 'short_speech' END, CASE WHEN m = 'contaminated' THEN 'contaminated' END) AS no,
concat_ws(',', CASE WHEN q = 'marginal' THEN 'marginal_audio' END, CASE WHEN m IN ('possible', 'unknown') THEN 'contamination_possible' END) AS maybe FROM r)
SELECT event_id, CASE WHEN no <> '' THEN 'invalid' WHEN maybe <> '' THEN 'warning' ELSE 'valid' END AS result, concat_ws(',', nullif(no, ''), nullif(maybe, '')) AS findings FROM f""")
def enrollment_findings(spark, d):
    """Events stand for voice references of all combinations of rights and quality."""

    def one_of(values, step):
        return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(event_id div {step} % {len(values)} + 1 as int)"))

    r = tables.points(spark, d).select(
        "event_id", one_of(_LICENSES, 1).alias("license_status"), one_of(_BASES, 5).alias("lawful_use_status"), one_of(_QUALITIES, 15).alias("audio_quality"), one_of(_MIXES, 60).alias("contamination"), F.floor(F.col("value") * 100_000).cast("long").alias("speech_us")
    )
    return acts.enrolled(r).select("event_id", "result", F.array_join("findings", ",").alias("findings"))


#: The time that enrolment is asked at: 1996-01-01.
AT_US = 820_454_400_000_000


@query(f"WITH {LG} SELECT target_id, arg_max(action, (at_us, entry_id)) = 'O' AS enrolled FROM lg WHERE at_us <= {AT_US} GROUP BY target_id")
def enrollment_at(spark, d):
    """Orders stand for a reference's events: those of status O enrol it, others end that."""
    e = tables.ledger(spark, d).select("target_id", "at_us", F.col("entry_id").alias("event_id"), F.when(F.col("action") == "O", "enrolled").otherwise("revoked").alias("kind"))
    return acts.enrolled_at(e, AT_US, "target_id")


@query("SELECT o_custkey, o_orderpriority, count(*) AS hypotheses, count(DISTINCT o_orderstatus) AS identities FROM orders WHERE o_totalprice > 50000 GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def competing_hypotheses(spark, d):
    """Customers as targets, priorities as scopes, states as identities; orders over 50,000 are open."""
    return acts.competing(tables.read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", F.col("o_totalprice") > 50_000)


_RATES = ["30/1", "60/2", "30000/1001", "0/0", "25"]


@query(f"""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS cs, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 1000 END AS cd, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 END AS st, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 13 END AS vt, {_RATES}[o_orderkey % 5 + 1] AS a, {_RATES}[o_orderkey // 5 % 5 + 1] AS r FROM orders),
t AS (SELECT k, coalesce(cs, least(st, vt), 0) AS start_us, coalesce(cd, greatest(st + 20, vt + k % 30) - coalesce(cs, least(st, vt), 0)) AS duration_us, a <> r AND a <> '0/0' AND r <> '0/0' AND NOT (a IN ('30/1', '60/2') AND r IN ('30/1', '60/2')) AS variable_rate FROM s)
SELECT k, start_us, duration_us, variable_rate, CASE WHEN duration_us IS NULL THEN 'unavailable' WHEN duration_us <= 0 THEN 'not_positive' ELSE 'ok' END AS status FROM t""")
def source_timelines(spark, d):
    """Orders stand for recordings whose container or streams lack some times."""
    k = F.col("o_orderkey")
    rate = lambda of: F.element_at(F.array(*map(F.lit, _RATES)), (of % 5 + 1).cast("int"))
    s = tables.read(spark, d, "orders").select(
        k.alias("k"), F.when(k % 3 != 0, k % 7).alias("container_start_us"), F.when(k % 4 == 0, k % 1000).alias("container_duration_us"), F.when(k % 5 != 0, k % 11).alias("audio_start_us"), F.lit(20).alias("audio_duration_us"),
        F.when(k % 6 != 0, k % 13).alias("video_start_us"), (k % 30).alias("video_duration_us"), rate(k).alias("average_rate"), rate(F.expr("o_orderkey div 5")).alias("real_rate"),
    )
    return acts.timelines(s).select("k", "start_us", "duration_us", "variable_rate", "status")


_CODECS = ["video", "audio", "subtitle", "dvb", "data"]


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_CODECS}[(l_orderkey + l_linenumber) % 5 + 1] AS c, l_partkey % 4 = 0 AS pic FROM lineitem), k AS (SELECT *, CASE WHEN pic THEN 'attachment' WHEN c = 'dvb' THEN 'unknown' ELSE c END AS kind FROM s)
SELECT l_orderkey, l_linenumber, kind, kind = 'audio' AS for_audio, kind IN ('video', 'attachment') AS for_video FROM k""")
def stream_candidates(spark, d):
    """Lines stand for streams of a recording; every fourth part for an attached picture."""
    kind = acts.stream_kind(F.element_at(F.array(*map(F.lit, _CODECS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int")), F.col("l_partkey") % 4 == 0)
    s = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))
    return s.withColumns({"for_audio": acts.is_candidate(F.col("kind"), "audio"), "for_video": acts.is_candidate(F.col("kind"), "video")})


@query("""WITH r AS (SELECT DISTINCT c_custkey AS run FROM customer), v AS (SELECT o_custkey AS run, o_orderkey % 2 = 1 OR o_custkey % 3 = 0 AS st, NOT (o_custkey % 5 = 0 AND o_orderkey % 4 = 0) AS ve, CASE WHEN o_custkey % 7 = 0 THEN o_orderstatus ELSE 'F' END AS sp FROM orders),
n AS (SELECT run, count(*) AS vectors, count(*) FILTER (WHERE st) AS stored, count(*) FILTER (WHERE st AND ve) AS verified, count(DISTINCT sp) AS spaces FROM v GROUP BY run), m AS (SELECT run, coalesce(vectors, 0) AS vectors, coalesce(stored, 0) AS stored, coalesce(verified, 0) AS verified, coalesce(spaces, 0) AS spaces FROM r LEFT JOIN n USING (run))
SELECT *, CASE WHEN verified < stored OR spaces > 1 THEN 'blocked_integrity' WHEN vectors >= 2 AND stored = vectors THEN 'qualified_for_controlled_comparison' WHEN vectors > 0 THEN 'qualified_metadata_only' ELSE 'insufficient_evidence' END AS disposition FROM m""")
def vector_spaces(spark, d):
    """Customers stand for runs, their orders for stored or omitted vectors of one space or several."""
    v = tables.read(spark, d, "orders").selectExpr("o_custkey AS run", "o_orderkey % 2 = 1 OR o_custkey % 3 = 0 AS stored", "NOT (o_custkey % 5 = 0 AND o_orderkey % 4 = 0) AS verified", "if(o_custkey % 7 = 0, o_orderstatus, 'F') AS space")
    return acts.vector_spaces(v, tables.read(spark, d, "customer").select(F.col("c_custkey").alias("run")), "run", ["space"])
