"""Queries on who speaks: decisions over time, eight views, comparisons of vectors.

Long events are turns, a user is a recording and an event type a cluster. Purchases are decisions: what they
decide, on what and until when follows from their value and the digits in their properties. Vectors are
voices, labels identities.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import identity
from colloquy.plans.queries import BIN_US, query
from colloquy.sources import tables
from colloquy.sources.tables import EV, PT

#: The time that is asked about, 20 January 2024, and thirty days.
AT_US, MONTH_US = 1_705_708_800_000_000, 2_592_000_000_000
SCOPES = {"turn": ["turn_id"], "cluster": ["recording", "cluster"], "recording": ["recording"]}
#: Columns of a decision, in words that both SQL engines read: v is the value, k the number in props, last the user's last turn, type its cluster.
SCOPE = "CASE WHEN k < 40 THEN 'turn' WHEN k < 80 THEN 'cluster' ELSE 'recording' END"
TARGET = "CASE WHEN k < 40 THEN cast(last AS {0}) WHEN k < 80 THEN concat(cast(user_id AS {0}), '/', type) ELSE cast(user_id AS {0}) END"
ACTION = "CASE WHEN v - floor(v) < 0.1 THEN 'mark_unknown' WHEN v - floor(v) < 0.2 THEN 'reject_identity' WHEN v - floor(v) < 0.25 THEN 'split_identity' ELSE 'bind' END"
IDENTITY = "CASE WHEN v - floor(v) >= 0.1 THEN concat('p', cast(cast(floor(v / 8) AS int) AS {0})) END"
EXPIRES = f"CASE WHEN v > 10 AND v - floor(v) > 0.6 THEN made_us + {MONTH_US} // 6 END"


def turns(spark, d):
    """(corpus_id, turn_id, recording, cluster, start_us, end_us, evidence): errors have no cluster."""
    ev = tables.intervals(spark, d)
    return ev.select("corpus_id", F.col("interval_id").alias("turn_id"), F.col("corpus_id").alias("recording"), F.when(F.col("label") != "error", F.col("label")).alias("cluster"), "start_us", "end_us", F.array(F.col("interval_id").cast("string")).alias("evidence"))


def bindings(spark, d):
    """(binding_id, action, identity, scope, target, made_us, expires_us, supersedes, evidence)."""
    e = tables.read(spark, d, "events").select("user_id", "event_id", "event_type", F.col("value").alias("v"), F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("made_us"))
    w = Window.partitionBy("user_id").orderBy("made_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.floor(F.col("v") * 300) >= 1, F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    rows = e.withColumn("t", F.last(turn, True).over(w)).withColumns({"last": F.col("t.id"), "type": F.col("t.type")}).where("event_type = 'purchase' and last is not null")
    out = rows.select(F.col("event_id").cast("string").alias("binding_id"), F.expr(ACTION).alias("action"), F.expr(IDENTITY.format("string")).alias("identity"), F.expr(SCOPE).alias("scope"), F.expr(TARGET.format("string")).alias("target"), "made_us", F.expr(EXPIRES.replace("//", "div")).alias("expires_us"), "v", "event_id")
    before = F.lag("binding_id").over(Window.partitionBy("scope", "target").orderBy("made_us", "event_id"))
    return out.withColumn("supersedes", F.when(F.col("v") > 15, before)).drop("v", "event_id").withColumn("evidence", F.array("binding_id"))


_BINDINGS = f"""{EV}, tu AS (SELECT corpus_id, interval_id AS turn_id, corpus_id AS recording, CASE WHEN label <> 'error' THEN label END AS cluster, start_us, end_us FROM ev),
e0 AS (SELECT user_id, event_id, event_type, value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS made_us, CASE WHEN floor(value * 300) >= 1 THEN struct_pack(id := event_id, type := event_type) END AS t FROM events),
e1 AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY made_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e0),
e2 AS (SELECT user_id, event_id, event_type, v, k, made_us, p.id AS last, p.type AS type FROM e1 WHERE event_type = 'purchase' AND p IS NOT NULL),
b0 AS (SELECT CAST(event_id AS VARCHAR) AS binding_id, {ACTION} AS action, {IDENTITY.format('VARCHAR')} AS identity, {SCOPE} AS scope, {TARGET.format('VARCHAR')} AS target, made_us, {EXPIRES} AS expires_us, v, event_id FROM e2),
bi AS (SELECT *, CASE WHEN v > 15 THEN lag(binding_id) OVER (PARTITION BY scope, target ORDER BY made_us, event_id) END AS supersedes FROM b0),
fo AS (SELECT *, least(expires_us, (SELECT min(made_us) FROM bi s WHERE s.supersedes = bi.binding_id)) AS until_us FROM bi),
li AS (SELECT *, CASE action WHEN 'mark_unknown' THEN 'unknown' WHEN 'reject_identity' THEN 'rejected' ELSE 'bound' END AS kind FROM fo WHERE made_us <= {AT_US} AND (until_us IS NULL OR (until_us > {AT_US} AND until_us > made_us)) AND action <> 'split_identity'),
me AS (SELECT turn_id, 0 AS place, li.* FROM tu JOIN li ON scope = 'turn' AND target = CAST(turn_id AS VARCHAR) UNION ALL SELECT turn_id, 1, li.* FROM tu JOIN li ON scope = 'cluster' AND target = recording || '/' || cluster UNION ALL SELECT turn_id, 2, li.* FROM tu JOIN li ON scope = 'recording' AND target = CAST(recording AS VARCHAR))"""


def _resolved(met: str) -> str:
    return f"""ag AS (SELECT turn_id, count(DISTINCT kind || '|' || coalesce(identity, '')) AS n, min(kind) AS kind, min(identity) AS identity, array_to_string(list_sort(list_distinct(list(identity) FILTER (WHERE identity IS NOT NULL))), ',') AS identities, array_to_string(list_sort(list_distinct(list(binding_id))), ',') AS bindings FROM {met} GROUP BY turn_id),
rs AS (SELECT turn_id, recording, cluster, start_us, end_us, CASE WHEN n > 1 THEN 'conflicted' WHEN n = 1 AND kind = 'bound' THEN 'reviewed_identity' WHEN n = 1 AND kind = 'rejected' THEN 'rejected' ELSE 'unknown' END AS disposition,
CASE WHEN n > 1 THEN 'REVIEWED: CONFLICT' WHEN n = 1 AND kind = 'bound' THEN 'REVIEWED: ' || identity WHEN n = 1 THEN 'REVIEWED: UNKNOWN' END AS reviewed_label, coalesce(identities, '') AS identities, coalesce(bindings, '') AS bindings FROM tu LEFT JOIN ag USING (turn_id))"""


def _flat(df):
    return df.withColumns({c: F.array_join(c, ",") for c, t in df.dtypes if t.startswith("array")})


@query(f"WITH {_BINDINGS} SELECT binding_id, made_us AS from_us, until_us FROM fo WHERE until_us IS NULL OR until_us > made_us")
def decisions_in_force(spark, d):
    return identity.in_force(bindings(spark, d)).select("binding_id", "from_us", "until_us")


@query(f"WITH {_BINDINGS}, {_resolved('me')} SELECT turn_id, disposition, reviewed_label, identities, bindings FROM rs")
def reviewed_identities(spark, d):
    """Who every turn is said to be at a time, all scopes counting alike."""
    return _flat(identity.reviewed(turns(spark, d), bindings(spark, d), SCOPES, AT_US))


@query(f"WITH {_BINDINGS}, na AS (SELECT * FROM me QUALIFY place = min(place) OVER (PARTITION BY turn_id)), {_resolved('na')} SELECT turn_id, disposition, reviewed_label, identities, bindings FROM rs")
def narrowest_identities(spark, d):
    """The same by the narrowest scope that has a decision."""
    return _flat(identity.reviewed(turns(spark, d), bindings(spark, d), SCOPES, AT_US, narrowest=True))


@query(f"""WITH {_BINDINGS} SELECT scope, target, array_to_string(list_sort(list_distinct(list(binding_id))), ',') AS bindings FROM li GROUP BY scope, target HAVING count(DISTINCT kind || '|' || coalesce(identity, '')) > 1""")
def decision_conflicts(spark, d):
    return _flat(identity.decision_conflicts(bindings(spark, d), AT_US))


@query(f"""WITH {_BINDINGS}, {_resolved('me')}, na AS (SELECT * FROM rs WHERE disposition = 'reviewed_identity')
SELECT a.recording AS corpus_id, a.identities AS identity, a.turn_id AS left_id, b.turn_id AS right_id FROM na a JOIN na b ON a.recording = b.recording AND a.identities = b.identities AND a.turn_id < b.turn_id AND a.start_us < b.end_us AND b.start_us < a.end_us AND a.cluster IS DISTINCT FROM b.cluster""")
def simultaneous_identities(spark, d):
    t = turns(spark, d)
    return identity.simultaneous_assignments(t, identity.reviewed(t, bindings(spark, d), SCOPES, AT_US), BIN_US).withColumnsRenamed({"left": "left_id", "right": "right_id"})


#: Vectors of a label are compared with its reference and with the next label's. A reference expires where its label has fewer vectors than the mean, and is not accepted where it has most.
_VOICES = """em AS (SELECT vec_id, embedding, label FROM embeddings),
pa AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM em WHERE embedding IS NOT NULL AND label IS NOT NULL),
ce AS (SELECT label, list(m ORDER BY dim) AS rv, max(n) AS n FROM (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM pa GROUP BY label, dim) GROUP BY label),
rf AS (SELECT label AS reference_id, rv, n < (SELECT avg(n) FROM ce) AS expired, n < (SELECT max(n) FROM ce) AS accepted FROM ce),
pr AS (SELECT vec_id, embedding, label, unnest([label, (label + 1) % 10]) AS reference_id FROM em WHERE label IS NOT NULL),
sc AS (SELECT pr.*, rv, expired, accepted, list_sum(list_transform(list_zip(embedding, rv), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(rv, lambda x: x * x)))) AS score FROM pr JOIN rf USING (reference_id)),
rn AS (SELECT *, list_filter([CASE WHEN expired THEN 'reference_expired' END, CASE WHEN NOT accepted THEN 'reference_ineligible' END, CASE WHEN embedding[1] > 0.3 THEN 'incompatible_channel' END, CASE WHEN embedding[2] > 0.3 THEN 'unusable_target' END, CASE WHEN score IS NULL THEN 'no_score' END], lambda x: x IS NOT NULL) AS reasons FROM sc),
co AS (SELECT vec_id AS target_id, reference_id, 'p' || reference_id AS identity, round(score, 6) AS score, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN 'comparison_invalid' WHEN score >= 0.3 THEN 'supports' WHEN score >= 0.15 THEN 'weakly_supports' WHEN score <= -0.1 THEN 'contradicts' WHEN score <= 0 THEN 'weakly_contradicts' ELSE 'inconclusive' END AS result,
    CASE WHEN len(reasons) = 0 THEN round(least(1, greatest(0, (score + 1) / 2)), 6) END AS support FROM rn)"""


def comparisons(spark, d):
    e = tables.read(spark, d, "embeddings")
    mean = identity.centroids(e, "label")
    all_ = mean.agg(F.avg("n").alias("mean_n"), F.max("n").alias("max_n"))
    space = F.lit("space")
    refs = mean.join(F.broadcast(all_)).select(F.col("label").alias("reference_id"), F.concat(F.lit("p"), "label").alias("identity"), F.col("centroid").alias("vector"), space.alias("space"), space.alias("scope"), F.lit(False).alias("replaced"), F.when(F.col("n") < F.col("mean_n"), AT_US).alias("expires_us"), (F.col("n") < F.col("max_n")).alias("accepted"))
    x, y = F.try_element_at("embedding", F.lit(1)), F.try_element_at("embedding", F.lit(2))
    targets = e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vector"), space.alias("space"), space.alias("scope"), F.when(x > 0.3, "incompatible").alias("channel"), F.when(y > 0.3, "unusable").alias("quality"))
    pairs = e.where("label is not null").select(F.col("vec_id").alias("target_id"), F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("reference_id"))
    return identity.compared(pairs, targets, refs, AT_US, -1.0, 1.0, (0.3, 0.15, -0.1, 0.0))


@query(f"WITH {_VOICES} SELECT * FROM co")
def reference_comparisons(spark, d):
    """Cosines of vectors with the centroids of their label and of the next, with the reasons that make them invalid."""
    return _flat(comparisons(spark, d)).withColumns({"score": F.round("score", 6), "support": F.round("support", 6)})


_HYPOTHESES = """hy AS (SELECT target_id, identity, CASE WHEN bool_or(result = 'supports') THEN 'supported' ELSE 'proposed' END AS disposition, max(support) FILTER (WHERE result IN ('supports', 'weakly_supports')) AS support,
array_to_string(list_sort(list(reference_id) FILTER (WHERE result IN ('supports', 'weakly_supports'))), ',') AS supporting, coalesce(array_to_string(list_sort(list(reference_id) FILTER (WHERE result IN ('contradicts', 'weakly_contradicts'))), ','), '') AS contrary FROM co GROUP BY target_id, identity HAVING count(*) FILTER (WHERE result IN ('supports', 'weakly_supports')) > 0)"""


@query(f"WITH {_VOICES}, {_HYPOTHESES} SELECT * FROM hy")
def comparison_hypotheses(spark, d):
    return _flat(identity.comparison_hypotheses(comparisons(spark, d))).withColumn("support", F.round("support", 6))


@query(f"""WITH {_BINDINGS}, {_VOICES}, {_HYPOTHESES}, {_resolved('me')}, {PT},
vi AS (SELECT 'raw_provider_diarization' AS view, CAST(event_id AS VARCHAR) AS target, 'provider_observation' AS target_kind, 'informational' AS disposition, label AS machine_label, NULL AS reviewed_label, '' AS identities, '' AS bindings FROM pt
UNION ALL SELECT 'canonical_machine_diarization', CAST(turn_id AS VARCHAR), 'speaker_turn', CASE WHEN cluster IS NULL THEN 'unknown' ELSE 'machine_cluster' END, coalesce(cluster, 'MACHINE: UNRESOLVED'), NULL, '', '' FROM tu
UNION ALL SELECT 'cluster_consistency', cluster, 'cluster', CASE WHEN count(*) FILTER (WHERE end_us - start_us > 10000000000) > 0 THEN 'unresolved_proposal' ELSE 'informational' END, cluster, NULL, '', '' FROM tu WHERE cluster IS NOT NULL GROUP BY cluster
UNION ALL SELECT 'unresolved_speaker', CAST(turn_id AS VARCHAR), 'speaker_turn', 'unknown', 'MACHINE: UNRESOLVED', NULL, '', '' FROM tu WHERE cluster IS NULL
UNION ALL SELECT 'unresolved_speaker', binding_id, 'cluster', 'unresolved_proposal', NULL, NULL, '', '' FROM bi WHERE action = 'split_identity' AND scope = 'cluster'
UNION ALL SELECT 'identity_hypothesis', target_id || '/' || identity, 'identity_hypothesis', 'informational', NULL, NULL, identity, '' FROM hy
UNION ALL SELECT 'reference_comparison', target_id || '/' || reference_id, 'reference_comparison', CASE WHEN result = 'comparison_invalid' THEN 'invalid_evidence' ELSE 'informational' END, NULL, NULL, identity, '' FROM co
UNION ALL SELECT 'manually_reviewed_identity', CAST(turn_id AS VARCHAR), 'speaker_turn', disposition, coalesce(cluster, 'MACHINE: UNRESOLVED'), reviewed_label, identities, bindings FROM rs
UNION ALL SELECT 'binding_history', binding_id, 'manual_binding', CASE action WHEN 'mark_unknown' THEN 'unknown' WHEN 'reject_identity' THEN 'rejected' ELSE 'informational' END, NULL, CASE WHEN action = 'mark_unknown' THEN 'REVIEWED: UNKNOWN' END, coalesce(identity, ''), binding_id FROM bi)
SELECT * FROM vi""")
def identity_views(spark, d):
    t, b, c = turns(spark, d), bindings(spark, d), comparisons(spark, d)
    none = F.array().cast("array<string>").alias("evidence")
    observations = tables.points(spark, d).select(F.col("event_id").alias("observation_id"), "label", none)
    long = F.count_if(F.col("end_us") - F.col("start_us") > 10_000_000_000)
    consistency = t.where("cluster is not null").groupBy("cluster").agg(long.alias("outliers")).withColumns({"conflicts": F.lit(0), "evidence": F.array().cast("array<string>")})
    proposals = b.where("scope = 'cluster'").select(F.col("binding_id").alias("proposal_id"), (F.col("action") == "split_identity").alias("open"), none)
    hypotheses = identity.comparison_hypotheses(c).select(F.concat_ws("/", F.col("target_id").cast("string"), "identity").alias("hypothesis_id"), "identity", F.col("supporting").cast("array<string>").alias("evidence"))
    asked = c.select(F.concat_ws("/", F.col("target_id").cast("string"), F.col("reference_id").cast("string")).alias("comparison_id"), "identity", "result", none)
    return _flat(identity.identity_views(observations, t, consistency, proposals, hypotheses, asked, b, SCOPES, AT_US).drop("evidence"))
