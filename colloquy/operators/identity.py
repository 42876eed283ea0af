"""Who speaks, by human decisions over time: decisions in force, eight views, and comparisons of voices.

Decisions are a ledger (binding_id, action, identity, scope, target, made_us, expires_us, supersedes). One
is in force from the time it is made until it expires or another that names it in `supersedes` is made,
whichever is first; an expired successor does not bring its predecessor back. Nothing here binds an
identity by itself: hypotheses and comparisons are kept apart from decisions.

A null action, scope, target or time of making leaves a decision out of force for ever. Several decisions
may hold at once: where they agree they are one outcome, where not, a conflict that names them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.intervals import overlap_pairs
from colloquy.operators.review import acoustic_support, voice_result

#: Views, dispositions, labels and the actions that decide nothing about a turn.
VIEWS = ["raw_provider_diarization", "canonical_machine_diarization", "cluster_consistency", "unresolved_speaker", "identity_hypothesis", "reference_comparison", "manually_reviewed_identity", "binding_history"]
REVIEWED, CONFLICT_LABEL, UNKNOWN_LABEL, UNRESOLVED = "REVIEWED: ", "REVIEWED: CONFLICT", "REVIEWED: UNKNOWN", "MACHINE: UNRESOLVED"
PLACEHOLDER_ACTIONS = ["merge_identity_placeholders", "split_identity"]
#: Reasons why a comparison is invalid, in the order in which they are told.
REASONS = ["reference_replaced", "reference_expired", "reference_ineligible", "target_unknown", "outside_scope", "incompatible_space", "incompatible_channel", "unusable_target", "no_score", "outside_scale"]
ENTRY = ["view", "target", "target_kind", "disposition", "machine_label", "reviewed_label", "identities", "bindings", "evidence"]


def in_force(bindings: DataFrame) -> DataFrame:
    """The decisions with from_us and until_us (null: open), the half-open time in which each holds; those that never do are left out."""
    after = bindings.where("supersedes is not null and made_us is not null").groupBy(F.col("supersedes").alias("binding_id")).agg(F.min("made_us").alias("superseded_us"))
    rows = bindings.where("action is not null and scope is not null and target is not null and made_us is not null").join(after, "binding_id", "left")
    rows = rows.withColumn("from_us", F.col("made_us")).withColumn("until_us", F.least("expires_us", "superseded_us")).drop("superseded_us")
    return rows.where("until_us is null or until_us > from_us")


def at(bindings: DataFrame, at_us: int) -> DataFrame:
    """The decisions in force at a time."""
    return in_force(bindings).where((F.col("from_us") <= at_us) & (F.col("until_us").isNull() | (F.col("until_us") > at_us)))


def outcome(action: Column, identity: Column) -> Column:
    kind = F.when(action == "mark_unknown", "unknown").when(action == "reject_identity", "rejected").otherwise("bound")
    return F.struct(kind.alias("kind"), identity.alias("identity"))


def reviewed(turns: DataFrame, bindings: DataFrame, scopes: dict[str, list[str]], at_us: int, turn: str = "turn_id", narrowest: bool = False) -> DataFrame:
    """(turn, disposition, reviewed_label, identities, bindings) of every turn at a time.

    `scopes` names, narrowest first, the columns of a turn that a scope's target is compared with, joined by
    `/`; a column of arrays offers each element. All decisions that apply count, or, if `narrowest`, those of
    the narrowest scope that has any. Several outcomes are `conflicted`; a rejection puts no other identity
    in place; without a decision the turn is unknown and has no label. Decisions of one target are brought
    together before they meet turns, so a target with many turns meets one row.
    """
    live = at(bindings, at_us).where(~F.col("action").isin(PLACEHOLDER_ACTIONS))
    held = live.groupBy("scope", "target").agg(F.collect_set(outcome(F.col("action"), F.col("identity"))).alias("outcomes"), F.collect_set("binding_id").alias("ids"))
    met = None
    for place, (scope, columns) in enumerate(scopes.items()):
        listed = len(columns) == 1 and turns.schema[columns[0]].dataType.typeName() == "array"
        target = F.explode(F.col(columns[0]).cast("array<string>")) if listed else F.concat_ws("/", *columns)
        known = turns if listed else turns.dropna(subset=columns)
        one = known.select(turn, target.alias("target")).join(held.where(F.col("scope") == scope).drop("scope"), "target").select(turn, F.lit(place).alias("place"), "outcomes", "ids")
        met = one if met is None else met.union(one)
    if narrowest:
        first = met.groupBy(turn).agg(F.min("place").alias("place"))
        met = met.join(first, [turn, "place"])
    each = met.groupBy(turn).agg(F.array_distinct(F.flatten(F.collect_list("outcomes"))).alias("outcomes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("bindings"))
    out = turns.select(turn).join(each, turn, "left")
    kind, identity = F.col("outcomes")[0]["kind"], F.col("outcomes")[0]["identity"]
    one = F.size("outcomes") == 1
    disposition = F.when(F.size("outcomes") > 1, "conflicted").when(one & (kind == "bound") & identity.isNotNull(), "reviewed_identity").when(one & (kind == "rejected"), "rejected").otherwise("unknown")
    label = F.when(F.size("outcomes") > 1, CONFLICT_LABEL).when(one & (kind == "bound") & identity.isNotNull(), F.concat(F.lit(REVIEWED), identity.cast("string"))).when(one, UNKNOWN_LABEL)
    identities = F.array_sort(F.array_compact(F.array_distinct(F.transform("outcomes", lambda o: o["identity"]))))
    none = F.array().cast(each.schema["bindings"].dataType)
    return out.select(turn, disposition.alias("disposition"), label.alias("reviewed_label"), F.coalesce(identities, F.array().cast("array<string>")).alias("identities"), F.coalesce("bindings", none).alias("bindings"))


def decision_conflicts(bindings: DataFrame, at_us: int) -> DataFrame:
    """(scope, target, bindings): targets whose decisions in force disagree, with all of them."""
    live = at(bindings, at_us).where(~F.col("action").isin(PLACEHOLDER_ACTIONS))
    each = live.groupBy("scope", "target").agg(F.count_distinct(outcome(F.col("action"), F.coalesce(F.col("identity").cast("string"), F.lit("")))).alias("n"), F.array_sort(F.collect_set("binding_id")).alias("bindings"))
    return each.where("n > 1").drop("n")


def simultaneous_assignments(turns: DataFrame, resolved: DataFrame, bin_us: int, key: str = "corpus_id", turn: str = "turn_id") -> DataFrame:
    """(key, identity, left, right): turns of different clusters that overlap and bear one reviewed identity."""
    named = turns.join(resolved.where("disposition = 'reviewed_identity'").select(turn, F.col("identities")[0].alias("identity")), turn)
    who = named.select(F.struct(key, "identity").alias("who"), turn, "cluster", "start_us", "end_us")
    pairs = overlap_pairs(who, who, bin_us, "who").where(F.col(f"{turn}_l") < F.col(f"{turn}_r")).where(~F.col("cluster_l").eqNullSafe(F.col("cluster_r")))
    return pairs.select(f"who.{key}", "who.identity", F.col(f"{turn}_l").alias("left"), F.col(f"{turn}_r").alias("right"))


def identity_views(observations: DataFrame, turns: DataFrame, consistency: DataFrame, proposals: DataFrame, hypotheses: DataFrame, comparisons: DataFrame, bindings: DataFrame, scopes: dict[str, list[str]], at_us: int, narrowest: bool = False) -> DataFrame:
    """The eight views as one table (ENTRY): what machines said, what is open, what was decided, each apart.

    observations: observation_id, label, evidence; turns: turn_id, cluster (null: none or several), evidence
    and the columns of `scopes`; consistency: cluster, outliers, conflicts (numbers), evidence; proposals:
    proposal_id, open (boolean), evidence; hypotheses: hypothesis_id, identity, evidence; comparisons:
    comparison_id, identity, result, evidence; evidence is an array of strings. The history holds every
    decision, also those no longer in force.
    """
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")

    def entries(view: str, rows: DataFrame, target: Column, kind: str, disposition: Column, machine: Column = null, label: Column = null, identities: Column = none, bound: Column = none, evidence: Column | None = None) -> DataFrame:
        proof = F.coalesce(F.col("evidence") if evidence is None else evidence, none)
        return rows.select(F.lit(view).alias("view"), target.cast("string").alias("target"), F.lit(kind).alias("target_kind"), disposition.alias("disposition"), machine.alias("machine_label"), label.alias("reviewed_label"), identities.alias("identities"), bound.cast("array<string>").alias("bindings"), proof.alias("evidence"))

    info, machine = F.lit("informational"), F.coalesce(F.col("cluster").cast("string"), F.lit(UNRESOLVED))
    known = F.when(F.col("cluster").isNotNull(), "machine_cluster").otherwise("unknown")
    open_ = F.when((F.col("outliers") > 0) | (F.col("conflicts") > 0), "unresolved_proposal").otherwise("informational")
    decided = reviewed(turns, bindings, scopes, at_us, narrowest=narrowest).join(turns.select("turn_id", "cluster", "evidence"), "turn_id")
    past = F.when(F.col("action") == "mark_unknown", "unknown").when(F.col("action") == "reject_identity", "rejected").otherwise("informational")
    named = F.array_compact(F.array(F.col("identity").cast("string")))
    parts = [
        entries(VIEWS[0], observations, F.col("observation_id"), "provider_observation", info, F.col("label").cast("string")),
        entries(VIEWS[1], turns, F.col("turn_id"), "speaker_turn", known, machine),
        entries(VIEWS[2], consistency, F.col("cluster"), "cluster", open_, F.col("cluster").cast("string")),
        entries(VIEWS[3], turns.where("cluster is null"), F.col("turn_id"), "speaker_turn", F.lit("unknown"), machine),
        entries(VIEWS[3], proposals.where("open"), F.col("proposal_id"), "cluster", F.lit("unresolved_proposal")),
        entries(VIEWS[4], hypotheses, F.col("hypothesis_id"), "identity_hypothesis", info, identities=named),
        entries(VIEWS[5], comparisons, F.col("comparison_id"), "reference_comparison", F.when(F.col("result") == "comparison_invalid", "invalid_evidence").otherwise("informational"), identities=named),
        entries(VIEWS[6], decided, F.col("turn_id"), "speaker_turn", F.col("disposition"), machine, F.col("reviewed_label"), F.col("identities"), F.col("bindings")),
        entries(VIEWS[7], bindings, F.col("binding_id"), "manual_binding", past, null, F.when(F.col("action") == "mark_unknown", UNKNOWN_LABEL), named, F.array("binding_id"), none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles by built-in functions; null where lengths differ, or one is zero or not finite."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (F.abs(value) <= 1.5), value)


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, n, centroid) of the vectors of each value, componentwise means; nulls in them are left out of the mean."""
    parts = vectors.where(F.col(vector).isNotNull() & F.col(by).isNotNull()).select(by, F.posexplode(vector).alias("d", "x"))
    mean = parts.groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centroid"))


def compared(pairs: DataFrame, targets: DataFrame, references: DataFrame, at_us: int, low: float, high: float, bands: tuple[float, float, float, float]) -> DataFrame:
    """(target_id, reference_id, identity, score, reasons, result, support) of every asked pair.

    pairs: target_id, reference_id; targets: target_id, vector, space, scope, channel, quality; references:
    reference_id, identity, vector, space, scope, replaced (boolean), expires_us, accepted (boolean). The
    score is the cosine. Any reason in REASONS makes the comparison invalid; the bands are those of
    `voice_result`. Pairs that name an unknown reference are left out, as no identity is proposed. Targets
    and references are keyed; each pair is a row of two joins, never of a product.
    """
    t = targets.select("target_id", F.col("vector").cast("array<double>").alias("tv"), F.col("space").alias("ts"), F.col("scope").alias("tc"), "channel", "quality", F.lit(True).alias("known"))
    r = references.select("reference_id", "identity", F.col("vector").cast("array<double>").alias("rv"), F.col("space").alias("rs"), F.col("scope").alias("rc"), "replaced", "expires_us", "accepted")
    rows = pairs.select("target_id", "reference_id").join(r, "reference_id").join(t, "target_id", "left")
    rows = rows.withColumn("score", cosine(F.col("rv"), F.col("tv")))
    rows = rows.withColumn("outside", F.coalesce((F.col("score") < low) | (F.col("score") > high), F.lit(False)))
    tests = [
        F.coalesce("replaced", F.lit(False)), F.coalesce(F.col("expires_us") <= at_us, F.lit(False)), ~F.coalesce("accepted", F.lit(False)), F.col("known").isNull(), ~F.col("tc").eqNullSafe(F.col("rc")),
        ~F.col("ts").eqNullSafe(F.col("rs")), F.coalesce(F.col("channel") == "incompatible", F.lit(False)), F.coalesce(F.col("quality") == "unusable", F.lit(False)), F.col("score").isNull(), F.col("outside"),
    ]
    reasons = F.array_compact(F.array(*(F.when(test, reason) for test, reason in zip(tests, REASONS, strict=True))))
    rows = rows.withColumn("reasons", reasons).withColumn("score", F.when(~F.col("outside"), F.col("score")))
    result = F.when(F.size("reasons") > 0, "comparison_invalid").otherwise(voice_result(F.col("score"), *bands))
    return rows.select("target_id", "reference_id", "identity", "score", "reasons", result.alias("result"), F.when(F.size("reasons") == 0, acoustic_support(F.col("score"), low, high)).alias("support"))


def comparison_hypotheses(comparisons: DataFrame) -> DataFrame:
    """(target_id, identity, disposition, support, supporting, contrary): what positive valid comparisons propose.

    Of a target and identity there is one hypothesis: `supported` if any comparison supports it, else
    `proposed`; its support is the strongest. supporting and contrary are the reference ids of the pair's
    positive and negative comparisons, each once, in order. Negative ones alone propose nothing.
    """
    positive, negative = F.col("result").isin("supports", "weakly_supports"), F.col("result").isin("contradicts", "weakly_contradicts")
    each = comparisons.groupBy("target_id", "identity").agg(
        F.bool_or(F.col("result") == "supports").alias("strong"), F.max(F.when(positive, F.col("support"))).alias("support"),
        F.array_sort(F.collect_set(F.when(positive, F.col("reference_id")))).alias("supporting"), F.array_sort(F.collect_set(F.when(negative, F.col("reference_id")))).alias("contrary"),
    )
    return each.where("size(supporting) > 0").select("target_id", "identity", F.when(F.col("strong"), "supported").otherwise("proposed").alias("disposition"), "support", "supporting", "contrary")
