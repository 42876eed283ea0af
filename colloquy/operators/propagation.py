"""What a new version of a recording's utterances changes, and what must be rebuilt for it.

Observations belong to utterances, candidate sets to observations, acts to sets, and artifacts may depend
on acts, in any shape: cycles and hubs too. Nothing here rewrites an artifact; the results name ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.shared import dropped, kept

#: Kinds of change and the family that a change of quotations touches.
TEXT, BOUNDARY, SPEAKER, LABEL, QUOTATION, STRUCTURE, ADDED, REMOVED = "text", "boundary", "speaker_attribution", "display_label_only", "quotation_structure", "interruption_or_continuation", "added_utterance", "removed_utterance"
QUOTED_FAMILY = "quotation_and_attribution"
#: Shares into which the edges of one artifact are dealt, so that a hub's are no single task's.
SHARES = 16


def change_kinds(before: DataFrame, after: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """(keys, kinds) of every utterance that two versions tell apart.

    `columns` names, by kind, the columns whose values make it: of SPEAKER and LABEL, the label's count only
    where the speaker's agree. Values are compared null-safe; keys are unique and not null in each version.
    """
    used = sorted({c for cs in columns.values() for c in cs})
    a = before.select(*keys, F.struct(*used).alias("a"))
    b = after.select(*keys, F.struct(*used).alias("b"))

    def differs(kind: str) -> Column:
        return ~F.struct(*(F.col(f"a.{c}") for c in columns[kind])).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in columns[kind])))

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    found = [F.when(F.col("a").isNull(), ADDED), F.when(F.col("b").isNull(), REMOVED)]
    for kind in (TEXT, BOUNDARY, SPEAKER, LABEL, QUOTATION, STRUCTURE):
        if kind in columns:
            seen = differs(kind) if kind != LABEL or SPEAKER not in columns else differs(kind) & ~differs(SPEAKER)
            found.append(F.when(both & seen, kind))
    return a.join(b, keys, "full").select(*keys, F.array_compact(F.array(*found)).alias("kinds")).where("size(kinds) > 0")


def impacts(changes: DataFrame, observations: DataFrame, sets: DataFrame, acts: DataFrame, keys: list[str], identity: DataFrame | None = None) -> DataFrame:
    """Of every changed utterance (keys, kinds), the artifacts it invalidates and keeps: sorted arrays of ids.

    observations: keys, observation_id, family; sets: keys, set_id, observation_ids; acts: keys, act_id,
    set_id. Changed text or bounds, and additions and removals, invalidate all of an utterance's observations;
    changed quotations those of that family; a changed speaker all of them where `identity` (keys) says that
    the classification used who spoke. A set goes with any of its observations, an act with its set. Relations
    of acts are rebuilt where the act goes, and where interruptions or continuations changed.
    """
    known = identity.select(*keys, F.lit(True).alias("by_identity")).distinct() if identity is not None else None
    rows = changes.join(known, keys, "left") if known is not None else changes.withColumn("by_identity", F.lit(None).cast("boolean"))

    def has(kind: str) -> Column:
        return F.array_contains("kinds", kind)

    gone = F.arrays_overlap("kinds", F.array(*(F.lit(k) for k in (TEXT, BOUNDARY, REMOVED, ADDED)))) | (has(SPEAKER) & F.coalesce("by_identity", F.lit(False)))
    rows = rows.select(*keys, "kinds", gone.alias("gone"), has(QUOTATION).alias("quoted"), has(STRUCTURE).alias("structure"))
    obs = observations.join(rows, keys).where(F.col("gone") | (F.col("quoted") & (F.col("family") == QUOTED_FAMILY))).select(*keys, "observation_id")
    bad_sets = sets.select(*keys, "set_id", F.explode("observation_ids").alias("observation_id")).join(obs, [*keys, "observation_id"], "left_semi").select(*keys, "set_id").distinct()
    marked = acts.join(rows.select(*keys, "structure"), keys).join(bad_sets.withColumn("bad", F.lit(True)), [*keys, "set_id"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    def ids(df: DataFrame, column: str, name: str, when: Column | None = None) -> DataFrame:
        value = F.col(column) if when is None else F.when(when, F.col(column))
        return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))

    of_acts = marked.groupBy(*keys).agg(*(F.sort_array(F.collect_set(F.when(when, F.col("act_id")))).alias(n) for n, when in (("invalidated_acts", F.col("bad")), ("preserved_acts", ~F.col("bad")), ("rebuild_relations", F.col("bad") | F.col("structure")))))
    out = rows.select(*keys, "kinds")
    for part in (ids(obs, "observation_id", "invalidated_observations"), ids(bad_sets, "set_id", "invalidated_sets"), of_acts):
        out = out.join(part, keys, "left")
    empty = F.expr("cast(array() as array<string>)")
    lists = ["invalidated_observations", "invalidated_sets", "invalidated_acts", "preserved_acts", "rebuild_relations"]
    return out.select(*keys, "kinds", *(F.coalesce(F.col(c).cast("array<string>"), empty).alias(c) for c in lists))


def dependencies(observations: DataFrame, sets: DataFrame, acts: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) from what is used to what uses it; relations: (src, dst) between any artifacts."""
    edges = sets.select(F.explode("observation_ids").alias("src"), F.col("set_id").alias("dst")).union(acts.select("set_id", "act_id"))
    return edges if relations is None else edges.union(relations.select("src", "dst"))


def lowered(offered: DataFrame, best: DataFrame) -> DataFrame:
    """(node, round) of what is offered where it is new or lower than the best so far, as a written table."""
    least = offered.groupBy("node").agg(F.min("round").alias("round"))
    held = best.groupBy("node").agg(F.min("round").alias("held"))
    return kept(least.join(held, "node", "left").where("held is null or round < held").select("node", "round"), "propagation-lowered")


def reached(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, round) of all that depends on the seeds (node), they in round 0; the round is the fewest steps.

    Nodes with one dependent form chains, which may be as long as a recording: along these, ways are doubled, so
    a pass takes the logarithm of the longest chain in jobs; it ends at the first length that lowers no round,
    so cycles end it too. Then the other edges are followed one step, a hub's dealt over SHARES tasks,
    and what that lowers goes along the chains again. So the jobs grow with the branchings on a way, not with its
    length. Every step is a written table and reads few of them. `rounds` bounds the steps where only near
    dependents are asked for. Null nodes and edges with a null end are left out.
    """
    sound = kept(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "propagation-edges")
    degrees = sound.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    jumps = [kept(degrees.where("n = 1").select("src", "dst"), "propagation-jumps")]
    dealt = kept(sound.join(degrees.where("n > 1").select("src"), "src").withColumn("share", F.pmod(F.xxhash64("dst"), F.lit(SHARES))), "propagation-branches")
    shares = F.explode(F.array(*(F.lit(i).cast("long") for i in range(SHARES)))).alias("share")
    branches = not dealt.isEmpty()
    fresh = kept(seeds.where("node is not null").select("node", F.lit(0).alias("round")).distinct(), "propagation-lowered")
    best, done, turn = fresh, [sound, dealt], 0
    while True:
        moved, level = [fresh], 0
        while rounds is None or 1 << level <= rounds:
            if level == len(jumps):
                a, b = jumps[-1], jumps[-1].select(F.col("src").alias("dst"), F.col("dst").alias("to"))
                jumps.append(kept(a.join(b, "dst").select("src", F.col("to").alias("dst")), "propagation-jumps"))
            of = union(moved).groupBy("node").agg(F.min("round").alias("round")).withColumnRenamed("node", "src")
            offered = of.join(jumps[level], "src").select(F.col("dst").alias("node"), (F.col("round") + (1 << level)).alias("round"))
            better = lowered(offered if rounds is None else offered.where(F.col("round") <= rounds), union([best, *moved[1:]]))
            if better.isEmpty():
                dropped(better)
                break
            moved.append(better)
            level += 1
        of = union(moved).groupBy("node").agg(F.min("round").alias("round"))
        now = kept(union([best, *moved[1:]]).groupBy("node").agg(F.min("round").alias("round")), "propagation-reached")
        turn += 1
        after = None
        if branches and (rounds is None or turn <= rounds):
            met = of.select(F.col("node").alias("src"), "round", shares).join(dealt, ["src", "share"]).select(F.col("dst").alias("node"), (F.col("round") + 1).alias("round"))
            after = lowered(met if rounds is None else met.where(F.col("round") <= rounds), now)
        for part in (best, *moved[1:], *([fresh] if fresh is not best else [])):
            dropped(part)
        if after is None or after.isEmpty():
            for part in (*done, *jumps, *([after] if after is not None else [])):
                dropped(part)
            return now
        best = kept(union([now, after]).groupBy("node").agg(F.min("round").alias("round")), "propagation-reached")
        dropped(now)
        fresh = after


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
