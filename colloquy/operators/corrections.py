"""Batches of corrections of ten kinds, replayed in order upon the segments of a recording.

An entry sees the state that earlier ones left: it may name the results of these, and is refused, with a
reason, where its expectation of the state fails. Entries alter only what lies in their affected interval,
so entries whose intervals overlap, directly or by others, form an island with the segments it touches;
islands are replayed apart, in any number of tasks, and segments outside all of them pass by. A recording
of any length is thus no group; a task holds one island, that is, the corrections of one passage.

Segments: key, segment_id (string), start_us, end_us, text, normalized, language, alternatives
(array<string>), annotations (array<string>). Corrections: key, seq (int, unique in a recording), kind, actor,
references (array<string>), from_us, to_us (the affected interval), targets (array<string>), prior and
proposed (arrays of structs; see PRIOR and PROPOSED). The n-th result of entry s has the id `c<s>.<n>`.

Null arrays count as empty. Rows without a key, and entries without an affected interval, are refused or
pass by: an entry whose from_us or to_us is null, or not in order, is `not_covered`. Segments without
start or end pass by. Further columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.intervals import overlap_pairs
from colloquy.sources.shared import kept

#: The kinds of corrections, and the actors that a policy may exclude.
KINDS = ["insertion", "deletion", "replacement", "split", "merge", "boundary_adjustment", "language_correction", "normalization_only", "uncertainty_annotation", "restore_earlier_candidate"]
ACTORS = ["human", "automated_process"]
SEGMENT = "segment_id string, start_us long, end_us long, text string, normalized string, language string, alternatives array<string>, annotations array<string>"
PRIOR = "array<struct<start_us: bigint, end_us: bigint, text: string, normalized: string, language: string>>"
PROPOSED = "array<struct<start_us: bigint, end_us: bigint, text: string, normalized: string, language: string, annotation: string, candidate: string>>"
FIELDS = ("start_us", "end_us", "text", "normalized", "language")
BIN_US = 600_000_000


def normalized(text: str | None) -> str:
    """Compatibility-composed text with single spaces, as segments of a transcript hold it."""
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


class Refused(Exception):
    """Says why an entry isn't applied."""


def need(holds: bool, reason: str) -> None:
    if not holds:
        raise Refused(reason)


def same(a: dict, b: dict, *but: str) -> bool:
    return all(a[f] == b[f] for f in FIELDS if f not in but)


def bounds(x: dict) -> tuple[int, int]:
    return x["start_us"], x["end_us"]


def shaped(kind: str, prior: list[dict], proposed: list[dict], targets: list[dict]) -> None:
    """What each kind asks of prior values, proposed values and, for restored candidates, of the target."""
    one = len(prior) == 1 and len(proposed) == 1
    if kind == "insertion":
        need(len(targets) == 1 and proposed != [], "wrong_count")
    elif kind == "deletion":
        need(prior != [] and proposed == [], "wrong_count")
    elif kind == "split":
        need(len(prior) == 1 and len(proposed) >= 2, "wrong_count")
        need(all(a["end_us"] == b["start_us"] for a, b in zip(proposed, proposed[1:], strict=False)), "not_contiguous")
        need((proposed[0]["start_us"], proposed[-1]["end_us"]) == bounds(prior[0]), "not_outer_span")
    elif kind == "merge":
        need(len(prior) >= 2 and len(proposed) == 1, "wrong_count")
        need(bounds(proposed[0]) == (prior[0]["start_us"], prior[-1]["end_us"]), "not_outer_span")
    else:
        need(one, "wrong_count")
        a, b = prior[0], proposed[0]
        if kind == "replacement":
            need(bounds(a) == bounds(b), "bounds_changed")
            need(a["text"] != b["text"], "nothing_changed")
        elif kind == "boundary_adjustment":
            need(same(a, b, "start_us", "end_us"), "content_changed")
            need(bounds(a) != bounds(b), "nothing_changed")
        elif kind == "language_correction":
            need(same(a, b, "language"), "content_changed")
            need(a["language"] != b["language"], "nothing_changed")
        elif kind == "normalization_only":
            need(same(a, b, "normalized"), "content_changed")
            need(a["normalized"] != b["normalized"], "nothing_changed")
        elif kind == "uncertainty_annotation":
            need(same(a, b), "content_changed")
            need(bool(b["annotation"]), "no_annotation")
        else:
            need(bounds(a) == bounds(b), "bounds_changed")
            need(b["candidate"] in targets[0]["alternatives"], "no_alternative")


def replayed(state: list[dict], entries: list[dict], actors: tuple[str, ...] = tuple(ACTORS), need_reference: bool = True) -> tuple[list[dict], list[tuple[int, str | None]]]:
    """The state after the entries, in their order, and of each its seq and the reason for refusal, or None."""
    told = []
    for e in sorted(entries, key=lambda x: x["seq"]):
        try:
            state = applied(state, e, actors, need_reference)
            told.append((e["seq"], None))
        except Refused as no:
            told.append((e["seq"], str(no)))
    return state, told


def applied(state: list[dict], e: dict, actors: tuple[str, ...], need_reference: bool) -> list[dict]:
    kind, prior, proposed = e["kind"], e["prior"], e["proposed"]
    need(kind in KINDS, "unknown_kind")
    need(e["actor"] in actors, "actor_excluded")
    need(bool(e["references"]) or not need_reference, "no_reference")
    need(e["targets"] != [], "wrong_count")
    place = {x["segment_id"]: i for i, x in enumerate(state)}
    need(all(t in place for t in e["targets"]), "unknown_target")
    at = [place[t] for t in e["targets"]]
    targets = [state[i] for i in at]
    if kind != "insertion":
        need(len(prior) == len(targets), "wrong_count")
    need(all(same(a, b) for a, b in zip(targets, prior, strict=False)), "stale_prior")
    need(at == list(range(at[0], at[0] + len(at))), "not_adjacent")
    need(all(None not in bounds(x) and x["start_us"] < x["end_us"] for x in proposed), "empty_interval")
    shaped(kind, prior, proposed, targets)
    if kind not in ("normalization_only", "uncertainty_annotation"):
        need(all(x["normalized"] == normalized(x["text"]) for x in proposed), "not_normalized")
    need(all(e["from_us"] <= a and b <= e["to_us"] for a, b in map(bounds, [*targets, *proposed])), "not_covered")
    replaced = targets if kind != "insertion" else []
    rest = [x for i, x in enumerate(state) if kind == "insertion" or i not in at]
    kept_notes = [n for x in replaced for n in x["annotations"]]
    alternatives = list(dict.fromkeys(n for x in replaced for n in x["alternatives"]))
    for n, x in enumerate(proposed):
        notes = kept_notes + ([x["annotation"]] if x["annotation"] else [])
        rest.append({**{f: x[f] for f in FIELDS}, "segment_id": f"c{e['seq']}.{n}", "alternatives": alternatives, "annotations": notes, "fixed": False})
    rest.sort(key=lambda x: (x["start_us"], x["segment_id"]))
    need(all(a["end_us"] <= b["start_us"] for a, b in zip(rest, rest[1:], strict=False) if not (a in state and b in state)), "overlaps")
    return rest


def islands(corrections: DataFrame, key: str) -> DataFrame:
    """The corrections with the number and the bounds of their island; affected intervals that only touch stay apart."""
    w = Window.partitionBy(key).orderBy("from_us", "to_us", "seq")
    reach = F.max("to_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = corrections.withColumn("fresh", F.when(F.col("from_us") < reach, 0).otherwise(1))
    return rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def segment_fields(kind: pa.StructType, names: list[str]) -> list[pa.Field]:
    return [kind.field(kind.get_field_index(n)).with_nullable(True) for n in names]


def replay(segments: DataFrame, corrections: DataFrame, key: str = "corpus_id", actors: tuple[str, ...] = tuple(ACTORS), need_reference: bool = True) -> tuple[DataFrame, DataFrame]:
    """(current, entries): the segments after all entries, and of each entry (key, seq, kind, status, reason).

    current: key, segment_id, start_us, end_us, text, normalized, language, alternatives, annotations.
    """
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    none = F.expr("cast(array() as array<string>)")
    segs = segments.select(key, *(F.coalesce(c, none).alias(c) if c in ("alternatives", "annotations") else F.col(c) for c in names))
    cols = [F.coalesce(c, none).alias(c) for c in ("references", "targets")] + [F.coalesce(F.col(c).cast(t), F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("prior", PRIOR), ("proposed", PROPOSED))]
    asked = corrections.select(key, F.col("seq").cast("int").alias("seq"), "kind", "actor", "from_us", "to_us", *cols)
    sound = F.coalesce(F.col("from_us") < F.col("to_us"), F.lit(False)) & F.col(key).isNotNull()
    numbered = kept(islands(asked.where(sound), key), "corrections-islands")
    spans = numbered.groupBy(key, "island").agg(F.min("from_us").alias("start_us"), F.max("to_us").alias("end_us"))
    near = overlap_pairs(segs.select(key, "segment_id", "start_us", "end_us"), spans, BIN_US, key)
    near = near.select(key, F.col("segment_id_l").alias("segment_id"), F.col("start_us_l").alias("start_us"), F.col("end_us_l").alias("end_us"), F.col("island_r").alias("island"), ((F.col("start_us_l") < F.col("start_us_r")) | (F.col("end_us_l") > F.col("end_us_r"))).alias("fixed"))
    near = kept(near, "corrections-near")
    held = segs.join(near, [key, "segment_id", "start_us", "end_us"])
    away = segs.join(near.where("not fixed").select(key, "segment_id").distinct(), [key, "segment_id"], "left_anti")
    seg_struct, corr_struct = F.struct(*names, "fixed").alias("segment"), F.struct("seq", "kind", "actor", "from_us", "to_us", "references", "targets", "prior", "proposed").alias("entry")
    rows = numbered.select(key, "island", corr_struct).unionByName(held.select(key, "island", seg_struct), allowMissingColumns=True)
    out = T.StructType([segments.schema[key], *T.StructType.fromDDL(SEGMENT).fields, T.StructField("seq", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k, state: list[dict], entries: list[dict]) -> list[dict]:
            state.sort(key=lambda x: (x["start_us"], x["segment_id"]))
            after, told = replayed(state, entries, actors, need_reference)
            kinds = {e["seq"]: e["kind"] for e in entries}
            got = [{key: k, **{n: x[n] for n in names}} for x in after if not x["fixed"]]
            return got + [{key: k, "seq": seq, "kind": kinds[seq], "reason": reason} for seq, reason in told]

        schema = None
        group, state, entries, ready = None, [], [], []
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(key), *segment_fields(batch.schema.field("segment").type, names), ("seq", pa.int32()), ("kind", pa.string()), ("reason", pa.string())])
            for row in batch.to_pylist():
                if group != (row[key], row["island"]):
                    if group:
                        ready += done(group[0], state, entries)
                    group, state, entries = (row[key], row["island"]), [], []
                if row["segment"] is not None:
                    state.append(row["segment"])
                else:
                    entries.append(row["entry"])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if group:
            yield pa.RecordBatch.from_pylist(ready + done(group[0], state, entries), schema)

    both = kept(rows.repartition(key, "island").sortWithinPartitions(key, "island").mapInArrow(run, out), "corrections-replayed")
    current = away.unionByName(both.where("seq is null").select(key, *names))
    outside = asked.where(~sound | sound.isNull()).select(key, "seq", "kind", F.lit("not_covered").alias("reason"))
    told = both.where("seq is not null").select(key, "seq", "kind", "reason").union(outside)
    return current, told.select(key, "seq", "kind", F.when(F.col("reason").isNull(), "applied").otherwise("refused").alias("status"), "reason")


def revision_findings(before: DataFrame, corrections: DataFrame, entries: DataFrame, current: DataFrame, key: str = "corpus_id") -> DataFrame:
    """(key, finding, id) where a revision's parts disagree; none for what `replay` made.

    overlap: a segment begins before the one before it ends, and did not in the version before; lost: a segment
    that no applied entry names, and that is gone; foreign: a current segment that is neither of the version
    before nor a result of an applied entry; unreplaced: a target of an applied entry (other than an
    insertion) that is still there; altered: a segment kept with other values.
    """
    w = Window.partitionBy(key).orderBy("start_us", "segment_id")
    done = corrections.join(entries.where("status = 'applied'").select(key, "seq"), [key, "seq"])
    named = done.where("kind <> 'insertion'").select(key, F.explode("targets").alias("segment_id")).distinct()
    results = done.select(key, F.posexplode(F.col("proposed")).alias("n", "p"), "seq").select(key, F.concat(F.lit("c"), "seq", F.lit("."), "n").alias("segment_id"))
    ids, old = current.select(key, "segment_id"), before.select(key, "segment_id")

    def met(df: DataFrame) -> DataFrame:
        return df.withColumn("met", F.lag("end_us").over(w) > F.col("start_us")).where("met").select(key, "segment_id")

    both = before.select(key, "segment_id", F.struct(*FIELDS).alias("a")).join(current.select(key, "segment_id", F.struct(*FIELDS).alias("b")), [key, "segment_id"])
    found = [
        ("overlap", met(current).join(met(before), [key, "segment_id"], "left_anti")),
        ("lost", old.join(ids, [key, "segment_id"], "left_anti").join(named, [key, "segment_id"], "left_anti")),
        ("foreign", ids.join(old, [key, "segment_id"], "left_anti").join(results, [key, "segment_id"], "left_anti")),
        ("unreplaced", named.join(ids, [key, "segment_id"], "left_semi")),
        ("altered", both.where(~F.col("a").eqNullSafe(F.col("b")))),
    ]
    out = None
    for name, df in found:
        part = df.select(key, F.lit(name).alias("finding"), F.col("segment_id").alias("id"))
        out = part if out is None else out.union(part)
    return out
