"""Append-only ledgers whose entries name the digest of the one before: sealing, verification, the chain that survives.

Entries: key (the ledger), entry_id, predecessor_id (null: the first), predecessor_digest, content (string),
digest and made_us. An entry's digest is the SHA-256 of its predecessor's digest, its id and its content, so
each is verified by itself, and each link by one join: nothing runs through a ledger in order, however long
it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.shared import dropped, kept

#: Kinds of queued reviews, in the order of their urgency, with the actions they propose.
QUEUES = {
    "integrity_warning": ["defer_decision"],
    "conflicting_speaker_attribution": ["flag_uncertain_speaker_attribution", "defer_decision"],
    "correction_affected_utterance": ["approve_utterance", "defer_decision"],
    "word_crossing_speaker_boundary": ["move_boundary", "split_utterance", "defer_decision"],
    "likely_turn_repair": ["move_boundary", "split_utterance", "defer_decision"],
    "low_confidence_segmentation": ["approve_utterance", "split_utterance", "defer_decision"],
    "uncertain_speaker_boundary": ["flag_uncertain_speaker_attribution", "move_boundary"],
    "uncertain_overlap_attribution": ["flag_uncertain_speaker_attribution", "defer_decision"],
    "unresolved_interruption": ["mark_interruption", "remove_incorrect_interruption"],
    "unresolved_continuation": ["link_continuation", "unlink_continuation"],
    "uncertain_quotation": ["revise_quotation_span", "change_quotation_type"],
    "probable_self_repair": ["approve_utterance", "flag_uncertain_text"],
    "long_utterance": ["split_utterance", "approve_utterance"],
    "very_short_fragment": ["merge_utterances", "approve_utterance"],
}
LONG_US, SHORT_US = 30_000_000, 300_000
FINDINGS = ["altered", "broken_link", "gap", "fork", "several_roots", "repeated_id", "out_of_time", "cut_off"]


def digest(before: Column, entry: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(before, F.lit("")), entry.cast("string"), F.coalesce(content, F.lit(""))), 256)


def sealed(entries: DataFrame, key: str = "ledger") -> DataFrame:
    """Entries with predecessor_id, predecessor_digest and digest, chained by made_us, then entry_id.

    Digests build upon each other, so the entries of one ledger that are sealed at once are one row meanwhile:
    seal a batch of decisions, not a history. `append` continues a chain.
    """
    return append(None, entries, key)


def append(ledger: DataFrame | None, entries: DataFrame, key: str = "ledger") -> DataFrame:
    """The new entries, chained to the last of `ledger` (that no entry names as its predecessor; of several, the latest).

    Further columns of the entries, which must have an order, stay with them.
    """
    more = [c for c in entries.columns if c not in (key, "made_us", "entry_id", "content")]
    batch = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("made_us", "entry_id", "content", *more))).alias("es"))
    if ledger is not None:
        named = ledger.where("predecessor_id is not null").select(key, F.col("predecessor_id").alias("entry_id")).distinct()
        last = ledger.join(named, [key, "entry_id"], "left_anti").groupBy(key).agg(F.max_by(F.struct("entry_id", "digest"), F.struct("made_us", "entry_id")).alias("last"))
        batch = batch.join(last, key, "left")
        first, first_id = F.col("last.digest"), F.col("last.entry_id")
    else:
        first, first_id = F.lit(None).cast("string"), F.lit(None).cast(entries.schema["entry_id"].dataType)
    start = F.array(F.coalesce(first, F.lit("")))
    digests = F.aggregate("es", start, lambda a, e: F.concat(a, F.array(digest(F.element_at(a, -1), e["entry_id"], e["content"]))))
    rows = batch.select(key, digests.alias("ds"), first.alias("d0"), first_id.alias("i0"), "es", F.posexplode("es").alias("i", "e"))
    before = F.get("es", F.col("i") - 1)["entry_id"]
    return rows.select(
        key, F.col("e.entry_id").alias("entry_id"), F.when(F.col("i") == 0, F.col("i0")).otherwise(before).alias("predecessor_id"), F.when(F.col("i") == 0, F.col("d0")).otherwise(F.get("ds", F.col("i"))).alias("predecessor_digest"),
        F.col("e.content").alias("content"), F.get("ds", F.col("i") + 1).alias("digest"), F.col("e.made_us").alias("made_us"), *(F.col(f"e.{c}").alias(c) for c in more),
    )


def packed(digest: Column) -> Column:
    """A digest in half its bytes: lower-case hexadecimals as what they spell, all else as it is, told apart by the first byte."""
    plain = F.lower(F.hex(F.unhex(digest))).eqNullSafe(digest)
    return F.when(plain, F.concat(F.lit(b"\x00"), F.unhex(digest))).when(digest.isNotNull(), F.concat(F.lit(b"\x01"), digest.cast("binary")))


def links(ledger: DataFrame, key: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(entries, links), written tables: each entry with `more`; and (key, entry_id, predecessor_id, made_us, chosen, tests) of each.

    An entry meets its predecessor in one join; what is asked of its siblings and twins is asked on both
    sides of that. `chosen` says that its link holds and is the one that stays; `tests` are those of FINDINGS but the last.
    """
    intact = F.col("digest").eqNullSafe(digest(F.col("predecessor_digest"), F.col("entry_id"), F.col("content")))
    entries = kept(ledger.select(key, "entry_id", "predecessor_id", "made_us", packed(F.col("predecessor_digest")).alias("named"), packed(F.col("digest")).alias("own"), intact.alias("intact"), *more), "chains-entries")
    by_id = Window.partitionBy(key, "entry_id")
    rows = entries.select(key, "entry_id", "predecessor_id", "made_us", "named", "own", "intact", F.count("*").over(by_id).alias("twins"), F.row_number().over(by_id.orderBy(F.desc("intact"), "made_us", "own")).alias("r"))
    good = F.col("intact") & (F.col("r") == 1)
    up = rows.groupBy(key, F.col("entry_id").alias("predecessor_id")).agg(F.collect_set("own").alias("ups"), F.min("made_us").alias("up_us"), F.max(F.when(good, F.col("own"))).alias("up"))
    met = rows.join(up, [key, "predecessor_id"], "left")
    first, siblings = F.col("predecessor_id").isNull(), F.col("siblings") > 1
    holds = good & (first | F.coalesce(F.col("up") == F.col("named"), F.lit(False)))
    by_up = Window.partitionBy(key, "predecessor_id")
    met = met.withColumn("holds", holds).withColumns({"siblings": F.count("*").over(by_up), "place": F.row_number().over(by_up.orderBy(F.desc("holds"), "made_us", "entry_id"))})
    tests = [
        ~F.col("intact"), ~first & F.col("ups").isNotNull() & ~F.coalesce(F.array_contains("ups", F.col("named")), F.lit(False)), ~first & F.col("ups").isNull(),
        ~first & siblings, first & siblings, F.col("twins") > 1, F.coalesce(F.col("made_us") < F.col("up_us"), F.lit(False)),
    ]
    bits = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))
    return entries, kept(met.select(key, "entry_id", "predecessor_id", "made_us", (F.col("holds") & (F.col("place") == 1)).alias("chosen"), bits.alias("tests")), "chains-links")


def surviving(ledger: DataFrame, key: str = "ledger") -> DataFrame:
    """(key, entry_id, depth) of the entries on the chain that survives, depth from 0 at its first.

    A link holds if the entry is unaltered, its predecessor is there, unaltered, and has the digest that is
    named. At a fork, and among several first entries, the earliest made stays (ties: the smallest id). An entry
    survives if such links lead from it to the first.
    """
    return followed(links(ledger, key)[1], key)


def followed(linked: DataFrame, key: str) -> DataFrame:
    """`surviving` of the links. Entries that follow upon each other in time are a run, found in one sort; the ways of
    runs are doubled each round, so rounds are the logarithm of the number of runs on a chain; each is a written table.
    """
    w = Window.partitionBy(key).orderBy("made_us", "entry_id")
    fresh = F.when(F.col("predecessor_id") == F.lag("entry_id").over(w), 0).otherwise(1)
    rows = linked.where("chosen").select(key, "entry_id", "predecessor_id", "made_us", fresh.alias("fresh"))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy(key, "run").orderBy("made_us", "entry_id")
    rows = rows.select(key, "entry_id", "run", (F.row_number().over(of) - 1).alias("i"), F.first("predecessor_id").over(of).alias("before"))
    rows = kept(rows, "chains-runs")
    # to: how far the way of a run's last entry has come (null: the first entry is reached); steps: its length
    length = F.max("i") + 1
    runs = rows.groupBy(key, "run").agg(F.max_by("entry_id", "i").alias("entry_id"), F.first("before").alias("to"), length.alias("n"))
    now = kept(runs.select(key, "run", "n", "entry_id", "to", F.when(F.col("to").isNull(), F.col("n") - 1).otherwise(F.col("n")).cast("long").alias("steps")), "chains-ways")
    total = now.agg(F.sum("n")).first()[0] or 0
    while True:
        open_, longest = now.agg(F.count_if(F.col("to").isNotNull()), F.max(F.when(F.col("to").isNotNull(), F.col("steps")))).first()
        if not open_ or longest > total:  # a way longer than there are entries is a circle
            break
        far = now.select(key, F.col("entry_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        # a way whose next entry isn't chosen itself ends there, cut off, and is left out; so is one in a circle, by its length
        step = now.where("to is not null").join(far, [key, "to"]).select(key, "run", "n", "entry_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        after = kept(now.where("to is null").unionByName(step), "chains-ways")
        dropped(now)
        now = after
    ends = now.where("to is null").select(key, "run", (F.col("steps") - F.col("n") + 1).alias("start"))
    later = rows.where("before is not null").join(ends, [key, "run"]).select(key, "entry_id", (F.col("start") + F.col("i")).cast("int").alias("depth"))
    return rows.where("before is null").select(key, "entry_id", F.col("i").alias("depth")).union(later)


def chain_findings(ledger: DataFrame, key: str = "ledger") -> DataFrame:
    """(key, entry_id, finding) of FINDINGS, for each entry once.

    altered: its digest isn't that of its content; broken_link: its predecessor has another digest than it
    names; gap: its predecessor is missing; fork: another entry names the same predecessor; several_roots:
    another entry has none either; repeated_id; out_of_time: it was made before its predecessor; cut_off: it
    is on no chain that survives.
    """
    entries, linked = links(ledger, key)
    dropped(entries)
    alive = followed(linked, key).select(key, "entry_id", F.lit(True).alias("alive"))
    rows = linked.select(key, "entry_id", "tests").join(alive, [key, "entry_id"], "left")
    found = F.array_compact(F.array(*(F.when(F.col("tests").bitwiseAND(1 << i) > 0, name) for i, name in enumerate(FINDINGS[:-1])), F.when(F.col("alive").isNull(), FINDINGS[-1])))
    return rows.where("tests > 0 or alive is null").select(key, "entry_id", F.explode(found).alias("finding")).distinct()


def state(ledger: DataFrame, targets: Column, value: Column, key: str = "ledger") -> DataFrame:
    """(key, target, value, entry_id): what the surviving chain's last entry about each target says."""
    entries, linked = links(ledger, key, targets.alias("target"), value.alias("value"))
    rows = entries.select(key, "entry_id", "target", "value").join(followed(linked, key), [key, "entry_id"])
    return rows.groupBy(key, "target").agg(F.max(F.struct("depth", "value", "entry_id")).alias("e")).select(key, "target", "e.value", "e.entry_id")


def review_queue(utterances: DataFrame, key: str = "corpus_id", utterance: str = "pos", **sources: DataFrame) -> DataFrame:
    """(key, kind, priority, utterances, evidence, actions, start_us, end_us): what people are asked to look at.

    utterances: key, utterance, start_us, end_us, status, completeness and review (boolean: required). Further
    kinds come from `sources`, by name: rows of key, utterances (an array) and evidence (a string). Unknown
    utterances are taken out of an item, one without any falls out; equal items are one. Priority 1 is the most
    urgent, after QUEUES. Null texts of status or completeness ask for no review by themselves.
    """
    unknown = set(sources) - set(QUEUES)
    if unknown:
        raise ValueError(f"no such queue: {sorted(unknown)}")
    long = F.col("end_us") - F.col("start_us")
    rules = {
        "low_confidence_segmentation": F.coalesce("review", F.lit(False)) | (F.coalesce("completeness", F.lit("")) == "unknown"), "uncertain_speaker_boundary": F.col("status") == "unknown",
        "conflicting_speaker_attribution": F.col("status") == "conflicting", "long_utterance": long > LONG_US, "very_short_fragment": long < SHORT_US,
    }
    kinds = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    name = F.concat_ws("/", F.col(key).cast("string"), F.col(utterance).cast("string"))
    asked = utterances.select(key, F.explode(kinds).alias("kind"), F.array(utterance).alias("utterances"), name.alias("evidence"))
    for kind, df in sources.items():
        asked = asked.union(df.select(key, F.lit(kind), F.array_distinct("utterances"), F.col("evidence").cast("string")))
    asked = asked.distinct().withColumn("item", F.xxhash64(key, "kind", F.array_join(F.col("utterances").cast("array<string>"), "/"), "evidence"))
    each = asked.select(key, "kind", "item", "evidence", F.posexplode("utterances").alias("n", utterance)).join(utterances.select(key, utterance, "start_us", "end_us"), [key, utterance])
    items = each.groupBy(key, "kind", "item", "evidence").agg(F.array_sort(F.collect_list(F.struct("n", utterance))).alias("us"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    table = F.create_map(*(F.lit(x) for i, k in enumerate(QUEUES) for x in (k, i + 1)))
    actions = F.create_map(*(x for k, a in QUEUES.items() for x in (F.lit(k), F.array(*map(F.lit, a)))))
    return items.select(key, "kind", table[F.col("kind")].alias("priority"), F.transform("us", lambda u: u[utterance]).alias("utterances"), "evidence", actions[F.col("kind")].alias("actions"), "start_us", "end_us").distinct()
