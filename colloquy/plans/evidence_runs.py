"""Queries on transcripts in the making: assembly of candidates, frame grids, a model's proposals, growing recordings.

Sentences of conversations are observations, candidates and proposals; events are signals over their users'
recordings, chunked by how long each lasts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import assembly, frames, proposals
from colloquy.plans.queries import BIN_US, query
from colloquy.sources import tables
from colloquy.sources.tables import EV, U
from colloquy.streaming import incremental

KEYS = ["corpus_id", "pos"]
#: Confidences of a sentence of n characters, in words that both SQL engines read; null is unavailable.
CONFIDENCE = {"confidence": "CASE WHEN n % 7 <> 0 THEN n % 10 / 10.0 END", "timing": "CASE WHEN n % 5 <> 0 THEN n % 9 / 10.0 END", "boundary": "CASE WHEN n % 11 <> 0 THEN n % 8 / 8.0 END"}


def transcript(spark, d):
    """(observations, candidates, words): a sentence is an observation; without a comma it has two candidates; a very short one is not selected."""
    u = tables.utterances(spark, d)
    cut = u.select("corpus_id", "pos", "start_us", F.posexplode(F.expr("regexp_extract_all(text, '[^.\\n]+', 0)")).alias("k", "raw")).select("corpus_id", "start_us", F.concat_ws(".", "pos", (F.col("k") + 1).cast("string")).alias("observation_id"), "k", F.trim("raw").alias("text")).where("text <> ''").withColumn("n", F.length("text"))
    values = {c: F.expr(e).cast("double") for c, e in CONFIDENCE.items()}
    obs = cut.select("corpus_id", "observation_id", (F.col("start_us") + F.col("k") * 1000).alias("start_us"), (F.col("start_us") + F.col("k") * 1000 + F.col("n")).alias("end_us"), F.when(F.col("n") >= 15, "a").alias("selected"), F.array((F.col("n") % 6 / 6.0).cast("double"), F.lit(None).cast("double")).alias("speech"), values["timing"].alias("timing"), values["boundary"].alias("boundary"))
    one = cut.select("corpus_id", "observation_id", F.lit("a").alias("candidate_id"), F.when(F.col("n") % 13 != 0, F.col("text")).otherwise(" ").alias("text"), values["confidence"].alias("confidence"))
    two = cut.where("text not like '%,%'").select("corpus_id", "observation_id", F.lit("b"), F.upper("text"), F.lit(0.5))
    w = cut.select("corpus_id", "observation_id", "start_us", F.posexplode(F.split("text", " ")).alias("i", "text"))
    size = F.length("text")
    words = w.select("corpus_id", "observation_id", F.lit("a").alias("candidate_id"), (F.col("i") + 1).alias("n"), "text", F.when(size != 7, F.col("start_us") + F.col("i")).alias("start_us"), (F.col("start_us") + F.col("i") + 1).alias("end_us"), (size / 10.0).cast("double").alias("recognition"), F.when(size % 3 != 0, F.lit(0.9)).alias("timing"))
    return obs, one.union(two), words


_T = f"""{U}, cu AS (SELECT corpus_id, start_us, pos || '.' || k AS observation_id, k - 1 AS k, trim(raw[k]) AS text FROM (SELECT corpus_id, pos, start_us, raw, unnest(range(1, len(raw) + 1)) AS k FROM (SELECT corpus_id, pos, start_us, regexp_extract_all(text, '[^.\\n]+') AS raw FROM ut))),
se AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in CONFIDENCE.items())}, n >= 15 AND n % 13 <> 0 AS promoted, text NOT LIKE '%,%' AS two FROM (SELECT *, length(text) AS n FROM cu WHERE text <> '')),
cl AS (SELECT *, CASE WHEN promoted THEN list_filter([CASE WHEN confidence IS NULL THEN 'unavailable_transcription_confidence' WHEN confidence < 0.5 THEN 'low_transcription_confidence' END, CASE WHEN timing IS NULL THEN 'unavailable_temporal_alignment_confidence' WHEN timing < 0.5 THEN 'low_temporal_alignment_confidence' END,
    CASE WHEN boundary IS NULL OR boundary < 0.5 THEN 'uncertain_segment_boundary' END, CASE WHEN two THEN 'candidate_disagreement' END, CASE WHEN n % 6 < 3 THEN 'low_speech_probability' END], lambda x: x IS NOT NULL) ELSE ['missing_output'] END AS classes FROM se),
wo AS (SELECT corpus_id, observation_id, promoted, start_us, k, n, i, ws[i] AS w, length(ws[i]) AS size FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM se)) WHERE promoted),
rg AS (SELECT corpus_id, observation_id, CASE WHEN promoted THEN observation_id || ':a' END AS segment_id, CAST(NULL AS INTEGER) AS n, unnest(classes) AS class, start_us + k * 1000 AS start_us, start_us + k * 1000 + cl.n AS end_us, NOT promoted AS blocks FROM cl
UNION ALL SELECT corpus_id, observation_id, observation_id || ':a', i, unnest(CASE WHEN size = 7 OR size = 0 THEN ['incomplete_boundary_word'] ELSE list_filter([CASE WHEN size / 10.0 < 0.5 THEN 'low_transcription_confidence' END, CASE WHEN size % 3 = 0 THEN 'unavailable_temporal_alignment_confidence' END], lambda x: x IS NOT NULL) END),
    CASE WHEN size = 7 OR size = 0 THEN start_us + k * 1000 ELSE start_us + i - 1 END, CASE WHEN size = 7 OR size = 0 THEN start_us + k * 1000 + n ELSE start_us + i END, false FROM wo)"""


@query(f"WITH {_T} SELECT corpus_id, observation_id || ':a' AS segment_id, start_us + k * 1000 AS start_us, start_us + k * 1000 + n AS end_us, text, confidence, CASE WHEN two THEN 'b' ELSE '' END AS alternatives, array_to_string(classes, ',') AS classes FROM cl WHERE promoted")
def assembled_segments(spark, d):
    out = assembly.assemble(*transcript(spark, d))[0]
    return out.select("corpus_id", "segment_id", "start_us", "end_us", F.col("normalized").alias("text"), "confidence", F.array_join("alternatives", ",").alias("alternatives"), F.array_join("classes", ",").alias("classes"))


@query(f"WITH {_T} SELECT * FROM rg")
def review_regions(spark, d):
    return assembly.assemble(*transcript(spark, d))[2].drop("review")


@query(f"""WITH {_T}, a AS (SELECT corpus_id, count(*) AS n_observations, count(*) FILTER (WHERE promoted) AS n_segments FROM se GROUP BY 1), b AS (SELECT corpus_id, count(*) AS n_regions, bool_or(blocks) AS b FROM rg GROUP BY 1), c AS (SELECT corpus_id, count(*) AS n_words FROM wo WHERE size NOT IN (0, 7) GROUP BY 1)
SELECT corpus_id, n_observations, n_segments, coalesce(n_words, 0) AS n_words, coalesce(n_regions, 0) AS n_regions, CASE WHEN b THEN 'blocked' WHEN n_regions > 0 THEN 'review' ELSE 'complete' END AS status FROM a LEFT JOIN b USING (corpus_id) LEFT JOIN c USING (corpus_id)""")
def assembly_status(spark, d):
    return assembly.assemble(*transcript(spark, d))[3]


#: Chunks of ten hours that share half an hour, frames of ten minutes; a recording lasts from the first event on, and a chunk whose number is long divided lacks its end.
PLAN = (36_000_000_000, 1_800_000_000)
FRAME_US = 600_000_000


def chunked(spark, d):
    """(chunks, signal) of every user: its time starts with its first event, its signal are the unions of its clicks and of the gaps' others."""
    ev = tables.intervals(spark, d)
    zero = ev.groupBy("corpus_id").agg(F.min("start_us").alias("zero"), F.max("end_us").alias("last"))
    chunks = frames.recording_chunks(zero.select("corpus_id", (F.col("last") - F.col("zero")).alias("duration_us")), *PLAN)
    chunks = chunks.withColumn("decoded_us", F.col("end_us") - F.col("start_us") - F.when(F.col("chunk") % 4 == 1, 900_000_000).when(F.col("chunk") % 4 == 2, 1_300_000_000).when(F.col("chunk") % 8 == 3, 1_900_000_000).otherwise(0))
    # disjoint signal: each event lasts until the next begins, at most
    from pyspark.sql import Window

    end = F.lead("start_us").over(Window.partitionBy("corpus_id").orderBy("start_us", "interval_id"))
    cut = ev.select("corpus_id", "start_us", F.least("end_us", F.coalesce(end, F.col("end_us"))).alias("end_us"), F.when(F.col("label") == "click", "speech").otherwise("non_speech").alias("class"))
    signal = cut.join(zero, "corpus_id").select("corpus_id", "class", (F.col("start_us") - F.col("zero")).alias("start_us"), (F.col("end_us") - F.col("zero")).alias("end_us")).where("end_us > start_us")
    return chunks, signal


_STEP = PLAN[0] - PLAN[1]
_C = f"""{EV}, ze AS (SELECT corpus_id, min(start_us) AS zero, max(end_us) AS last FROM ev GROUP BY 1), du AS (SELECT corpus_id, last - zero AS duration_us, greatest(0, CAST(ceil((last - zero - {PLAN[1]}) / {_STEP}) AS BIGINT) - 1) AS last FROM ze),
pl AS (SELECT *, unnest(range(0, last + 1)) AS chunk FROM du), ch AS (SELECT corpus_id, chunk, chunk * {_STEP} AS start_us, least(chunk * {_STEP} + {PLAN[0]}, duration_us) AS end_us, CASE WHEN chunk = 0 THEN 0 ELSE chunk * {_STEP} + {PLAN[1] // 2} END AS own_start_us, CASE WHEN chunk = last THEN duration_us ELSE (chunk + 1) * {_STEP} + {PLAN[1] // 2} END AS own_end_us FROM pl),
de AS (SELECT *, end_us - start_us - CASE WHEN chunk % 4 = 1 THEN 900000000 WHEN chunk % 4 = 2 THEN 1300000000 WHEN chunk % 8 = 3 THEN 1900000000 ELSE 0 END AS decoded_us FROM ch),
co AS (SELECT *, own_end_us - covered_us AS left_us FROM (SELECT *, greatest(own_start_us, least(start_us + least(decoded_us, end_us - start_us), own_end_us)) AS covered_us FROM de)),
fr AS (SELECT corpus_id, chunk, frame_no, greatest(start_us + frame_no * {FRAME_US}, own_start_us) AS start_us, least(start_us + (frame_no + 1) * {FRAME_US}, covered_us) AS end_us, start_us + frame_no * {FRAME_US} AS at_us, false AS remainder
    FROM (SELECT *, unnest(range((own_start_us - start_us) // {FRAME_US}, (covered_us - start_us + {FRAME_US - 1}) // {FRAME_US})) AS frame_no FROM co WHERE left_us <= {FRAME_US} AND covered_us > own_start_us)
    UNION ALL SELECT corpus_id, chunk, NULL, covered_us, own_end_us, NULL, true FROM co WHERE left_us > 0 AND left_us <= {FRAME_US}),
si AS (SELECT corpus_id, CASE WHEN label = 'click' THEN 'speech' ELSE 'non_speech' END AS class, s - zero AS start_us, least(e, coalesce(nx, e)) - zero AS end_us FROM (SELECT corpus_id, label, start_us AS s, end_us AS e, lead(start_us) OVER (PARTITION BY corpus_id ORDER BY start_us, interval_id) AS nx FROM ev) JOIN ze USING (corpus_id)),
fc AS (SELECT fr.*, coalesce(si.class, 'uncertain') AS class FROM fr LEFT JOIN si ON si.corpus_id = fr.corpus_id AND fr.at_us >= si.start_us AND fr.at_us < si.end_us AND NOT remainder),
rn AS (SELECT *, sum(f) OVER (PARTITION BY corpus_id, chunk ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY corpus_id, chunk ORDER BY start_us) = class THEN 0 ELSE 1 END AS f FROM fc)),
ru AS (SELECT corpus_id, chunk, first(class) AS class, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS frames FROM rn GROUP BY corpus_id, chunk, run)"""


@query(f"WITH {_C} SELECT corpus_id, chunk, start_us, end_us, own_start_us, own_end_us FROM ch")
def recording_chunks(spark, d):
    """The chunk plan of every recording, by its own length."""
    return chunked(spark, d)[0].drop("decoded_us")


@query(f"WITH {_C} SELECT corpus_id, chunk, count(*) AS n, count(*) FILTER (WHERE remainder) AS remainders, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, min(start_us) AS start_us, max(end_us) AS end_us FROM fr GROUP BY corpus_id, chunk")
def frame_grid(spark, d):
    """The frames of each chunk, summed up."""
    f = frames.frame_grid(chunked(spark, d)[0], FRAME_US)
    return f.groupBy("corpus_id", "chunk").agg(F.count("*").alias("n"), F.count_if("remainder").alias("remainders"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


@query(f"WITH {_C} SELECT corpus_id, chunk, left_us, 'malformed_output' AS reason FROM co WHERE left_us > {FRAME_US}")
def frame_failures(spark, d):
    return frames.failures(chunked(spark, d)[0], FRAME_US)


@query(f"WITH {_C} SELECT * FROM ru")
def frame_runs(spark, d):
    """Runs of frames of one class, by division; the SQL makes every frame."""
    return frames.frame_runs(*chunked(spark, d), FRAME_US, BIN_US)


@query(f"WITH {_C} SELECT corpus_id, at_us, min(before) AS before, min(after) AS after FROM (SELECT corpus_id, end_us AS at_us, class AS before, NULL AS after FROM ru UNION ALL SELECT corpus_id, start_us, NULL, class FROM ru) GROUP BY corpus_id, at_us")
def run_edges(spark, d):
    """Edges that neighbouring runs share, with what lies on each side."""
    return frames.run_edges(frames.frame_runs(*chunked(spark, d), FRAME_US, BIN_US))


@query(f"""WITH {U}, q AS (SELECT corpus_id, pos, text, corpus_id || '/' || pos AS response_id, regexp_extract(text, '[^ ]+ [^ ]+') AS two, split_part(text, ' ', 3) AS third, max(pos) OVER (PARTITION BY corpus_id) AS top FROM ut),
pr AS (SELECT corpus_id, pos, text, response_id, unnest(['p1', 'p2', 'p3']) AS proposal_id, unnest([two, third, CASE WHEN length(text) < 60 THEN 'not said at all' ELSE two END]) AS quote, unnest([0, NULL, CASE WHEN length(text) < 200 THEN 1 ELSE NULL END]) AS start, unnest([pos - 1, pos + 20, pos]) AS target, unnest(['identified', 'uncertain', 'probable']) AS st, top FROM q),
rs AS (SELECT *, CASE WHEN start IS NOT NULL THEN CASE WHEN substring(text, start + 1, length(quote)) = quote THEN [start] ELSE [] END WHEN length(quote) = 0 THEN [] ELSE list_transform(list_filter(range(1, length(text) - length(quote) + 2), lambda i: substring(text, i, length(quote)) = quote), lambda i: i - 1) END AS places FROM pr)
SELECT corpus_id, pos, response_id, proposal_id, quote, array_to_string(places, ',') AS places, CASE proposal_id WHEN 'p1' THEN 'p3' WHEN 'p3' THEN 'p1' ELSE '' END AS alternatives,
CASE WHEN quote = '' THEN 'empty_quote' WHEN start IS NOT NULL AND len(places) = 0 THEN 'span_mismatch' WHEN len(places) = 0 THEN 'quote_absent' WHEN st <> 'uncertain' AND (target < 0 OR target > top) THEN 'target_outside_context' END AS reason FROM rs""")
def normalized_proposals(spark, d):
    """Quotes cut from conversations, placed in them; targets must be utterances of the recording."""
    u = tables.utterances(spark, d)
    two, third = F.regexp_extract("text", "[^ ]+ [^ ]+", 0), F.split_part("text", F.lit(" "), F.lit(3))
    size = F.length("text")

    def proposal(name, quote, start, target, status, group):
        t = F.array(F.struct(F.lit("utterance").alias("type"), F.lit(status).alias("status"), target.cast("string").alias("id"), F.array().cast("array<string>").alias("alternatives")))
        return F.struct(F.lit(name).alias("proposal_id"), F.lit("question").alias("family"), quote.alias("quote"), start.cast("int").alias("start"), F.lit(group).alias("alternative_group"), t.alias("targets"))

    made = F.array(proposal("p1", two, F.lit(0), F.col("pos") - 1, "identified", "g"), proposal("p2", third, F.lit(None), F.col("pos") + 20, "uncertain", None), proposal("p3", F.when(size < 60, "not said at all").otherwise(two), F.when(size < 200, 1), F.col("pos"), "probable", "g"))
    asked = u.select(*KEYS, F.concat_ws("/", *KEYS).alias("response_id"), F.explode(made).alias("p")).select(*KEYS, "response_id", "p.*")
    context = u.select(*KEYS).join(u.select("corpus_id", F.col("pos").alias("member")), "corpus_id")
    out = proposals.normalized(asked, u, context, KEYS)
    return out.select(*KEYS, "response_id", "proposal_id", "quote", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), F.array_join("alternatives", ",").alias("alternatives"), "reason")


@query(f"""WITH RECURSIVE {U}, ac AS (SELECT corpus_id, pos, CASE WHEN text LIKE '%,%' THEN 'act' || pos END AS act, row_number() OVER (PARTITION BY corpus_id ORDER BY pos) AS rn FROM ut),
dg(corpus_id, rn, digest) AS (SELECT corpus_id, 1, sha256(repeat('0', 64) || chr(10) || pos || chr(10) || coalesce(act, '')) FROM ac WHERE rn = 1 UNION ALL SELECT ac.corpus_id, ac.rn, sha256(dg.digest || chr(10) || ac.pos || chr(10) || coalesce(ac.act, '')) FROM dg JOIN ac ON ac.corpus_id = dg.corpus_id AND ac.rn = dg.rn + 1)
SELECT ac.corpus_id, ac.pos, coalesce((SELECT string_agg(b.pos, ',' ORDER BY b.pos) FROM ac b WHERE b.corpus_id = ac.corpus_id AND b.rn BETWEEN ac.rn - 12 AND ac.rn - 1), '') AS context,
coalesce((SELECT string_agg(act, ',' ORDER BY p) FROM (SELECT b.act, b.pos AS p FROM ac b WHERE b.corpus_id = ac.corpus_id AND b.rn < ac.rn AND b.act IS NOT NULL ORDER BY b.rn DESC LIMIT 20)), '') AS acts, digest FROM ac JOIN dg USING (corpus_id, rn)""")
def incremental_contexts(spark, d):
    """Contexts, relation searches and chained digests of conversations, by the step that also runs over streams."""
    u = tables.utterances(spark, d).select("corpus_id", "pos", F.when(F.col("text").like("%,%"), F.concat(F.lit("act"), "pos")).alias("act"))
    return incremental.contexts(u).withColumns({"context": F.array_join(F.col("context").cast("array<string>"), ","), "acts": F.array_join("acts", ",")})
