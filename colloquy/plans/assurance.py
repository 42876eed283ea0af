"""Queries that prove and verify: words covered once, lineage, rolled-up attributions, digest chains, review queues.

Faults are planted by what words and orders hold, so that there is something to find.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import chains, coverage
from colloquy.plans import presentation, revision
from colloquy.plans.queries import query
from colloquy.plans.revision import _VERSIONS
from colloquy.sources import tables
from colloquy.sources.tables import WD

KEYS = ["corpus_id", "pos"]


def words(spark, d):
    """(source, owned): the words of conversations and the utterances' share of them, with planted faults.

    Words of six letters are lost, those of eleven are taken by the next utterance too, those of twelve come
    first in theirs, and each comma brings a word that nobody said.
    """
    w = tables.words(spark, d).select(*KEYS, "word", "word_no", F.concat_ws(".", "pos", "word_no").alias("word_id"), (F.col("pos") * 1_000_000 + F.col("word_no")).alias("place"))
    size = F.length("word")
    own = w.where(size != 6).select("corpus_id", F.col("pos").alias("utterance"), F.when(size == 12, -F.col("word_no")).otherwise(F.col("word_no")).alias("n"), "word_id")
    twice = w.where(size == 11).select("corpus_id", F.col("pos") + 1, F.col("word_no") - 1_000_000, "word_id")
    foreign = w.where("word like '%,'").select("corpus_id", "pos", F.col("word_no") + 500_000, F.concat(F.lit("x"), "word_id"))
    return w.select("corpus_id", "word_id", "place"), own.union(twice).union(foreign)


_COVER = f"""{WD}, so AS (SELECT corpus_id, pos, word, word_no, pos || '.' || word_no AS word_id, pos * 1000000 + word_no AS place, length(word) AS size FROM wd),
ow AS (SELECT corpus_id, pos AS utterance, CASE WHEN size = 12 THEN -word_no ELSE word_no END AS n, word_id FROM so WHERE size <> 6 UNION ALL SELECT corpus_id, pos + 1, word_no - 1000000, word_id FROM so WHERE size = 11 UNION ALL SELECT corpus_id, pos, word_no + 500000, 'x' || word_id FROM so WHERE word LIKE '%,'),
fa AS (SELECT corpus_id, word_id, 'missing' AS finding FROM so WHERE word_id NOT IN (SELECT word_id FROM ow WHERE ow.corpus_id = so.corpus_id)
UNION ALL SELECT corpus_id, word_id, 'twice' FROM ow SEMI JOIN so USING (corpus_id, word_id) GROUP BY corpus_id, word_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT corpus_id, word_id, 'foreign' FROM ow ANTI JOIN so USING (corpus_id, word_id)
UNION ALL SELECT DISTINCT corpus_id, word_id, 'out_of_order' FROM (SELECT ow.corpus_id, ow.word_id, place, max(place) OVER (PARTITION BY ow.corpus_id, utterance ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ow JOIN so USING (corpus_id, word_id)) WHERE place < before)"""


@query(f"WITH {_COVER} SELECT * FROM fa")
def word_faults(spark, d):
    return coverage.word_faults(*words(spark, d))


@query(f"""WITH {_COVER}, ns AS (SELECT corpus_id, count(*) AS n_source FROM so GROUP BY 1), no AS (SELECT corpus_id, count(*) AS n_owned FROM ow GROUP BY 1),
nf AS (SELECT corpus_id, count(*) FILTER (WHERE finding = 'missing') AS missing, count(*) FILTER (WHERE finding = 'twice') AS twice, count(*) FILTER (WHERE finding = 'foreign') AS foreign_, count(*) FILTER (WHERE finding = 'out_of_order') AS out_of_order FROM fa GROUP BY 1)
SELECT corpus_id, coalesce(n_source, 0) AS n_source, coalesce(n_owned, 0) AS n_owned, coalesce(missing, 0) AS missing, coalesce(twice, 0) AS twice, coalesce(foreign_, 0) AS "foreign", CAST(0 AS BIGINT) AS repeated, coalesce(out_of_order, 0) AS out_of_order,
coalesce(missing + twice + foreign_ + out_of_order, 0) = 0 AND coalesce(n_source, 0) = coalesce(n_owned, 0) AS exact FROM ns FULL JOIN no USING (corpus_id) LEFT JOIN nf USING (corpus_id)""")
def cover_proofs(spark, d):
    """Of each recording, whether its utterances hold its words exactly once and in order."""
    return coverage.cover_proofs(*words(spark, d))


@query("""SELECT o_orderkey AS id, 'lines' AS part, 'customer' AS "column", CAST(o_custkey AS VARCHAR) AS expected, CAST(CASE WHEN l_quantity > 40 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS found FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40 GROUP BY ALL
UNION ALL SELECT o_orderkey, 'archive', 'status', o_orderstatus, NULL FROM orders WHERE o_orderpriority = '1-URGENT'""")
def lineage_faults(spark, d):
    """Lines that name another customer than their order does, and archived orders whose status is lost."""
    o, li = tables.read(spark, d, "orders"), tables.read(spark, d, "lineitem")
    orders = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    lines = li.select(F.col("l_orderkey").alias("id"), "l_quantity").join(orders, "id").select("id", F.when(F.col("l_quantity") > 40, F.col("customer") + 1).otherwise(F.col("customer")).alias("customer"), "status")
    archive = orders.withColumn("status", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("status")))
    return coverage.lineage_faults({"orders": orders, "lines": lines, "archive": archive}, "id", ["customer", "status"])


#: Spans of an utterance are its sentences; what they say follows from their length and commas.
SPAN = "CASE WHEN n < 12 THEN 'conflicted' WHEN n < 20 THEN 'multiple_candidates' WHEN speaker = 'user' THEN 'machine_cluster' WHEN speaker = 'assistant' THEN 'reviewed' ELSE 'unattributed' END"


@query(f"""WITH {tables.U}, sp AS (SELECT corpus_id, pos, speaker, k, text, length(text) AS n FROM (SELECT corpus_id, pos, speaker, k, trim(raw[k]) AS text FROM (SELECT corpus_id, pos, speaker, raw, unnest(range(1, len(raw) + 1)) AS k FROM (SELECT corpus_id, pos, speaker, regexp_extract_all(text, '[^.\\n]+') AS raw FROM ut))) WHERE text <> ''),
sk AS (SELECT *, {SPAN} AS kind FROM sp), ag AS (SELECT corpus_id, pos, first(kind ORDER BY k) AS kind, list_sort(list_distinct(list(CASE WHEN text LIKE '%,%' AND n > 60 THEN 'p2' WHEN speaker = 'assistant' THEN 'p1' END) FILTER (WHERE (text LIKE '%,%' AND n > 60) OR speaker = 'assistant'))) AS ids,
list_sort(list_distinct(list(speaker) FILTER (WHERE speaker = 'user'))) AS ms, list_sort(list_distinct(list('REVIEWED: host') FILTER (WHERE speaker = 'assistant' AND n > 30))) AS rs FROM sk GROUP BY corpus_id, pos),
ca AS (SELECT *, list_distinct(coalesce(ids, []) || coalesce(rs, []) || coalesce(ms, [])) AS cs FROM ag)
SELECT corpus_id, pos, CASE WHEN kind = 'reviewed' AND len(ids) = 1 THEN 'manually_bound' WHEN kind = 'machine_cluster' AND len(ms) > 0 THEN 'machine_clustered' WHEN kind IN ('conflicted', 'multiple_candidates') AND len(cs) >= 2 THEN 'conflicting' ELSE 'unknown' END AS status,
CASE WHEN kind = 'reviewed' AND len(ids) = 1 THEN ids[1] WHEN kind = 'machine_cluster' AND len(ms) > 0 THEN ms[1] END AS target, CASE WHEN kind IN ('conflicted', 'multiple_candidates') AND len(cs) >= 2 THEN array_to_string(list_sort(cs), ',') ELSE '' END AS candidates,
CASE WHEN len(rs) > 0 THEN array_to_string(rs, ' + ') WHEN len(ms) > 0 THEN array_to_string(ms, ' + ') ELSE 'UNKNOWN' END AS label, kind IN ('conflicted', 'multiple_candidates') AND len(cs) < 2 AS degraded FROM ca""")
def utterance_attributions(spark, d):
    """Who each utterance's sentences, as spans, say speaks."""
    u = tables.utterances(spark, d)
    cut = u.select(*KEYS, "speaker", F.posexplode(F.expr("regexp_extract_all(text, '[^.\\n]+', 0)")).alias("k", "raw")).select(*KEYS, "speaker", "k", F.trim("raw").alias("text")).where("text <> ''").withColumn("n", F.length("text"))
    spans = cut.select(
        *KEYS, F.col("k").alias("n"), F.expr(SPAN).alias("kind"), F.expr("CASE WHEN text LIKE '%,%' AND n > 60 THEN array('p2') WHEN speaker = 'assistant' THEN array('p1') END").alias("identities"), F.lit(None).cast("array<string>").alias("entries"),
        F.expr("CASE WHEN speaker = 'assistant' AND n > 30 THEN array('REVIEWED: host') END").alias("reviewed"), F.expr("CASE WHEN speaker = 'user' THEN array('user') END").alias("machine"),
    )
    return coverage.attributions(spans, KEYS).withColumn("candidates", F.array_join(F.array_sort("candidates"), ","))


#: Entries are orders in their customer's ledger. Of some the content is changed, some are gone, some are written upon their predecessor's predecessor.
CONTENT = "concat(o_orderstatus, '/', cast(cast(floor(o_totalprice) as bigint) as {}))"
ALTERED, GONE, FORKED = "o_totalprice BETWEEN 100000 AND 110000", "o_totalprice BETWEEN 200000 AND 205000", "o_totalprice BETWEEN 300000 AND 310000"


def ledger(spark, d):
    o = tables.read(spark, d, "orders").withColumn("content", F.expr(CONTENT.format("string")))
    made = o.select(F.col("o_custkey").alias("ledger"), F.col("o_orderkey").alias("entry_id"), "content", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("made_us"), "o_totalprice")
    sealed = chains.sealed(made)
    w = Window.partitionBy("ledger").orderBy("made_us", "entry_id")
    forked = F.expr(FORKED) & F.lag("predecessor_id").over(w).isNotNull()
    rows = sealed.withColumns({"forked": forked, "p": F.lag("predecessor_id").over(w), "q": F.lag("predecessor_digest").over(w)})
    rows = rows.withColumns({"predecessor_id": F.when(F.col("forked"), F.col("p")).otherwise(F.col("predecessor_id")), "predecessor_digest": F.when(F.col("forked"), F.col("q")).otherwise(F.col("predecessor_digest"))})
    rows = rows.withColumn("digest", F.when(F.col("forked"), chains.digest(F.col("predecessor_digest"), F.col("entry_id"), F.col("content"))).otherwise(F.col("digest")))
    return rows.where(f"NOT ({GONE})").withColumn("content", F.when(F.expr(ALTERED), F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("forked", "p", "q", "o_totalprice")


_DIGEST = "sha256(coalesce({0}, '') || chr(10) || {1} || chr(10) || {2})"
_LEDGER = f"""o0 AS (SELECT o_custkey AS ledger, o_orderkey AS entry_id, o_totalprice, {CONTENT.format('VARCHAR')} AS content, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS made_us, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS predecessor_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
dg(ledger, rn, digest) AS (SELECT ledger, rn, {_DIGEST.format('NULL', 'entry_id', 'content')} FROM o0 WHERE rn = 1 UNION ALL SELECT o0.ledger, o0.rn, {_DIGEST.format('dg.digest', 'o0.entry_id', 'o0.content')} FROM dg JOIN o0 ON o0.ledger = dg.ledger AND o0.rn = dg.rn + 1),
o1 AS (SELECT o0.*, dg.digest, lag(dg.digest) OVER w AS predecessor_digest FROM o0 JOIN dg USING (ledger, rn) WINDOW w AS (PARTITION BY ledger ORDER BY rn)),
o2 AS (SELECT *, ({FORKED}) AND lag(predecessor_id) OVER w IS NOT NULL AS forked, lag(predecessor_id) OVER w AS p, lag(predecessor_digest) OVER w AS q FROM o1 WINDOW w AS (PARTITION BY ledger ORDER BY rn)),
le AS (SELECT ledger, entry_id, made_us, CASE WHEN forked THEN p ELSE predecessor_id END AS predecessor_id, CASE WHEN forked THEN q ELSE predecessor_digest END AS predecessor_digest, CASE WHEN forked THEN {_DIGEST.format('q', 'entry_id', 'content')} ELSE digest END AS digest, CASE WHEN {ALTERED} THEN content || '!' ELSE content END AS content FROM o2 WHERE NOT ({GONE})),
gd AS (SELECT * FROM le WHERE digest = {_DIGEST.format('predecessor_digest', 'entry_id', 'content')}),
lk AS (SELECT gd.* FROM gd LEFT JOIN gd u ON u.ledger = gd.ledger AND u.entry_id = gd.predecessor_id WHERE gd.predecessor_id IS NULL OR u.digest = gd.predecessor_digest),
chosen AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY ledger, predecessor_id ORDER BY made_us, entry_id) = 1),
al(ledger, entry_id, depth) AS (SELECT ledger, entry_id, 0 FROM chosen WHERE predecessor_id IS NULL UNION ALL SELECT c.ledger, c.entry_id, al.depth + 1 FROM al JOIN chosen c ON c.ledger = al.ledger AND c.predecessor_id = al.entry_id)"""


@query(f"""WITH RECURSIVE {_LEDGER}, sb AS (SELECT *, count(*) OVER (PARTITION BY ledger, predecessor_id) AS siblings FROM le), x AS (SELECT sb.*, u.digest AS ud, u.entry_id AS ue, u.made_us AS um, al.depth FROM sb LEFT JOIN le u ON u.ledger = sb.ledger AND u.entry_id = sb.predecessor_id LEFT JOIN al ON al.ledger = sb.ledger AND al.entry_id = sb.entry_id)
SELECT ledger, entry_id, unnest(list_filter([CASE WHEN digest <> {_DIGEST.format('predecessor_digest', 'entry_id', 'content')} THEN 'altered' END, CASE WHEN ue IS NOT NULL AND ud <> predecessor_digest THEN 'broken_link' END, CASE WHEN predecessor_id IS NOT NULL AND ue IS NULL THEN 'gap' END,
CASE WHEN predecessor_id IS NOT NULL AND siblings > 1 THEN 'fork' END, CASE WHEN predecessor_id IS NULL AND siblings > 1 THEN 'several_roots' END, CASE WHEN made_us < um THEN 'out_of_time' END, CASE WHEN depth IS NULL THEN 'cut_off' END], lambda f: f IS NOT NULL)) AS finding FROM x""")
def chain_findings(spark, d):
    """What is wrong with ledgers of which entries were altered, removed and forked."""
    return chains.chain_findings(ledger(spark, d))


@query(f"WITH RECURSIVE {_LEDGER} SELECT ledger, content[1] AS target, max_by(le.content, depth) AS value, max_by(entry_id, depth) AS entry_id FROM le JOIN al USING (ledger, entry_id) GROUP BY ledger, content[1]")
def ledger_state(spark, d):
    """The last surviving entry of each status in each ledger."""
    return chains.state(ledger(spark, d), F.substring("content", 1, 1), F.col("content"))


@query(f"""WITH {_VERSIONS}, x AS (SELECT *, {presentation.STATUS} AS status, lead(pos) OVER w AS np, lead(start_us) OVER w AS ns FROM ut WINDOW w AS (PARTITION BY corpus_id ORDER BY start_us, pos)),
it AS (SELECT corpus_id, 'low_confidence_segmentation' AS kind, CAST(pos AS VARCHAR) AS utterances, corpus_id || '/' || pos AS evidence, start_us, end_us FROM x WHERE text LIKE '%\n%\n%'
UNION ALL SELECT corpus_id, 'uncertain_speaker_boundary', CAST(pos AS VARCHAR), corpus_id || '/' || pos, start_us, end_us FROM x WHERE status = 'unknown' UNION ALL SELECT corpus_id, 'conflicting_speaker_attribution', CAST(pos AS VARCHAR), corpus_id || '/' || pos, start_us, end_us FROM x WHERE status = 'conflicting'
UNION ALL SELECT corpus_id, 'long_utterance', CAST(pos AS VARCHAR), corpus_id || '/' || pos, start_us, end_us FROM x WHERE end_us - start_us > 30000000 UNION ALL SELECT corpus_id, 'very_short_fragment', CAST(pos AS VARCHAR), corpus_id || '/' || pos, start_us, end_us FROM x WHERE end_us - start_us < 300000
UNION ALL SELECT a.corpus_id, 'uncertain_overlap_attribution', a.pos || ',' || a.np, 'overlap', least(a.start_us, b.start_us), greatest(a.end_us, b.end_us) FROM x a JOIN ut b ON a.corpus_id = b.corpus_id AND a.np = b.pos WHERE a.ns < a.end_us
UNION ALL SELECT ch.corpus_id, 'correction_affected_utterance', CAST(pos AS VARCHAR), array_to_string(kinds, ','), start_us, end_us FROM ch JOIN ut USING (corpus_id, pos))
SELECT corpus_id, kind, CAST(list_position({list(chains.QUEUES)}, kind) AS INTEGER) AS priority, utterances, evidence, start_us, end_us FROM it""")
def review_queue(spark, d):
    """What people are asked to look at in conversations, by urgency."""
    u = tables.utterances(spark, d)
    rows = u.select(*KEYS, "start_us", "end_us", F.expr(presentation.STATUS).alias("status"), F.lit(None).cast("string").alias("completeness"), F.col("text").like("%\n%\n%").alias("review"))
    w = Window.partitionBy("corpus_id").orderBy("start_us", "pos")
    near = u.withColumns({"np": F.lead("pos").over(w), "ns": F.lead("start_us").over(w)}).where("ns < end_us").select("corpus_id", F.array("pos", "np").alias("utterances"), F.lit("overlap").alias("evidence"))
    changed = revision.utterance_changes(spark, d).select("corpus_id", F.array("pos").alias("utterances"), F.col("kinds").alias("evidence"))
    out = chains.review_queue(rows, uncertain_overlap_attribution=near, correction_affected_utterance=changed)
    return out.select("corpus_id", "kind", "priority", F.array_join(F.col("utterances").cast("array<string>"), ",").alias("utterances"), "evidence", "start_us", "end_us")
