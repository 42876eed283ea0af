"""Queries on addresses and sets of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import addressing
from colloquy.plans.queries import query
from colloquy.sources import tables
from colloquy.sources.tables import EV, PT

RADIUS_US = 3_600_000_000


@query("""WITH x AS (SELECT event_id, CASE WHEN value < 1 THEN 'N/A' ELSE printf('%d.%07d', CAST(floor(value) AS BIGINT), CAST(round((value - floor(value)) * 100) AS BIGINT) * 12345 + CASE WHEN event_type = 'click' THEN 5 ELSE 0 END) END AS s FROM events),
y AS (SELECT *, CAST(split_part(s, '.', 1) AS BIGINT) AS a, CAST(split_part(s, '.', 2) AS BIGINT) AS b FROM x WHERE s <> 'N/A')
SELECT event_id, a * 1000000 + b // 10 + CASE WHEN b % 10 > 5 OR (b % 10 = 5 AND (b // 10) % 2 = 1) THEN 1 ELSE 0 END AS at_us FROM y UNION ALL SELECT event_id, NULL FROM x WHERE s = 'N/A'""")
def decimal_microseconds(spark, d):
    """Seconds with seven places, halves rounded to the even."""
    e = tables.read(spark, d, "events")
    tail = F.round((F.col("value") - F.floor("value")) * 100).cast("long") * 12345 + F.when(F.col("event_type") == "click", 5).otherwise(0)
    s = F.when(F.col("value") < 1, "N/A").otherwise(F.format_string("%d.%07d", F.floor("value"), tail))
    return e.select("event_id", addressing.microseconds(s).alias("at_us"))


@query(f"""WITH {PT}, fr AS (SELECT corpus_id, at_us AS f FROM pt WHERE label <> 'click'), n AS (SELECT p.corpus_id, p.event_id AS ask_id, p.at_us, f, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(f - p.at_us), f) AS k FROM pt p LEFT JOIN fr ON fr.corpus_id = p.corpus_id WHERE p.label = 'click')
SELECT corpus_id, ask_id, at_us, CASE WHEN abs(f - at_us) <= {RADIUS_US} THEN f END AS frame_us, CASE WHEN abs(f - at_us) <= {RADIUS_US} THEN abs(f - at_us) END AS error_us FROM n WHERE k = 1""")
def nearest_frames(spark, d):
    """Of every click the nearest other event of its user within an hour."""
    p = tables.points(spark, d)
    return addressing.nearest_frames(p.where("label = 'click'").select("corpus_id", F.col("event_id").alias("ask_id"), "at_us"), p.where("label <> 'click'").select("corpus_id", F.col("at_us").alias("frame_us")), RADIUS_US)


@query("SELECT p_brand, p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) = 1")
def first_occurrences(spark, d):
    """The dearest part of each brand and type."""
    p = tables.read(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice").withColumn("o", -F.col("p_retailprice"))
    return addressing.first_occurrences(p, ["p_brand", "p_type"], ["o", "p_partkey"]).drop("o")


@query("""WITH c AS (SELECT l_orderkey AS g, l_linenumber + 100 * l_orderkey AS c, max(l_quantity) > 25 AS big FROM lineitem GROUP BY 1, 2) SELECT a.g, a.c, coalesce(string_agg(b.c, ',' ORDER BY b.c), '') AS compatible FROM c a LEFT JOIN c b ON a.g = b.g AND a.c <> b.c AND a.big = b.big GROUP BY a.g, a.c""")
def compatible_candidates(spark, d):
    """Lines of an order go together unless one is large and the other is not."""
    c = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") + 100 * F.col("l_orderkey")).alias("c"), "l_quantity").groupBy("g", "c").agg((F.max("l_quantity") > 25).alias("big"))
    x = c.where("big").select("g", F.col("c").alias("a")).join(c.where("not big").select("g", F.col("c").alias("b")), "g").select("a", "b")
    return addressing.compatible(c, x, ["g"], "c").withColumn("compatible", F.array_join(F.col("compatible").cast("array<string>"), ","))


@query(f"WITH {EV} SELECT corpus_id, count(*) AS n, count(*) FILTER (WHERE label = 'click') AS click, count(*) FILTER (WHERE label = 'view') AS view, count(*) FILTER (WHERE label = 'hold') AS hold, count(*) FILTER (WHERE label NOT IN ('click', 'view', 'hold')) AS other FROM ev GROUP BY corpus_id")
def label_counters(spark, d):
    return addressing.counters(tables.intervals(spark, d), ["corpus_id"], "label", ["click", "view", "hold"])


@query("""WITH r AS (SELECT l_orderkey AS corpus_id, l_linenumber AS reference_id, CASE WHEN max(l_quantity) > 10 THEN max(l_returnflag) END AS expected, max(l_linestatus) AS got, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)
SELECT corpus_id, count(*) FILTER (WHERE expected IS NOT NULL AND l_discount > 0.02) AS evaluated, count(*) FILTER (WHERE expected IS NOT NULL AND l_discount > 0.02 AND (expected = got OR expected = 'N')) AS correct,
round(count(*) FILTER (WHERE expected IS NOT NULL AND l_discount > 0.02 AND (expected = got OR expected = 'N')) / nullif(count(*) FILTER (WHERE expected IS NOT NULL AND l_discount > 0.02), 0), 9) AS accuracy,
CASE WHEN count(expected) = 0 THEN 'unavailable_reference' WHEN count(*) FILTER (WHERE expected IS NOT NULL AND l_discount > 0.02) = 0 THEN 'unavailable_hypothesis' END AS unavailable FROM r GROUP BY corpus_id""")
def candidate_selection(spark, d):
    """Lines as references that expect a flag; those of a discount over two per cent are matched."""
    li = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("corpus_id"), F.col("l_linenumber").alias("reference_id")).agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_returnflag", "l_linestatus", "l_discount")))
    li = li.select("corpus_id", "reference_id", F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("expected"), F.array("l_linestatus", F.lit("N")).alias("selected"), "l_discount")
    return addressing.candidate_selection(li, li.where("l_discount > 0.02"))
