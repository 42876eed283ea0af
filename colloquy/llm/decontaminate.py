"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

A window is 10 consecutive words of an item, or a whole item of fewer words; a document's word inside
any occurrence of a window is hit. Windows hold six 5-grams; the smallest of their hashes is the window's
fingerprint, so equal windows have equal fingerprints and none is missed. Document windows are joined to
the benchmark's by fingerprint and text at once. Items under 10 words have no full window; their first
words take the fingerprint's place.

One pass over the documents keeps, beside the number of words, the windows whose fingerprint may occur in
the benchmark by a bit map of fixed size; a full bit map would let more windows through to the join, and
changes no result. The join is Spark's to plan: a small benchmark is broadcast, a large one shuffled, where
a passage that many documents share is split by adaptive execution. Texts are not shuffled. The work grows
with a text's words, however long it is.

Null texts have no words. Equal (doc_id, text) rows get equal results; rows with one doc_id and different
texts are judged apart; null doc_ids stay. Ties cannot arise. Other columns of documents are dropped.
Without items nothing is hit; an empty documents table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import ASCII_LOWER, ASCII_UPPER, WORD, remove, table, written

#: Words of a window and of a hashed gram; 5-grams in a window.
WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: Bits of the map of fingerprints, and of that of first words.
BITS, FIRST_BITS = 1 << 18, 1 << 16


def words_of(text: str | Column) -> Column:
    lowered = F.translate(F.col(text) if isinstance(text, str) else text, ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashed(rows: DataFrame) -> DataFrame:
    """With n, the number of `words`, wh, their hashes, and g, the hashes of the grams from each word on."""
    gram = ", ".join(f"wh[i + {j}]" for j in range(GRAM))
    return (
        rows.withColumn("n", F.size("words"))
        .withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("g", F.expr(f"if(n >= {WINDOW}, transform(sequence(0, n - {GRAM}), i -> xxhash64({gram})), cast(array() as array<bigint>))"))
    )


def known_windows(items: DataFrame) -> DataFrame:
    """(fp, m, t, item_id) of (item_id, words): each window's fingerprint, words and text."""
    full = f"transform(sequence(0, n - {WINDOW}), w -> struct(array_min(slice(g, w + 1, {GRAMS})) as fp, {WINDOW} as m, array_join(slice(words, w + 1, {WINDOW}), ' ') as t))"
    short = "array(struct(wh[0] as fp, n as m, array_join(words, ' ') as t))"
    rows = hashed(items).where("n > 0").withColumn("w", F.explode(F.expr(f"if(n >= {WINDOW}, {full}, {short})")))
    return rows.select("w.*", "item_id").distinct()


def bit_map(known: DataFrame, bits: int) -> Column:
    """The fingerprints of `known` as a literal of bits / 64 longs."""
    at = known.select(F.pmod("fp", F.lit(bits)).alias("b"))
    words = {r.w: r.v for r in at.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()}
    least = -(1 << 63)  # has no literal
    return F.expr("array(" + ", ".join(f"{v}L" if (v := words.get(i, 0)) != least else f"({least + 1}L - 1L)" for i in range(bits // 64)) + ")")


def windows_met(docs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_words, met) of `docs` (keys, words): met holds (fp, p, m, t) of windows that may be known, p their first word."""
    may = lambda bits, x, n: f"getbit(get({bits}, cast(pmod({x}, {n}) div 64 as int)), cast(pmod({x}, {n}) % 64 as int)) = 1"
    lengths = sorted(r.m for r in known.where(F.col("m") < WINDOW).select("m").distinct().collect())  # nine at most
    rows = hashed(docs).withColumn("bits", bit_map(known.where(F.col("m") == WINDOW), BITS)).withColumn("first_bits", bit_map(known.where(F.col("m") < WINDOW), FIRST_BITS))
    rows = rows.withColumn("at", F.expr(f"filter(sequence(0, size(g)), i -> i < size(g) and {may('bits', 'g[i]', BITS)})"))
    own = f"filter(sequence(greatest(0, i - {GRAMS - 1}), least(i, n - {WINDOW})), w -> array_min(slice(g, w + 1, {GRAMS})) = g[i])"
    window = f"struct(g[i] as fp, w as p, {WINDOW} as m, array_join(slice(words, w + 1, {WINDOW}), ' ') as t)"
    met = f"flatten(transform(at, i -> transform({own}, w -> {window})))"
    if lengths:
        rows = rows.withColumn("starts", F.expr(f"filter(sequence(0, n), p -> p < n and {may('first_bits', 'wh[p]', FIRST_BITS)})"))
        of = f"filter(array({', '.join(map(str, lengths))}), m -> p + m <= n)"
        met = f"concat({met}, flatten(transform(starts, p -> transform({of}, m -> struct(wh[p] as fp, p, m, array_join(slice(words, p + 1, m), ' ') as t)))))"
    return rows.select(*keys, F.col("n").cast("long").alias("n_words"), F.expr(met).alias("met"))


def judged(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, h, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `rows` (k, text); h is the text's hash."""
    keys = ["k", "h"]
    known = written(known_windows(benchmark.select("item_id", words_of("text").alias("words"))), "decontaminate-windows")
    docs = rows.select("k", F.xxhash64("text").alias("h"), words_of("text").alias("words"))
    met = written(windows_met(docs, known, keys), "decontaminate-met")
    some = met.where("size(met) > 0").select(*keys, F.explode("met").alias("w")).select(*keys, "w.*")
    found = written(some.join(known.select("fp", "t").distinct(), ["fp", "t"], "left_semi").select(*keys, "p", "m", "t").distinct(), "decontaminate-hits")
    # the words of a document's occurrences, each counted once: sorted by start, what reaches past the last end
    union = "aggregate(s, struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(0, x.p + x.m - greatest(a.e, x.p)) as n, greatest(a.e, x.p + x.m) as e), a -> a.n)"
    covered = found.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("p", "m"))).alias("s")).select(*keys, F.expr(union).cast("long").alias("n_hit"))
    joined = found.select(*keys, "t").distinct().join(known.select("t", "item_id").distinct(), "t").select(*keys, F.col("item_id").cast("string").alias("i")).distinct()
    of = joined.groupBy(*keys).agg(F.sort_array(F.collect_list("i")).alias("i")).select(*keys, F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"))
    def sides(df: DataFrame) -> DataFrame:
        """A null key joins null keys and no others; an empty string is a key."""
        return df.withColumns({"kk": F.coalesce(F.col("k").cast("string"), F.lit("")), "kn": F.col("k").isNull()})

    on = ["kk", "kn", "h"]
    per = written(sides(covered).join(sides(of).select(*on, "n_items", "items_sha256"), on).select(*on, "n_hit", "n_items", "items_sha256"), "decontaminate-judged")
    remove(found)
    remove(known)
    out = sides(met.select("k", "h", "n_words")).join(per, on, "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return out.select("k", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs`."""
    out = judged(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), benchmark)
    return out.select(F.col("k").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose (key, text) holds no window of the benchmark, with all their columns."""
    hit = judged(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), benchmark).where("contaminated").select(F.col("k").alias("hit_k"), F.col("h").alias("hit_h")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    return rows.join(hit, F.col("k").eqNullSafe(F.col("hit_k")) & (F.col("h") == F.col("hit_h")), "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"coalesce(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD}'), [])"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS t
    FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS t
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
),
hit AS (SELECT DISTINCT doc_id, m, p, item_id FROM dw JOIN bw USING (m, t)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
