"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, jaccard_join, lexical_search, line_dedup, mixing, packing, quality, repetition, simhash, suffix_dedup, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_suffix_automaton_decontamination")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("hit_from", "hit_to", "items", "longest_match")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS8 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op8_suffix_automaton_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS8} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
met AS (
  SELECT doc_id, i, size, item
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win)))
  JOIN win USING (size, gram)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS k FROM met) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op10_lexicon_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_temperature_mixing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.copies(table(spark, sf, "documents")).withColumn("weight", F.round("weight", 9))


def _exponent_sql() -> str:
    """The same search of the exponent, one common table per pass."""
    parts = ["a0 AS (SELECT 0e0 AS low)"]
    for i in range(1, mixing.PASSES + 1):
        parts.append(f"""
        g{i} AS (SELECT DISTINCT least(1e0, low + j * {32.0 ** -i!r}) AS a FROM a{i - 1}, (SELECT unnest(range(0, 33)) AS j)),
        s{i} AS (SELECT a, sum(pow(s, a)) AS z, sum(pow(s, a) * ln(s)) AS zl, max(pow(s, a) / s) AS top FROM g{i}, share GROUP BY a),
        a{i} AS (SELECT coalesce((SELECT max(a) FROM s{i} WHERE a < (SELECT coalesce(min(a), 2e0) FROM s{i} WHERE NOT ok(a, z, zl, top))), (SELECT low FROM a{i - 1})) AS low)""")
    text = ",".join(parts)
    need = f"{mixing.TARGET_ENTROPY!r} * ln((SELECT count(*) FROM share))"
    return text.replace("NOT ok(a, z, zl, top)", f"NOT (ln(z) - a * zl / z >= {need} OR {mixing.BUDGET!r} * top / z > {mixing.MAX_REPETITION!r})")


ORACLES["op3_temperature_mixing"] = f"""
WITH k AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n,
         md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
src AS (SELECT source, sum(n) AS tokens FROM k WHERE n > 0 GROUP BY source),
share AS (SELECT source, tokens / (SELECT sum(tokens) FROM src) AS s FROM src),
{_exponent_sql()},
w AS (SELECT source, tokens, pow(s, low) / sum(pow(s, low)) OVER () AS weight FROM share JOIN src USING (source), a{mixing.PASSES}),
b AS (SELECT *, CAST(floor(weight * {mixing.BUDGET!r} * sum(tokens) OVER () + 5e-1) AS BIGINT) AS share_tokens FROM w),
p AS (SELECT *, CAST(floor(share_tokens / tokens) AS BIGINT) AS passes, share_tokens - CAST(floor(share_tokens / tokens) AS BIGINT) * tokens AS rest FROM b),
r AS (SELECT k.*, sum(n) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, source, n AS n_tokens, CASE WHEN n = 0 THEN 1 ELSE passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END END AS copies, round(weight, 9) AS weight
FROM r LEFT JOIN p USING (source)"""


@query("op1_token_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op4_repetition_coverage")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition(table(spark, sf, "documents"))


def _grams_sql() -> str:
    """Repeated n-grams by length, from one row per word with the words that follow it."""
    longest = max(repetition.GRAM_LIMITS)
    follow = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, longest))
    parts = [f""",
x AS (SELECT doc_id, p, length(word) AS size, word AS w0, {follow} FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
      WINDOW o AS (PARTITION BY doc_id ORDER BY p))"""]
    for n in sorted(repetition.GRAM_LIMITS):
        gram = " || ' ' || ".join(f"w{k}" for k in range(n))
        parts.append(f""",
c{n} AS (SELECT doc_id, count(*) AS words, sum(size) AS chars FROM x JOIN (
        SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, {n})) AS k FROM (
          SELECT doc_id, p AS i, count(*) OVER (PARTITION BY doc_id, {gram}) AS c FROM x WHERE w{n - 1} IS NOT NULL) WHERE c > 1)) USING (doc_id, p) GROUP BY doc_id)""")
    return "".join(parts)


ORACLES["op4_repetition_coverage"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, line, count(*) - 1 AS more, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
dl AS (SELECT doc_id, CAST(sum(more) AS BIGINT) AS n_dup_lines, CAST(sum(more * chars) AS BIGINT) AS dup_line_chars FROM l GROUP BY doc_id){_grams_sql()},
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        CAST(coalesce(c8.words, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"CAST(coalesce(c{w}.chars, 0) AS BIGINT) AS gram{w}_chars" for w in repetition.GRAM_LIMITS)},
        coalesce(dup_line_chars, 0) AS dup_line_chars
      FROM d LEFT JOIN dl USING (doc_id) {" ".join(f"LEFT JOIN c{w} USING (doc_id)" for w in repetition.GRAM_LIMITS)}),
g AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_LIMIT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {repetition.LINE_LIMIT} * word_chars
       AND {" AND ".join(f"100 * gram{w}_chars <= {p} * word_chars" for w, p in repetition.GRAM_LIMITS.items())} AS kept
FROM g"""


@query("op9_factorisation_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_url_logistic_filter")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages")).withColumn("score", F.round("score", 6))


@query("op5_segment_edit_join")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf, "documents"))


@query("op6_transform_merge_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf, "documents")).drop("kept")


@query("op13_shared_sum_search")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS13 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op13_shared_sum_search"] = f"""
WITH d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM (SELECT doc_id, {_TERMS13} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS13}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {lexical_search.TOP}"""


@query("op11_block_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query("op12_partition_jaccard_join")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))
