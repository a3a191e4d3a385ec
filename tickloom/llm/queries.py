"""The registered queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table
from . import layout_sql, leakage, mixing, quality, runs


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = runs.standing_prices(table(spark, d, "ticks"), table(spark, d, "generations"))
    return out.select(F.col("first_id").alias("first_tick_id"), "n_records", "duration_micros")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id").distinct()


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Plan]]:
    targets = table(spark, d, "mix_targets")
    tokens = mixing.counted(table(spark, d, "documents"), targets)
    plans = mixing.planned(tokens, targets)
    return mixing.mixture(tokens, plans), plans


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p9_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What each source is to give by characters, which SQL can count."""
    sized = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", F.length("text").cast("bigint").alias("n_tokens"))
    targets = table(spark, d, "mix_targets")
    out = mixing.quotas(spark, mixing.planned(sized.join(targets.select("source"), "source", "left_semi"), targets))
    return out.withColumn("share", F.round("share", 9))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p10_layout(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_layout(table(spark, d, "documents", "doc_id", "text")).select("doc_id", *[F.round(x, 6).alias(x) for x in quality.LAYOUT])


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p8_found, p9_mixture, p9_shares, p9_quotas, p10_found, p10_layout, p10_statistics)}

ORACLES = {
    "p2_found": """
WITH t AS (SELECT ticks.generation, tick_id, epoch_us(event_time_micros) AS t, CASE WHEN price_scale IS NULL THEN price ELSE round(price * pow(10.0, price_scale)) END AS v FROM ticks LEFT JOIN generations USING (generation) WHERE price IS NOT NULL AND event_time_micros IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY t, tick_id) - row_number() OVER (PARTITION BY generation, v ORDER BY t, tick_id) AS run FROM t)
SELECT arg_min(tick_id, (t, tick_id)) AS first_tick_id, count(*) AS n_records, max(t) - min(t) AS duration_micros FROM n GROUP BY generation, v, run HAVING count(*) >= 2""",
    "p9_quotas": """
WITH s AS (SELECT source, count(*) AS n_documents, coalesce(sum(length(text)), 0) AS stock FROM documents GROUP BY 1),
t AS (SELECT t.source, target_share, max_repeats, coalesce(n_documents, 0) AS n_documents, coalesce(stock, 0) AS stock, coalesce(stock, 0) > 0 AND target_share > 0 AND max_repeats > 0 AS live FROM mix_targets t LEFT JOIN s USING (source)),
a AS (SELECT *, CASE WHEN live THEN target_share + (1 - sum(CASE WHEN live THEN target_share ELSE 0 END) OVER ()) / count(*) FILTER (WHERE live) OVER () ELSE 0.0 END AS share FROM t),
z AS (SELECT *, min(CASE WHEN share > 0 THEN stock * max_repeats / share END) OVER () AS size FROM a)
SELECT source, target_share, round(share, 9) AS share, n_documents, CAST(stock AS BIGINT) AS stock, CAST(round(share * size) AS BIGINT) AS quota, CAST(max_repeats AS INT) AS max_repeats FROM z""",
    "p10_found": layout_sql.layout() + r" SELECT doc_id FROM ly WHERE prose_share < 0.5 AND regexp_matches(text, '\S')",
    "p10_layout": layout_sql.layout() + f" SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in quality.LAYOUT)} FROM ly",
    "p10_statistics": r"""
WITH t AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT i, doc_id, t, regexp_extract_all(lower(t), '\p{L}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM t),
common AS (SELECT word FROM (SELECT unnest(list_distinct(w)) AS word FROM s) GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM s)),
known AS (SELECT i, count(*) AS k FROM (SELECT i, unnest(w) AS word FROM s) JOIN common USING (word) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN round(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w), 6) END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round(CAST(length(regexp_replace(t, '[\p{L}\p{Nd}\s]+', '', 'g')) AS DOUBLE) / length(t), 6) END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(CAST(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:]\s*$'))) AS DOUBLE) / len(l), 6) END AS end_mark_share,
  CASE WHEN len(w) > 0 THEN round(CAST(coalesce(k, 0) AS DOUBLE) / len(w), 6) END AS common_word_share, CAST(len(l) AS BIGINT) AS line_count FROM s LEFT JOIN known USING (i)""",
}
