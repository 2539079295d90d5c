"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, jaccard_join, lm_scoring, media, mixing, packing, preferences, quality, sharding, suffix_dedup
from foliant.llm.common import documents

SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document by its source; the rows of a source are dealt over 64 places, so that a hot one fills no shard."""
    placed = sharding.shard(documents(spark, sf_dir).select("doc_id", "source"), "source", SHARDS, spread=64, spread_by="doc_id")
    return placed.select("doc_id", "source", "slot", "shard")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "log_weight", "perturbed", "rank", "kept")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_suffix_array_dedup, op4_media_columns, op5_exact_dedup, op6_ngram_jaccard_join, op7_mixing, op8_quality_classifier, op9_chat_formatting, op10_best_fit_packing)}


def _sharding_sql() -> str:
    table = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""
WITH table_ AS (SELECT CAST([{table}] AS INTEGER[]) AS held),
keyed AS (
  SELECT doc_id, source, (CAST('0x' || substr(md5(coalesce(source, '') || chr(31) || CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 64 AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.SLOTS})::INTEGER AS slot
  FROM documents)
SELECT doc_id, source, slot, held[slot + 1] AS shard FROM keyed, table_"""


OP5 = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h, text
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
t AS (
  SELECT source, source_size,
    CASE WHEN level * weight >= cap THEN cap ELSE (SELECT arg_min(level, nth) FROM l x WHERE x.level * x.weight < x.cap) * weight END AS target
  FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, r.source_size, r.target, r.whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target,
  (size * (whole + CASE WHEN before * 2 + size <= rest * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c"""


OP9 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (
  SELECT conv_id, max(i) AS turns, string_agg(role || chr(31) || text || chr(30), '' ORDER BY i) AS content,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS score,
    sha256(max(CASE WHEN i = 1 THEN role || chr(31) || text END)) AS opening
  FROM n GROUP BY conv_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY opening ORDER BY content, conv_id) - 1) // 2 AS nth FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY opening, nth ORDER BY -score, conv_id) AS side, count(*) OVER (PARTITION BY opening, nth) AS sides FROM r),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns, b.turns AS other FROM s a LEFT JOIN s b ON a.opening = b.opening AND a.nth = b.nth AND b.side = 2 WHERE a.side = 1),
d AS (
  SELECT p.chosen_id, min(x.i) AS differ FROM p JOIN n x ON x.conv_id = p.chosen_id LEFT JOIN n y ON y.conv_id = p.rejected_id AND y.i = x.i
  WHERE p.rejected_id IS NOT NULL AND (y.i IS NULL OR y.role <> x.role OR y.text <> x.text) GROUP BY p.chosen_id),
q AS (SELECT p.*, CASE WHEN rejected_id IS NULL THEN 1 ELSE coalesce(differ - 1, turns) END AS k FROM p LEFT JOIN d USING (chosen_id)),
z AS (
  SELECT conv_id, i, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head FROM n),
m AS (SELECT q.chosen_id AS id, q.chosen_id, q.k FROM q UNION ALL SELECT q.rejected_id, q.chosen_id, q.k FROM q WHERE rejected_id IS NOT NULL),
o AS (
  SELECT m.id, z.i, z.role, z.shown, z.head, z.i > m.k AS after,
    sum(length(z.shown)) OVER (PARTITION BY m.id, z.i > m.k ORDER BY z.i) - length(z.shown) AS pos
  FROM m JOIN z ON z.conv_id = m.id),
f AS (
  SELECT id, coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT after), '') AS prompt, coalesce(string_agg(shown, '' ORDER BY i) FILTER (after), '') AS rest,
    coalesce(string_agg((pos + head)::BIGINT || '-' || (pos + length(shown))::BIGINT, ',' ORDER BY i) FILTER (after AND role = 'assistant'), '') AS mask
  FROM o GROUP BY id)
SELECT q.chosen_id, q.rejected_id, q.k::INTEGER AS n_prompt_turns, a.prompt, a.rest AS chosen, b.rest AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM q JOIN f a ON a.id = q.chosen_id LEFT JOIN f b ON b.id = q.rejected_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _sharding_sql(), "op5_exact_dedup": OP5, "op7_mixing": OP7, "op9_chat_formatting": OP9}
