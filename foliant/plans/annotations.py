"""Annotations of whole tables: language, personal data, categories, tags, threads and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import findings, language
from foliant.functions import text as t
from foliant.operators import lifecycle
from foliant.plans.queries import query, table, texts


@query(language.sql())
def k1_language(spark, d):
    rows = language.detect(texts(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "words", "lang", "status")


@query()
def k2_findings(spark, d):
    rows = texts(spark, d).select("doc_id", F.explode(findings.find()("text")).alias("f"))
    return rows.select("doc_id", "f.*")


@query()
def k16_redaction(spark, d):
    return texts(spark, d).select("doc_id", findings.redact("text").alias("redacted"))


@query()
def k17_preview(spark, d):
    """The first 4,000 characters of every text, redacted, and the findings in them."""
    text = F.coalesce("text", F.lit(""))
    rows = texts(spark, d).select("doc_id", F.left(text, F.lit(4000)).alias("shown"), (F.length(text) > 4000).alias("truncated"))
    return rows.select("doc_id", findings.redact("shown").alias("redacted"), F.size(findings.find()("shown")).alias("findings"), "truncated", F.length("shown").alias("chars"))


@query("SELECT conv_id, turn, 'thread:' || substr(sha1(coalesce(NULLIF(role, ''), conv_id::VARCHAR)), 1, 16) AS thread_key FROM conversations")
def j28_thread_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", lifecycle.thread_key(F.col("role"), F.col("conv_id").cast("string")).alias("thread_key"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'NO_TEXT' WHEN n_chars IS DISTINCT FROM length(text) THEN 'STALE' ELSE 'FRESH' END AS freshness FROM documents")
def e2_stale(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.when(F.col("text").isNull(), "NO_TEXT").when(~F.col("n_chars").eqNullSafe(F.length("text")), "STALE").otherwise("FRESH").alias("freshness"))


@query("""SELECT doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 1000 EXCEPT SELECT doc_id FROM labels WHERE quality = 0) UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def i13_dossier(spark, d):
    labels = table(spark, d, "labels")
    return lifecycle.membership(table(spark, d, "documents").filter("n_chars > 1000"), labels.filter("quality = 0"), labels.filter("toxic = 1"), "doc_id")


@query("""WITH q AS (SELECT conv_id, count(*) AS attempts, max(CASE WHEN turn % 2 = 0 THEN 'TIMEOUT' ELSE 'MALFORMED' END) AS outcome FROM conversations GROUP BY 1)
SELECT conv_id, attempts, outcome, outcome = 'TIMEOUT' AND attempts < 3 AS retry, least(3600, 60 * pow(5, greatest(attempts, 1) - 1))::BIGINT AS wait_seconds FROM q""")
def p9_retry_queue(spark, d):
    each = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, "TIMEOUT").otherwise("MALFORMED").alias("outcome"))
    return lifecycle.retry_queue(each, "conv_id", "outcome")


@query(f"SELECT doc_id, round(CASE WHEN len(list_distinct(a)) + len(list_distinct(b)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}_]+') AS a, regexp_extract_all(lower(coalesce(lang, '')), '[\\p{{L}}\\p{{N}}_]+') AS b FROM documents)")
def j6_token_jaccard(spark, d):
    a, b = t.tokens(F.col("source")), t.tokens(F.col("lang"))
    none = F.size(a) + F.size(b) == 0
    return table(spark, d, "documents").select("doc_id", F.round(F.when(none, F.lit(1.0)).otherwise(t.jaccard(a, b)), 6).alias("jaccard"))
