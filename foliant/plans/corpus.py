"""The document store's tables as views of the test tables, in Spark and as common table expressions of the SQL.

`files` is `documents` with names, paths, times and states derived from identifiers; its derived tables (hashes, tags,
favourites, queue, scans) follow. All are projections of one table: no view shuffles but the tags, which explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import names
from foliant.functions import text as t
from foliant.operators.scratch import spread

EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".html", ".csv", ".py", ".jpg", ".eml", ".xlsx", ".log", ".json")
STEMS = ("report", "invoice", "contrat", "field note", "plan-b", "Facture client")
TAGS = ("urgent", "archive", "personal", "work", "tax", "travel", "read later", "unused")
OUTCOMES = ("TIMEOUT", "MALFORMED", "NO_TEXT", "UNSUPPORTED_FORMAT", "TRANSIENT_ERROR", "ENCRYPTED", "OCR_FAILED", "RESOURCE_LIMIT")
ACTIVE = "coalesce(state, 'ACTIVE') = 'ACTIVE'"
EPOCH, NOW = "2024-01-01 00:00:00", "2025-01-01 00:00:00"


def table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nth(values, at):
    """The entry of a constant list at a 0-based column."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _hours(after):
    return F.timestamp_add("HOUR", after, F.lit(EPOCH).cast("timestamp"))


def files(spark, d, heavy: bool = False) -> DataFrame:
    """heavy: for what costs much a row."""
    i = F.col("id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    docs = table(spark, d, "documents")
    rows = (spread(docs) if heavy else docs).select(F.col("doc_id").alias("id"), F.col("text").alias("content_text"), F.col("n_chars").alias("size_bytes"), "lang", "source")
    member = i % 13 == 5
    rows = rows.withColumns({"extension": F.when(i % 13 == 0, ".zip").otherwise(_nth(EXTENSIONS, i % 12)), "_stem": _nth(STEMS, F.floor(i / 6) % 6)})
    ending = F.when(i % 6 == 0, F.concat(F.lit("_v"), (i % 9 + 1).cast("string"))).when(i % 6 == 1, "_final").when(i % 6 == 2, F.concat(F.lit(" 2023-"), two(i % 12 + 1), F.lit("-"), two(i % 28 + 1)))
    ending = ending.when(i % 6 == 3, F.concat(F.lit(" ("), (i % 5).cast("string"), F.lit(")"))).when(i % 6 == 4, F.concat(F.lit("_"), two(i % 28 + 1), F.lit("."), two(i % 12 + 1), F.lit(".2022"))).otherwise("")
    rows = rows.withColumns({
        "filename": F.concat("_stem", ending, "extension"),
        "archive_parent_id": F.when(member, i - 5),
        "document_kind": F.when(member, "ARCHIVE_MEMBER").otherwise("PHYSICAL_FILE"),
        "state": F.when(i % 11 == 3, "MISSING").when(i % 11 == 7, None).otherwise("ACTIVE"),
        "parent_dir": F.when(member, F.concat(F.lit("/archives/a"), (i - 5).cast("string"), F.lit(".zip!"))).when(i % 13 == 0, "/archives").when(F.col("source").isNotNull(), F.concat(F.lit("/corpus/"), "source")),
        "created_at": F.when(i % 29 != 1, _hours(i * 11 % 8000)), "modified_at": F.when(i % 31 != 2, _hours(i * 37 % 8784)), "indexed_at": _hours(i * 0 + 9000),
        "volume_id": i % 3, "inode": F.floor(i / 2), "scan_id": i % 7,
    }).drop("_stem")
    rows = rows.withColumn("filename", F.when(i % 13 == 0, F.concat(F.lit("a"), i.cast("string"), F.lit(".zip"))).otherwise(F.col("filename")))
    rows = rows.withColumn("path", F.concat(F.coalesce("parent_dir", F.lit("")), F.lit("/"), "filename"))
    return rows.withColumns({"file_type": names.by_extension(F.col("extension"), names.SCAN_TYPES), "priority": names.priority(F.col("extension"), F.col("filename"))})


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FILES = f"""files0 AS (SELECT doc_id AS id, text AS content_text, n_chars AS size_bytes, lang, source,
  CASE WHEN doc_id % 13 = 0 THEN '.zip' ELSE {_list(EXTENSIONS)}[(doc_id % 12 + 1)::INTEGER] END AS extension, {_list(STEMS)}[(doc_id // 6 % 6 + 1)::INTEGER] AS stem0,
  CASE doc_id % 6 WHEN 0 THEN '_v' || (doc_id % 9 + 1) WHEN 1 THEN '_final' WHEN 2 THEN ' 2023-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')
    WHEN 3 THEN ' (' || (doc_id % 5) || ')' WHEN 4 THEN '_' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.2022' ELSE '' END AS ending,
  CASE WHEN doc_id % 13 = 5 THEN doc_id - 5 END AS archive_parent_id, CASE WHEN doc_id % 13 = 5 THEN 'ARCHIVE_MEMBER' ELSE 'PHYSICAL_FILE' END AS document_kind,
  CASE WHEN doc_id % 11 = 3 THEN 'MISSING' WHEN doc_id % 11 = 7 THEN NULL ELSE 'ACTIVE' END AS state,
  CASE WHEN doc_id % 13 = 5 THEN '/archives/a' || (doc_id - 5) || '.zip!' WHEN doc_id % 13 = 0 THEN '/archives' WHEN source IS NOT NULL THEN '/corpus/' || source END AS parent_dir,
  CASE WHEN doc_id % 29 <> 1 THEN TIMESTAMP '{EPOCH}' + (doc_id * 11 % 8000) * INTERVAL 1 HOUR END AS created_at, CASE WHEN doc_id % 31 <> 2 THEN TIMESTAMP '{EPOCH}' + (doc_id * 37 % 8784) * INTERVAL 1 HOUR END AS modified_at,
  TIMESTAMP '{EPOCH}' + 9000 * INTERVAL 1 HOUR AS indexed_at, doc_id % 3 AS volume_id, doc_id // 2 AS inode, doc_id % 7 AS scan_id FROM documents),
files1 AS (SELECT * EXCLUDE (stem0, ending), CASE WHEN id % 13 = 0 THEN 'a' || id || '.zip' ELSE stem0 || ending || extension END AS filename FROM files0),
files AS (SELECT *, coalesce(parent_dir, '') || '/' || filename AS path, {names.by_extension_sql('extension', names.SCAN_TYPES)} AS file_type, {names.PRIORITY_SQL} AS priority FROM files1)"""


def hashes(spark, d) -> DataFrame:
    i = F.col("id")
    rows = files(spark, d).filter(i % 7 != 2)
    return rows.select(i.alias("file_id"), F.sha2("content_text", 256).alias("digest"), (F.col("size_bytes") + (i % 19 == 4).cast("long")).alias("size_bytes"), F.when(i % 23 == 6, F.timestamp_add("HOUR", F.lit(1), "modified_at")).otherwise(F.col("modified_at")).alias("mtime"),
                       F.when(F.col("content_text").isNull(), "UNREADABLE").when(F.col("size_bytes") > 50000, "TOO_LARGE").otherwise("OK").alias("state"))


_HASHES = """hashes AS (SELECT id AS file_id, sha256(content_text) AS digest, size_bytes + (id % 19 = 4)::BIGINT AS size_bytes, CASE WHEN id % 23 = 6 THEN modified_at + INTERVAL 1 HOUR ELSE modified_at END AS mtime,
  CASE WHEN content_text IS NULL THEN 'UNREADABLE' WHEN size_bytes > 50000 THEN 'TOO_LARGE' ELSE 'OK' END AS state FROM files WHERE id % 7 <> 2)"""


def tags(spark) -> DataFrame:
    """(tag_id, name): a handful of rows."""
    return spark.createDataFrame(list(enumerate(TAGS)), "tag_id long, name string")


_TAGS = "tags AS (SELECT unnest(range(8)) AS tag_id, unnest(" + _list(TAGS) + ") AS name)"


def file_tags(spark, d) -> DataFrame:
    i, tag = F.col("id"), F.col("tag_id")
    rows = files(spark, d).select("id", "modified_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("tag_id")).filter((i * 31 + tag * 17) % 10 < 2)
    return rows.select(i.alias("file_id"), "tag_id", F.col("modified_at").alias("tagged_at"))


_FILE_TAGS = "file_tags AS (SELECT id AS file_id, tag_id, modified_at AS tagged_at FROM files, (SELECT unnest(range(7)) AS tag_id) WHERE (id * 31 + tag_id * 17) % 10 < 2)"


def favourites(spark, d) -> DataFrame:
    return files(spark, d).filter(F.col("id") % 17 == 0).select(F.col("id").alias("file_id"), F.col("indexed_at").alias("added_at"))


_FAVOURITES = "favourites AS (SELECT id AS file_id, indexed_at AS added_at FROM files WHERE id % 17 = 0)"


def queue(spark, d) -> DataFrame:
    i = F.col("id")
    rows = files(spark, d).filter(i % 5 == 1)
    return rows.select(i.alias("file_id"), _nth(OUTCOMES, F.floor(i / 5) % 8).alias("outcome"), (F.floor(i / 40) % 4 + 1).cast("long").alias("attempts"), _hours(i % 500).alias("last_attempted"), (i % 25 == 11).alias("ignored"))


_QUEUE = f"queue AS (SELECT id AS file_id, {_list(OUTCOMES)}[(id // 5 % 8 + 1)::INTEGER] AS outcome, id // 40 % 4 + 1 AS attempts, TIMESTAMP '{EPOCH}' + (id % 500) * INTERVAL 1 HOUR AS last_attempted, id % 25 = 11 AS ignored FROM files WHERE id % 5 = 1)"


def pii(spark, d) -> DataFrame:
    """(file_id, pii_type, severity, masked, count): a row a document, type and value, for the types that SQL can check."""
    text = F.col("content_text")
    kinds = F.create_map(*[x for kind, p in (("email", t.EMAIL), ("ip", t.IPV4), ("card", t.CARD)) for x in (F.lit(kind), t.matches(text, p))])
    found = files(spark, d, True).select("id", F.explode(kinds).alias("pii_type", "all")).select(F.col("id").alias("file_id"), "pii_type", F.explode("all").alias("v"))
    severity = F.when(F.col("pii_type") == "email", "medium").when(F.col("pii_type") == "ip", "low").otherwise("high")
    return found.groupBy("file_id", "pii_type", F.sha2("v", 256).alias("fingerprint")).agg(F.count("*").alias("hits")).withColumn("severity", severity)


_PII = f"""pii0 AS (SELECT id AS file_id, 'email' AS pii_type, unnest(regexp_extract_all(coalesce(content_text, ''), '{t.EMAIL}')) AS v FROM files
  UNION ALL SELECT id, 'ip', unnest(regexp_extract_all(coalesce(content_text, ''), '{t.IPV4}')) FROM files UNION ALL SELECT id, 'card', unnest(regexp_extract_all(coalesce(content_text, ''), '{t.CARD}')) FROM files),
pii AS (SELECT file_id, pii_type, sha256(v) AS fingerprint, count(*) AS hits, CASE pii_type WHEN 'email' THEN 'medium' WHEN 'ip' THEN 'low' ELSE 'high' END AS severity FROM pii0 GROUP BY file_id, pii_type, v)"""

_CTES = {"files": _FILES, "hashes": _HASHES, "tags": _TAGS, "file_tags": _FILE_TAGS, "favourites": _FAVOURITES, "queue": _QUEUE, "pii": _PII}


def sql(body: str, *views: str) -> str:
    """SQL over the views (files first). A body that begins with WITH adds its own."""
    head = "WITH " + ",\n".join(_CTES[v] for v in ("files", *views))
    return f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"


STAMP = "%Y-%m-%d %H:%M:%S"


def stamp(column):
    """A time as text, so that all engines write it alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
