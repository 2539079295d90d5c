"""Queries over the document store: merges, filters, joins, aggregates, orders, set operations, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import names, scores
from foliant.operators import relational, store
from foliant.plans import corpus
from foliant.plans.corpus import ACTIVE, NOW, STAMP, files, hashes, sql, stamp
from foliant.plans.queries import query, table

# --- writes ---------------------------------------------------------------------------------------------

_UPDATES = """WITH updates AS (SELECT path, size_bytes + (id % 8 = 0)::BIGINT AS size_bytes, CASE WHEN id % 12 = 0 THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at FROM files WHERE id % 4 = 0
  UNION ALL SELECT '/new' || path, size_bytes, modified_at FROM files WHERE id % 50 = 1)"""
_MERGED = """SELECT coalesce(f.path, u.path) AS path, CASE WHEN u.path IS NOT NULL THEN u.size_bytes ELSE f.size_bytes END AS size_bytes,
  CASE WHEN u.path IS NOT NULL AND (u.size_bytes IS DISTINCT FROM f.size_bytes OR u.modified_at IS DISTINCT FROM f.modified_at) THEN NULL ELSE f.n END AS n FROM t f FULL JOIN u ON f.path = u.path"""


def _updates(spark, d):
    i = F.col("id")
    rows = files(spark, d)
    moved = F.when(i % 12 == 0, F.timestamp_add("DAY", F.lit(1), "modified_at")).otherwise(F.col("modified_at")).alias("modified_at")
    same = rows.filter(i % 4 == 0).select("path", (F.col("size_bytes") + (i % 8 == 0).cast("long")).alias("size_bytes"), moved)
    return same.unionByName(rows.filter(i % 50 == 1).select(F.concat(F.lit("/new"), "path").alias("path"), "size_bytes", "modified_at"))


@query(sql(f"""{_UPDATES}, t AS (SELECT path, any_value(size_bytes) AS size_bytes, any_value(modified_at) AS modified_at, max(length(content_text)) AS n FROM files GROUP BY path HAVING count(*) = 1),
u AS (SELECT * FROM updates WHERE path IN (SELECT path FROM updates GROUP BY path HAVING count(*) = 1)) {_MERGED}"""))
def b1_upsert(spark, d):
    """Merge by path; a changed size or time clears the content (its length stands for it)."""
    one = files(spark, d).groupBy("path").agg(F.count("*").alias("k"), F.max("size_bytes").alias("size_bytes"), F.max("modified_at").alias("modified_at"), F.max(F.length("content_text")).cast("long").alias("n")).filter("k = 1").drop("k")
    updates = _updates(spark, d)
    unique = updates.join(updates.groupBy("path").agg(F.count("*").alias("k")).filter("k = 1"), "path", "left_semi")
    return store.merged(one, unique, "path", ["size_bytes", "modified_at"], "n").select("path", "size_bytes", "n")


@query(sql("""WITH i AS (SELECT id, path, size_bytes FROM files WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, path, size_bytes + 7 FROM files WHERE id % 6 = 0),
l AS (SELECT path, arg_max(size_bytes, id) AS size_bytes, max(id) AS id FROM i GROUP BY path) SELECT path, size_bytes, id, (SELECT count(*) FROM i) AS processed FROM l"""))
def b2_upsert_many(spark, d):
    """Of several inputs for a path the last one counts; inputs are reported, not rows."""
    rows = files(spark, d).select("id", "path", "size_bytes")
    inputs = rows.filter("id % 3 = 0").unionByName(rows.filter("id % 6 = 0").select((F.col("id") + 1000000).alias("id"), "path", (F.col("size_bytes") + 7).alias("size_bytes")))
    return store.last_by(inputs, "path", "id").crossJoin(F.broadcast(inputs.agg(F.count("*").alias("processed"))))


@query(sql("""SELECT id, archive_parent_id, size_bytes + (id % 26 = 5)::BIGINT AS size_bytes, CASE WHEN id % 26 = 5 OR id % 39 = 5 THEN NULL ELSE length(content_text) END AS n, lpad(lower(to_hex(id * 2654435761 & 4294967295)), 8, '0') AS crc
FROM files WHERE document_kind = 'ARCHIVE_MEMBER' AND id * 2654435761 & 4294967295 <> 0"""))
def b3_upsert_members(spark, d):
    """Members are merged as files are; a changed checksum or size clears the content."""
    crc = (F.col("id") * 2654435761).bitwiseAND(4294967295)
    members = files(spark, d).filter("document_kind = 'ARCHIVE_MEMBER'").select("id", "archive_parent_id", "size_bytes", F.length("content_text").cast("long").alias("n"), crc.alias("crc")).filter("crc != 0")
    updates = members.select("id", (F.col("size_bytes") + (F.col("id") % 26 == 5).cast("long")).alias("size_bytes"), (F.col("crc") + (F.col("id") % 39 == 5).cast("long")).alias("crc"))
    done = store.merged(members, updates, "id", ["size_bytes", "crc"], "n").join(members.select("id", F.col("crc").alias("known")), "id")
    return done.select("id", "archive_parent_id", "size_bytes", "n", names.crc_text(F.col("known")).alias("crc"))


@query(sql("SELECT id, length(CASE WHEN id % 9 = 2 THEN 'rewritten' ELSE content_text END) AS n, id % 9 = 2 AND content_text IS DISTINCT FROM 'rewritten' AS dirty FROM files"))
def b5_write_content(spark, d):
    """New content marks its document for a new embedding."""
    new = F.when(F.col("id") % 9 == 2, "rewritten").otherwise(F.col("content_text"))
    return files(spark, d).select("id", F.length(new).alias("n"), (~new.eqNullSafe(F.col("content_text"))).alias("dirty"))


@query("SELECT doc_id, text FROM documents")
def b6_valid_text(spark, d):
    """What is no valid UTF-8 is replaced before it is kept."""
    return table(spark, d, "documents").select("doc_id", F.make_valid_utf8("text").alias("text"))


@query(sql("""WITH u AS (SELECT id AS file_id, sha256('x' || content_text) AS digest, size_bytes FROM files WHERE id % 10 = 4)
SELECT file_id, digest, size_bytes FROM u UNION ALL SELECT file_id, digest, size_bytes FROM hashes WHERE file_id NOT IN (SELECT file_id FROM u)""", "hashes"))
def b8_upsert_hashes(spark, d):
    new = files(spark, d).filter("id % 10 = 4").select(F.col("id").alias("file_id"), F.sha2(F.concat(F.lit("x"), "content_text"), 256).alias("digest"), "size_bytes")
    return relational.upsert(hashes(spark, d).select("file_id", "digest", "size_bytes"), new, "file_id")


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_suppkey <> l_partkey")
def b9_undirected_edges(spark, d):
    return store.undirected(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000, 2 FROM embeddings WHERE vec_id % 100 = 3")
def b13_append_vectors(spark, d):
    """Appended vectors replace those of the same identifier."""
    old = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(1).alias("version"))
    new = old.filter("vec_id % 7 = 0").unionByName(old.filter("vec_id % 100 = 3").withColumn("vec_id", F.col("vec_id") + 1000000)).withColumn("version", F.lit(2))
    return store.last_by(old.unionByName(new), "vec_id", "version").select("vec_id", "version")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def b14_prune_vectors(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def b15_remove_vectors(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id")


# --- filters --------------------------------------------------------------------------------------------

_LABEL = "id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@query(sql(f"""SELECT id FROM files WHERE {ACTIVE} AND file_type = 'document' AND priority = 'critical' AND extension = lower(trim(' .PDF ')) AND size_bytes >= 200 AND size_bytes <= 20000 AND document_kind = 'PHYSICAL_FILE'
AND lang = 'en' AND {_LABEL} AND id NOT IN (SELECT file_id FROM pii WHERE severity = 'high')""", "pii"))
def c1_filters(spark, d):
    """Type, priority, extension, sizes, kind, language, category (a label), and no finding of high severity."""
    col = F.col
    rows = files(spark, d).filter(store.every(store.active(), col("file_type") == "document", col("priority") == "critical", col("extension") == F.lower(F.trim(F.lit(" .PDF "))), col("size_bytes").between(200, 20000), col("document_kind") == "PHYSICAL_FILE", col("lang") == "en"))
    rows = rows.select("id").join(table(spark, d, "labels").filter("quality = 1").select(col("doc_id").alias("id")), "id", "left_semi")
    return rows.join(corpus.pii(spark, d).filter("severity = 'high'").select(col("file_id").alias("id")), "id", "left_anti")


@query(sql("SELECT 'none' AS conditions, count(*) AS n FROM files UNION ALL SELECT 'two', count(*) FROM files WHERE lang = 'en' AND size_bytes > 500"))
def c2_all_conditions(spark, d):
    rows = files(spark, d)
    both = store.every(F.col("lang") == "en", F.col("size_bytes") > 500)
    return rows.agg(F.count_if(store.every()).alias("none"), F.count_if(both).alias("two")).select(F.explode(F.create_map(F.lit("none"), "none", F.lit("two"), "two")).alias("conditions", "n"))


@query(sql(f"SELECT id FROM files WHERE {ACTIVE}"))
def c3_active(spark, d):
    return files(spark, d).filter(store.active()).select("id")


@query(sql("SELECT id FROM files WHERE path = '/corpus/src1' OR starts_with(path, '/corpus/src1/')"))
def c5_subtree(spark, d):
    return files(spark, d).filter(names.in_subtree(F.col("path"), "/corpus/src1")).select("id")


@query(sql("SELECT id FROM files WHERE NOT (path = '/archives' OR starts_with(path, '/archives/') OR path = '/corpus/src2' OR starts_with(path, '/corpus/src2/'))"))
def c6_excluded_scopes(spark, d):
    return files(spark, d).filter(store.outside("path", ["/archives", "/corpus/src2"])).select("id")


_ADVANCED = f"{ACTIVE} AND (contains(lower(filename), 'on') OR contains(lower(content_text), 'on') OR contains(lower(path), 'on')) AND file_type IN ('document', 'code') AND (ends_with(lower(filename), '.pdf') OR ends_with(lower(filename), '.txt') OR ends_with(lower(filename), '.py')) AND modified_at >= TIMESTAMP '2024-02-01' AND modified_at <= TIMESTAMP '2024-11-30' AND size_bytes >= 100 AND size_bytes <= 30000 AND content_text <> '' AND contains(lower(path), 'corpus')"


def _advanced(spark, d):
    low = lambda c: F.contains(F.lower(c), F.lit("on"))
    ends = lambda e: F.endswith(F.lower("filename"), F.lit(e))
    at = F.col("modified_at")
    return files(spark, d).filter(store.every(store.active(), low("filename") | low("content_text") | low("path"), F.col("file_type").isin("document", "code"), ends(".pdf") | ends(".txt") | ends(".py"), at >= F.lit("2024-02-01").cast("timestamp"), at <= F.lit("2024-11-30").cast("timestamp"), F.col("size_bytes").between(100, 30000), F.col("content_text") != "", F.contains(F.lower("path"), F.lit("corpus"))))


@query(sql(f"SELECT id, filename FROM files WHERE {_ADVANCED}"))
def c7_advanced_filters(spark, d):
    return _advanced(spark, d).select("id", "filename")


@query(sql("SELECT id, filename FROM files WHERE regexp_matches(filename, '^(report|PLAN).*\\.(pdf|md)$', 'i') ORDER BY id LIMIT 50".replace("\\\\", "\\")))
def c8_name_pattern(spark, d):
    """The pattern is applied before the page is cut, so that totals count all matches."""
    return files(spark, d).filter(F.col("filename").rlike(r"(?i)^(report|PLAN).*\.(pdf|md)$")).select("id", "filename").orderBy("id").limit(50)


@query(sql("SELECT id FROM files WHERE document_kind IN ('PHYSICAL_FILE', 'ARCHIVE_MEMBER') AND size_bytes >= 1 AND starts_with(path, '/corpus/')"))
def c9_kinds(spark, d):
    return files(spark, d).filter(F.col("document_kind").isin("PHYSICAL_FILE", "ARCHIVE_MEMBER") & (F.col("size_bytes") >= 1) & F.col("path").startswith("/corpus/")).select("id")


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND length(content_text) >= 200"))
def c10_content_ids(spark, d):
    return files(spark, d).filter(store.active() & (F.length("content_text") >= 200)).select("id")


_SCOPES = {
    "all": "length(content_text) > 50", "category": _LABEL, "language": "lang = 'fr'", "date": "modified_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30'",
    "prefix": "starts_with(path, '/corpus/src3')", "dossier": "size_bytes > 1000", "file_ids": "id IN (1, 2, 3, 5, 8, 13)",
}


def scope(rows, kind: str, spark, d):
    """Rows of one scope, active ones only."""
    rows = rows.filter(store.active())
    if kind == "category":
        return rows.join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    at = F.col("modified_at")
    tests = {"all": F.length("content_text") > 50, "language": F.col("lang") == "fr", "date": at.between(F.lit("2024-03-01").cast("timestamp"), F.lit("2024-06-30").cast("timestamp")), "prefix": F.col("path").startswith("/corpus/src3"), "dossier": F.col("size_bytes") > 1000, "file_ids": F.col("id").isin(1, 2, 3, 5, 8, 13)}
    return rows.filter(tests[kind])


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS scope, id FROM files WHERE {ACTIVE} AND {c}" for k, c in _SCOPES.items())))
def c11_scopes(spark, d):
    parts = [scope(files(spark, d), k, spark, d).select(F.lit(k).alias("scope"), "id") for k in _SCOPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND {_SCOPES['all']}"))
def c12_scope_all(spark, d):
    return scope(files(spark, d), "all", spark, d).select("id")


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND {_SCOPES['prefix']}"))
def c13_scope_prefix(spark, d):
    return scope(files(spark, d), "prefix", spark, d).select("id")


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND {_SCOPES['date']}"))
def c14_scope_dates(spark, d):
    return scope(files(spark, d), "date", spark, d).select("id")


@query(sql("SELECT id, id IN (SELECT file_id FROM pii WHERE severity = 'high') AS omitted, CASE WHEN id IN (SELECT file_id FROM pii WHERE severity = 'high') THEN 'high-sensitivity PII' END AS reason FROM files", "pii"))
def c16_privacy_filter(spark, d):
    """Documents with findings of high severity are omitted, and reported."""
    high = corpus.pii(spark, d).filter("severity = 'high'").select(F.col("file_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = files(spark, d).select("id").join(high, "id", "left")
    omitted = F.coalesce("hit", F.lit(False))
    return rows.select("id", omitted.alias("omitted"), F.when(omitted, "high-sensitivity PII").alias("reason"))


@query(sql("SELECT file_id FROM pii GROUP BY file_id HAVING max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) = 3", "pii"))
def c17_high_sensitivity(spark, d):
    worst = F.max(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1))
    return corpus.pii(spark, d).groupBy("file_id").agg(worst.alias("w")).filter("w = 3").select("file_id")


@query(sql("SELECT id FROM files WHERE contains(lower(filename), 'report') AND extension IN ('.pdf', '.md') AND size_bytes / 1048576.0 BETWEEN 0 AND 0.01"))
def c18_table_filters(spark, d):
    mb = F.col("size_bytes") / 1048576
    return files(spark, d).filter(F.contains(F.lower("filename"), F.lit("report")) & F.col("extension").isin(".pdf", ".md") & mb.between(0, 0.01)).select("id")


@query(sql("SELECT id, path, filename, size_bytes, substr(content_text, 1, 300) AS preview, length(content_text) > 300 AS truncated FROM files"))
def c21_public_rows(spark, d):
    return files(spark, d).select("id", "path", "filename", "size_bytes", F.substring("content_text", 1, 300).alias("preview"), (F.length("content_text") > 300).alias("truncated"))


@query(sql("SELECT f.id, '<redacted>/' || filename AS path, filename, extension, size_bytes, document_kind, coalesce(state, 'ACTIVE') AS state, coalesce(s, 'none') AS sensitivity FROM files f LEFT JOIN (SELECT file_id AS id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS s FROM pii GROUP BY 1) p ON p.id = f.id", "pii"))
def c22_api_rows(spark, d):
    rank = F.max(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1))
    worst = corpus.pii(spark, d).groupBy(F.col("file_id").alias("id")).agg(rank.alias("w")).select("id", F.when(F.col("w") == 3, "high").when(F.col("w") == 2, "medium").otherwise("low").alias("s"))
    rows = files(spark, d).join(worst, "id", "left")
    return rows.select("id", names.shown_path(F.col("path"), True).alias("path"), "filename", "extension", "size_bytes", "document_kind", F.coalesce("state", F.lit("ACTIVE")).alias("state"), F.coalesce("s", F.lit("none")).alias("sensitivity"))


# --- joins ----------------------------------------------------------------------------------------------


@query(sql(f"""SELECT h.digest, f.id, f.path, f.size_bytes FROM hashes h JOIN files f ON f.id = h.file_id
WHERE h.state = 'OK' AND f.size_bytes >= 1 AND {ACTIVE.replace('state', 'f.state')} AND h.digest IN (SELECT digest FROM hashes JOIN files ON id = file_id WHERE hashes.state = 'OK' AND {ACTIVE.replace('state', 'files.state')} AND files.size_bytes >= 1 GROUP BY digest HAVING count(*) > 1)""", "hashes"))
def e1_hash_join(spark, d):
    """Hashes with their files, for digests that several active files have."""
    rows = hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest").join(files(spark, d).filter(store.active() & (F.col("size_bytes") >= 1)).select("id", "path", "size_bytes"), "id")
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(several, "digest", "left_semi").select("digest", "id", "path", "size_bytes")


@query(sql(f"SELECT f.id, f.size_bytes FROM files f LEFT JOIN hashes h ON h.file_id = f.id WHERE {ACTIVE.replace('state', 'f.state')} AND f.size_bytes >= 1 AND (h.file_id IS NULL OR h.size_bytes IS DISTINCT FROM f.size_bytes OR h.mtime IS DISTINCT FROM f.modified_at OR h.state = 'UNREADABLE')", "hashes"))
def e2_stale_targets(spark, d):
    """Active files whose hash is missing, unreadable, or of another size or time."""
    h = hashes(spark, d).select(F.col("file_id").alias("id"), F.col("size_bytes").alias("known"), "mtime", F.col("state").alias("how"))
    rows = files(spark, d).filter(store.active() & (F.col("size_bytes") >= 1)).select("id", "size_bytes", "modified_at").join(h, "id", "left")
    stale = F.col("how").isNull() | ~F.col("known").eqNullSafe(F.col("size_bytes")) | ~F.col("mtime").eqNullSafe(F.col("modified_at")) | (F.col("how") == "UNREADABLE")
    return rows.filter(stale).select("id", "size_bytes")


@query(sql(f"SELECT f.id FROM files f LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) s ON s.doc_id = f.id WHERE {ACTIVE} AND length(content_text) >= 20 AND (s.doc_id IS NULL OR n + length(content_text) <> size_bytes + 1)"))
def e3_intel_stale(spark, d):
    """Documents without annotations, or whose annotations are of another length of text."""
    known = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    rows = files(spark, d).filter(store.active() & (F.length("content_text") >= 20)).join(known, "id", "left")
    return rows.filter(F.col("n").isNull() | (F.col("n") + F.length("content_text") != F.col("size_bytes") + 1)).select("id")


@query(sql("SELECT file_id FROM hashes WHERE file_id NOT IN (SELECT id FROM files WHERE state = 'MISSING')", "hashes"))
def e7_prune(spark, d):
    return hashes(spark, d).select("file_id").join(files(spark, d).filter("state = 'MISSING'").select(F.col("id").alias("file_id")), "file_id", "left_anti")


@query(sql(f"SELECT id, NOT ({ACTIVE} AND length(content_text) > 0) AND EXISTS (SELECT 1 FROM embeddings WHERE vec_id = id) AS prune, {ACTIVE} AND coalesce(length(content_text) > 0, false) AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = id) AS dirty FROM files").replace("NOT (coalesce(state, 'ACTIVE') = 'ACTIVE' AND length(content_text) > 0)", "NOT (coalesce(state, 'ACTIVE') = 'ACTIVE' AND coalesce(length(content_text) > 0, false))"))
def e8_reconcile_flags(spark, d):
    """Vectors of documents that are gone are to be pruned, documents without vectors to be embedded."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).distinct().withColumn("have", F.lit(True))
    rows = files(spark, d).select("id", (store.active() & F.coalesce(F.length("content_text") > 0, F.lit(False))).alias("live")).join(have, "id", "left")
    has = F.coalesce("have", F.lit(False))
    return rows.select("id", (~F.col("live") & has).alias("prune"), (F.col("live") & ~has).alias("dirty"))


@query(sql("""WITH k AS (SELECT volume_id, inode, size_bytes, count(*) FILTER (state = 'MISSING') AS a, count(*) FILTER (state IS DISTINCT FROM 'MISSING') AS b, max(id) FILTER (state = 'MISSING') AS old_id, max(id) FILTER (state IS DISTINCT FROM 'MISSING') AS new_id FROM (SELECT *, id // 44 AS k0 FROM files) GROUP BY 1, 2, 3) SELECT old_id, new_id FROM k WHERE a = 1 AND b = 1""".replace("volume_id, inode, size_bytes, count", "k0, lang, volume_id, count").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3")))
def e9_renames(spark, d):
    """A file that is gone and one that is new with the same identity (here block, language and volume): only one-to-one pairs."""
    rows = files(spark, d).withColumn("k0", F.floor(F.col("id") / 44))
    gone = F.col("state").eqNullSafe("MISSING")
    return store.only_pairs(rows, ["k0", "lang", "volume_id"], "id", gone, ~gone)


@query("SELECT a.conv_id, a.turn, b.turn AS other_turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def e10_thread_join(spark, d):
    """Messages of one thread, each with every other."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return rows.select("conv_id", "turn").join(rows.select("conv_id", F.col("turn").alias("other_turn"), "role"), "conv_id").filter("turn != other_turn")


@query(sql("""WITH x AS (SELECT id, list_distinct(list(DISTINCT tag_id)) AS w FROM (SELECT id FROM files ORDER BY id LIMIT 100) JOIN file_tags ON file_id = id GROUP BY id),
p AS (SELECT a.id AS src, b.id AS dst, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS j FROM x a JOIN x b ON a.id < b.id) SELECT src, dst, round(j, 6) AS jaccard FROM p WHERE j > 0.1""", "file_tags"))
def e18_tag_network(spark, d):
    """Pairs among at most a hundred documents whose tags' Jaccard similarity is over 0.1; shared tags are counted by a join."""
    first = files(spark, d).select(F.col("id").alias("file_id")).orderBy("file_id").limit(100)
    rows = corpus.file_tags(spark, d).select("file_id", "tag_id").distinct().join(first, "file_id", "left_semi")
    n = rows.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = rows.join(n, "file_id")
    a, b = rows.select("tag_id", F.col("file_id").alias("src"), F.col("n").alias("na")), rows.select("tag_id", F.col("file_id").alias("dst"), F.col("n").alias("nb"))
    both = a.join(b, "tag_id").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return both.filter(j > 0.1).select("src", "dst", F.round(j, 6).alias("jaccard"))


@query("WITH c AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT a.p_brand AS first, b.p_brand AS second, count(*) AS shared FROM c a JOIN c b ON a.p_type = b.p_type AND a.p_brand < b.p_brand GROUP BY 1, 2")
def e19_shared_categories(spark, d):
    """Pairs of groups (brands) that share a category (type), by the number of shared ones."""
    c = table(spark, d, "part").select("p_brand", "p_type").distinct()
    pairs = c.select("p_type", F.col("p_brand").alias("first")).join(c.select("p_type", F.col("p_brand").alias("second")), "p_type").filter("first < second")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("shared"))


@query(sql("SELECT id, filename FROM files WHERE id IN (SELECT event_id * 3 FROM events WHERE event_type = 'click')"))
def e21_point_lookup(spark, d):
    wanted = table(spark, d, "events").filter("event_type = 'click'").select((F.col("event_id") * 3).alias("id"))
    return files(spark, d).select("id", "filename").join(wanted, "id", "left_semi")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def e23_definition_title(spark, d):
    """Artifacts (lines) with the title of their definition (order), also where it is gone."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey", "left")


# --- aggregates -----------------------------------------------------------------------------------------

_TOP = "SELECT * FROM (SELECT '{k}' AS part, {c}::VARCHAR AS name, count(*) AS files, sum(size_bytes)::BIGINT AS total FROM files GROUP BY 2 ORDER BY files DESC, name LIMIT {n})"


@query(sql(f"""SELECT 'all' AS part, NULL AS name, count(*) AS files, sum(size_bytes)::BIGINT AS total FROM files UNION ALL {_TOP.format(k='type', c='file_type', n=100)} UNION ALL {_TOP.format(k='priority', c='priority', n=100)}
UNION ALL {_TOP.format(k='extension', c='extension', n=10)} UNION ALL SELECT * FROM (SELECT 'largest' AS part, id::VARCHAR AS name, 1, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 10)"""))
def f1_index_statistics(spark, d):
    """Totals, counts by type and priority, the ten most frequent extensions and the ten largest files."""
    rows = files(spark, d)
    count = lambda part, c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total")).select(F.lit(part).alias("part"), "name", "files", "total")
    whole = rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total")).select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("name"), "files", "total")
    largest = rows.select("id", "size_bytes").orderBy(F.desc("size_bytes"), "id").limit(10).select(F.lit("largest").alias("part"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("files"), F.col("size_bytes").alias("total"))
    top = count("extension", "extension").orderBy(F.desc("files"), "name").limit(10)
    return whole.unionByName(count("type", "file_type")).unionByName(count("priority", "priority")).unionByName(top).unionByName(largest)


@query(sql("""SELECT 'range' AS part, (CASE WHEN size_bytes < 1024 THEN 0 WHEN size_bytes < 10240 THEN 1 WHEN size_bytes < 102400 THEN 2 WHEN size_bytes < 1048576 THEN 3 WHEN size_bytes < 10485760 THEN 4 WHEN size_bytes < 104857600 THEN 5 ELSE 6 END)::VARCHAR AS name, count(*) AS files, sum(size_bytes)::BIGINT AS total FROM files WHERE size_bytes > 0 GROUP BY 2
UNION ALL SELECT 'all', NULL, count(*), sum(size_bytes)::BIGINT FROM files WHERE size_bytes > 0 UNION ALL SELECT * FROM (SELECT 'type', file_type, count(*) AS n, sum(size_bytes)::BIGINT FROM files WHERE size_bytes > 0 GROUP BY 2 ORDER BY n DESC, file_type LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'recent', id::VARCHAR, 1, size_bytes FROM files WHERE size_bytes > 0 ORDER BY modified_at DESC NULLS LAST, id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'largest', id::VARCHAR, 1, size_bytes FROM files WHERE size_bytes > 0 ORDER BY size_bytes DESC, id LIMIT 20)"""))
def f2_overview(spark, d):
    """Over files that are not empty: totals, the 15 most frequent types, size ranges, the 20 latest and the 20 largest."""
    rows = files(spark, d).filter("size_bytes > 0").select("id", "size_bytes", "file_type", "modified_at")
    ranges = relational.size_ranges(rows, "size_bytes", (0, 1024, 10240, 102400, 1048576, 10485760, 104857600)).select(F.lit("range").alias("part"), F.col("size_range").cast("string").alias("name"), "files", "total")
    whole = rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total")).select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("name"), "files", "total")
    kinds = rows.groupBy(F.col("file_type").alias("name")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total")).orderBy(F.desc("files"), "name").limit(15).select(F.lit("type").alias("part"), "name", "files", "total")
    one = lambda part, *order: rows.orderBy(*order, "id").limit(20).select(F.lit(part).alias("part"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("files"), F.col("size_bytes").alias("total"))
    return ranges.unionByName(whole).unionByName(kinds).unionByName(one("recent", F.desc_nulls_last("modified_at"))).unionByName(one("largest", F.desc("size_bytes")))


@query(sql("SELECT 'searchable' AS part, NULL AS file_type, count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM files WHERE length(content_text) > 0 UNION ALL SELECT 'other', NULL, count(*), coalesce(sum(size_bytes), 0)::BIGINT FROM files WHERE coalesce(length(content_text), 0) = 0 UNION ALL SELECT 'opportunity', file_type, count(*), sum(size_bytes)::BIGINT FROM files WHERE coalesce(length(content_text), 0) < 300 GROUP BY 2"))
def f7_searchable(spark, d):
    """Files with and without text, and by type those with none (here: little) that could be extracted."""
    rows = files(spark, d).select("file_type", "size_bytes", F.coalesce(F.length("content_text"), F.lit(0)).alias("n"))
    sums = lambda df, part: df.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).select(F.lit(part).alias("part"), F.lit(None).cast("string").alias("file_type"), "files", "bytes")
    by = rows.filter("n < 300").groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).select(F.lit("opportunity").alias("part"), "file_type", "files", "bytes")
    return sums(rows.filter("n > 0"), "searchable").unionByName(sums(rows.filter("n = 0"), "other")).unionByName(by)


@query(sql("""WITH g AS (SELECT md5(content_text) AS h, count(*) AS n FROM files WHERE content_text IS NOT NULL GROUP BY 1)
SELECT 'files' AS metric, NULL AS name, count(*) AS n FROM files UNION ALL SELECT 'unique', NULL, count(*) FROM g UNION ALL SELECT 'copies', NULL, coalesce(sum(n - 1), 0)::BIGINT FROM g
UNION ALL SELECT 'year', strftime(modified_at, '%Y'), count(*) FROM files WHERE modified_at IS NOT NULL GROUP BY 2 UNION ALL SELECT 'extension', extension, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'type', file_type, count(*) FROM files GROUP BY 2"""))
def f8_scan_statistics(spark, d):
    """Files, different contents, copies beyond the first, and counts by year, extension and type."""
    rows = files(spark, d)
    groups = rows.filter("content_text is not null").groupBy(F.md5("content_text").alias("h")).agg(F.count("*").alias("n"))
    line = lambda metric, df, name, n: df.select(F.lit(metric).alias("metric"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    none = F.lit(None)
    out = line("files", rows.agg(F.count("*").alias("n")), none, F.col("n"))
    both = groups.agg(F.count("*").alias("u"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("c"))
    out = out.unionByName(line("unique", both, none, F.col("u"))).unionByName(line("copies", both, none, F.col("c")))
    by = lambda metric, c: line(metric, rows.filter(c.isNotNull()).groupBy(c.alias("k")).agg(F.count("*").alias("n")), F.col("k"), F.col("n"))
    return out.unionByName(by("year", F.date_format("modified_at", "yyyy"))).unionByName(by("extension", F.col("extension"))).unionByName(by("type", F.col("file_type")))


@query(sql("SELECT 'language' AS part, lang AS name, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'pii', pii_type, count(*) FROM pii GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM pii GROUP BY 2 UNION ALL SELECT 'category', quality::VARCHAR, count(*) FROM labels GROUP BY 2", "pii"))
def f13_intel_statistics(spark, d):
    found = corpus.pii(spark, d).select("pii_type", "severity")
    part = lambda kind, df, c: df.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("part"), "name", "n")
    kinds = store.facets(found, ["pii_type", "severity"]).select(F.when(F.col("facet") == "pii_type", "pii").otherwise("severity").alias("part"), F.col("value").alias("name"), "n")
    return part("language", files(spark, d), "lang").unionByName(kinds).unionByName(part("category", table(spark, d, "labels"), "quality"))


@query(sql("SELECT pii_type, fingerprint, count(DISTINCT file_id) AS docs FROM pii GROUP BY 1, 2 HAVING count(DISTINCT file_id) >= 2 ORDER BY docs DESC, pii_type, fingerprint LIMIT 200", "pii"))
def f15_entity_nodes(spark, d):
    rows = corpus.pii(spark, d).groupBy("pii_type", "fingerprint").agg(F.count("*").alias("docs"))  # a row a document and value
    return rows.filter("docs >= 2").orderBy(F.desc("docs"), "pii_type", "fingerprint").limit(200)


@query(sql("SELECT pii_type, severity, count(DISTINCT file_id) AS docs, sum(hits)::BIGINT AS hits FROM pii GROUP BY 1, 2", "pii"))
def f16_pii_summary(spark, d):
    a_doc = corpus.pii(spark, d).groupBy("pii_type", "severity", "file_id").agg(F.sum("hits").alias("hits"))
    return a_doc.groupBy("pii_type", "severity").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))


@query(sql("SELECT strftime(modified_at, '%Y-%m') AS bucket, label AS cluster, count(*) AS n FROM files JOIN embeddings ON vec_id = id WHERE modified_at IS NOT NULL GROUP BY 1, 2"))
def f19_topic_over_time(spark, d):
    """Documents a month and cluster; a vector and the document of the same identifier belong together."""
    rows = files(spark, d).filter("modified_at is not null").select("id", F.date_format("modified_at", "yyyy-MM").alias("bucket"))
    return rows.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), "id").groupBy("bucket", "cluster").agg(F.count("*").alias("n"))


_RETRY = "outcome IN (" + ", ".join(f"'{o}'" for o in scores.RETRYABLE) + ") AND attempts < 3"


@query(sql(f"SELECT outcome, count(*) AS n, count(*) FILTER ({_RETRY} AND NOT ignored) AS pending FROM queue GROUP BY outcome", "queue"))
def f20_queue_statistics(spark, d):
    pending = scores.retryable(F.col("outcome"), F.col("attempts")) & ~F.col("ignored")
    return corpus.queue(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(pending).alias("pending"))


_LIVE = f"{ACTIVE} AND coalesce(length(content_text) > 0, false)"


@query(sql(f"SELECT count(*) FILTER ({_LIVE}) AS eligible, count(*) FILTER ({_LIVE} AND id IN (SELECT vec_id FROM embeddings)) AS embedded, round(100.0::DOUBLE * count(*) FILTER ({_LIVE} AND id IN (SELECT vec_id FROM embeddings)) / greatest(1, count(*) FILTER ({_LIVE})), 2) AS percent FROM files"))
def f22_semantic_coverage(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).distinct().withColumn("have", F.lit(True))
    rows = files(spark, d).filter(store.active() & (F.length("content_text") > 0)).select("id").join(have, "id", "left")
    return rows.agg(F.count("*").alias("eligible"), F.count("have").alias("embedded")).select("*", F.round(100.0 * F.col("embedded") / F.greatest(F.lit(1), "eligible"), 2).alias("percent"))


@query(sql(f"SELECT count(*) AS eligible, count(*) FILTER (length(content_text) > 0) AS extracted, round(100.0::DOUBLE * count(*) FILTER (length(content_text) > 0) / greatest(1, count(*)), 2) AS percent FROM files WHERE {ACTIVE} AND file_type IN ('document', 'email', 'code')"))
def f23_extraction_coverage(spark, d):
    rows = files(spark, d).filter(store.active() & F.col("file_type").isin("document", "email", "code"))
    return rows.agg(F.count("*").alias("eligible"), F.count_if(F.length("content_text") > 0).alias("extracted")).select("*", F.round(100.0 * F.col("extracted") / F.greatest(F.lit(1), "eligible"), 2).alias("percent"))


@query(sql("SELECT t.tag_id, name, count(file_id) AS files FROM tags t LEFT JOIN file_tags f ON f.tag_id = t.tag_id GROUP BY 1, 2", "tags", "file_tags"))
def f24_tags(spark, d):
    counts = corpus.file_tags(spark, d).groupBy("tag_id").agg(F.count("*").alias("files"))
    return corpus.tags(spark).join(counts, "tag_id", "left").select("tag_id", "name", F.coalesce("files", F.lit(0)).alias("files"))


@query(sql("SELECT name, count(*) AS uses FROM tags t JOIN file_tags f ON f.tag_id = t.tag_id GROUP BY 1 ORDER BY uses DESC, name LIMIT 20", "tags", "file_tags"))
def f25_popular_tags(spark, d):
    return f24_tags(spark, d).filter("files > 0").select("name", F.col("files").alias("uses")).orderBy(F.desc("uses"), "name").limit(20)


@query(sql("SELECT (SELECT count(*) FROM tags) AS tags, count(DISTINCT file_id) AS tagged, count(*) AS links, round(count(*)::DOUBLE / greatest(1, count(DISTINCT file_id)), 4) AS per_file FROM file_tags", "tags", "file_tags"))
def f26_tag_statistics(spark, d):
    a_file = corpus.file_tags(spark, d).groupBy("file_id").agg(F.count("*").alias("n"))
    rows = a_file.agg(F.count("*").alias("tagged"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))
    return rows.crossJoin(corpus.tags(spark).agg(F.count("*").alias("tags"))).select("tags", "tagged", "links", F.round(F.col("links") / F.greatest(F.lit(1), "tagged"), 4).alias("per_file"))


@query("""WITH a AS (SELECT from_json('["k' || (event_id % 23) || '", "' || event_type || '"]', '["VARCHAR"]') AS topics FROM events), u AS (SELECT unnest(topics) AS topic FROM a) SELECT topic, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, topic LIMIT 10""")
def f27_topic_frequency(spark, d):
    """The ten most frequent entries of JSON arrays."""
    text = F.concat(F.lit('["k'), (F.col("event_id") % 23).cast("string"), F.lit('", "'), "event_type", F.lit('"]'))
    topics = table(spark, d, "events").select(F.explode(F.from_json(text, "array<string>")).alias("topic"))
    return topics.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query(sql("""WITH c AS (SELECT coalesce(parent_dir, 'Root') AS folder, file_type, count(*) AS n, sum(size_bytes) AS s FROM files GROUP BY 1, 2)
SELECT folder, sum(n)::BIGINT AS files, sum(s)::BIGINT AS total, arg_min(file_type, struct_pack(a := -n, b := file_type)) AS common FROM c GROUP BY folder ORDER BY files DESC, folder LIMIT 20"""))
def f31_folder_mode(spark, d):
    counts = files(spark, d).groupBy(F.coalesce("parent_dir", F.lit("Root")).alias("folder"), "file_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("s"))
    rows = counts.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("s").alias("total"), F.min_by("file_type", F.struct(-F.col("n"), F.col("file_type"))).alias("common"))
    return rows.orderBy(F.desc("files"), "folder").limit(20)


_SCORES = {"organisation": "parent_dir IS NOT NULL", "content": "length(content_text) > 0", "recency": "modified_at >= TIMESTAMP '2024-07-01'", "active": ACTIVE, "important": "priority IN ('critical', 'high')", "tagged": "id IN (SELECT file_id FROM file_tags)"}


@query(sql("SELECT " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({c}) / greatest(1, count(*)), 3) AS {k}" for k, c in _SCORES.items()) + " FROM files", "file_tags"))
def f33_six_scores(spark, d):
    """Six shares of files between 0 and 100, in one pass."""
    tagged = corpus.file_tags(spark, d).select(F.col("file_id").alias("id")).distinct().withColumn("tag", F.lit(True))
    rows = files(spark, d).join(tagged, "id", "left")
    tests = {"organisation": F.col("parent_dir").isNotNull(), "content": F.length("content_text") > 0, "recency": F.col("modified_at") >= F.lit("2024-07-01").cast("timestamp"), "active": store.active(), "important": F.col("priority").isin("critical", "high"), "tagged": F.col("tag").isNotNull()}
    return rows.agg(*[F.round(100.0 * F.count_if(c) / F.greatest(F.lit(1), F.count("*")), 3).alias(k) for k, c in tests.items()])


@query(sql("SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT file_type) AS types, count(DISTINCT parent_dir) AS folders, count(*) FILTER (length(content_text) > 0) AS searchable, round(avg(size_bytes), 3) AS mean FROM files"))
def f34_system_statistics(spark, d):
    return files(spark, d).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.countDistinct("file_type").alias("types"), F.countDistinct("parent_dir").alias("folders"), F.count_if(F.length("content_text") > 0).alias("searchable"), F.round(F.avg("size_bytes"), 3).alias("mean"))


@query(sql("SELECT digest, list_sort(list(file_id)) AS ids, min(file_id) AS master, count(*) AS n FROM hashes WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1", "hashes"))
def f35_duplicate_lists(spark, d):
    """Copies of a content with the smallest as master. The list is the feature; f9 and l12 give the same without one."""
    rows = hashes(spark, d).filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("file_id")).alias("ids"))
    return rows.filter("n > 1").select("digest", "ids", F.element_at("ids", 1).alias("master"), "n")


@query(sql("SELECT file_type, priority, coalesce(state, 'ACTIVE') AS state, count(*) AS n FROM files GROUP BY 1, 2, 3"))
def f36_statistics(spark, d):
    return files(spark, d).groupBy("file_type", "priority", F.coalesce("state", F.lit("ACTIVE")).alias("state")).agg(F.count("*").alias("n"))


# --- window-like ----------------------------------------------------------------------------------------


@query(sql("WITH r AS (SELECT h.digest, f.id, f.size_bytes, row_number() OVER (PARTITION BY h.digest ORDER BY f.size_bytes DESC, f.id) AS a, row_number() OVER (PARTITION BY f.parent_dir, f.file_type ORDER BY f.size_bytes DESC, f.id) AS b FROM files f JOIN hashes h ON h.file_id = f.id WHERE h.state = 'OK') SELECT id, a = 1 AS first_copy, b = 1 AS first_of_family FROM r", "hashes"))
def g2_first_of_each(spark, d):
    """First row per digest, and per family (folder and type), in ranking order."""
    rows = files(spark, d).select("id", "size_bytes", "parent_dir", "file_type").join(hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest"), "id")
    order = F.struct(-F.col("size_bytes"), F.col("id"))
    a = rows.groupBy("digest").agg(F.min_by("id", order).alias("id")).select("id", F.lit(True).alias("a"))
    b = rows.groupBy("parent_dir", "file_type").agg(F.min_by("id", order).alias("id")).select("id", F.lit(True).alias("b"))
    return rows.select("id").join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("first_copy"), F.coalesce("b", F.lit(False)).alias("first_of_family"))


@query("SELECT user_id, event_type, max(value) AS best, arg_max(event_id, struct_pack(a := value, b := -event_id)) AS source FROM events GROUP BY 1, 2")
def g6_best_score(spark, d):
    """The best score of each (user, type) and the row it comes from; ties by the smallest identifier."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("source"))


@query(sql("SELECT digest, id, place FROM (SELECT h.digest, f.id, row_number() OVER (PARTITION BY h.digest ORDER BY f.path, f.id) AS place, count(*) OVER (PARTITION BY h.digest) AS n FROM files f JOIN hashes h ON h.file_id = f.id WHERE h.digest IS NOT NULL) WHERE n > 1 AND place <= 100", "hashes"))
def g8_group_members(spark, d):
    """The first hundred members of each duplicate group by path."""
    rows = files(spark, d).select("id", "path").join(hashes(spark, d).filter("digest is not null").select(F.col("file_id").alias("id"), "digest"), "id")
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return relational.top_per_group(rows.join(several, "digest", "left_semi"), "digest", [F.col("path"), F.col("id")], 100).select("digest", "id", "place")


@query("SELECT label, mode() WITHIN GROUP (ORDER BY label) AS same, count(*) AS n, max(vec_id) + 1 AS next_position FROM embeddings GROUP BY label")
def g12_next_position(spark, d):
    """The next position after the last one of each group, 0 for an empty one."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.mode("label").alias("same"), F.count("*").alias("n"), (F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).alias("next_position"))


# --- orders and limits ----------------------------------------------------------------------------------


@query(sql(f"SELECT id, priority, {names.RANK_SQL} AS rank FROM files ORDER BY rank, size_bytes DESC, id LIMIT 100"))
def h1_priority_order(spark, d):
    rows = files(spark, d).select("id", "priority", "size_bytes", names.priority_rank(F.col("priority")).alias("rank"))
    return rows.orderBy("rank", F.desc("size_bytes"), "id").limit(100).select("id", "priority", "rank")


@query(sql(f"SELECT id, strftime(modified_at, '{STAMP}') AS modified FROM files WHERE {ACTIVE} ORDER BY modified_at DESC NULLS LAST, id LIMIT 10"))
def h2_recent(spark, d):
    return files(spark, d).filter(store.active()).orderBy(F.desc_nulls_last("modified_at"), "id").limit(10).select("id", stamp("modified_at").alias("modified"))


@query(sql(f"SELECT id FROM files WHERE file_type = 'document' AND coalesce(length(content_text), 0) < 200 ORDER BY {names.RANK_SQL}, size_bytes, id LIMIT 100"))
def h3_unprocessed(spark, d):
    rows = files(spark, d).filter((F.col("file_type") == "document") & (F.coalesce(F.length("content_text"), F.lit(0)) < 200))
    return rows.orderBy(names.priority_rank(F.col("priority")), "size_bytes", "id").limit(100).select("id")


@query(sql(f"SELECT f.id FROM files f LEFT JOIN hashes h ON h.file_id = f.id WHERE {ACTIVE.replace('state', 'f.state')} AND f.size_bytes >= 1 AND (h.file_id IS NULL OR h.size_bytes IS DISTINCT FROM f.size_bytes OR h.mtime IS DISTINCT FROM f.modified_at OR h.state = 'UNREADABLE') ORDER BY f.size_bytes, f.id LIMIT 50", "hashes"))
def h4_smallest_stale(spark, d):
    return e2_stale_targets(spark, d).orderBy("size_bytes", "id").limit(50).select("id")


@query("SELECT l_partkey AS other, round(max(l_discount), 4) AS score FROM lineitem WHERE l_suppkey = 1 GROUP BY 1 ORDER BY score DESC, other LIMIT 20")
def h5_edges_of(spark, d):
    """Edges of one node by score, null as 0."""
    rows = table(spark, d, "lineitem").filter("l_suppkey = 1").groupBy(F.col("l_partkey").alias("other")).agg(F.round(F.max(F.coalesce("l_discount", F.lit(0.0))), 4).alias("score"))
    return rows.orderBy(F.desc("score"), "other").limit(20)


@query(sql("SELECT id FROM files ORDER BY size_bytes DESC, id LIMIT 25 OFFSET 50"))
def h8_page(spark, d):
    return files(spark, d).select("id", "size_bytes").orderBy(F.desc("size_bytes"), "id").offset(50).limit(25).select("id")


@query(sql(f"SELECT file_id, attempts FROM queue WHERE {_RETRY} AND NOT ignored AND last_attempted + least(3600, 60 * pow(5, attempts - 1)) * INTERVAL 1 SECOND <= TIMESTAMP '{NOW}' ORDER BY attempts, last_attempted, file_id LIMIT 200", "queue"))
def h9_retry_order(spark, d):
    due = F.timestamp_add("SECOND", scores.backoff_seconds(F.col("attempts")), "last_attempted") <= F.lit(NOW).cast("timestamp")
    rows = corpus.queue(spark, d).filter(scores.retryable(F.col("outcome"), F.col("attempts")) & ~F.col("ignored") & due)
    return rows.orderBy("attempts", "last_attempted", "file_id").limit(200).select("file_id", "attempts")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def h10_audit_tail(spark, d):
    return table(spark, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(1000)


@query("SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100")
def h11_seeded_sample(spark, d):
    """Exactly so many rows, the same in every run: the first by a seeded hash."""
    return table(spark, d, "embeddings").select("vec_id", F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string"))).alias("h")).orderBy("h", "vec_id").limit(100).select("vec_id")


@query(sql("SELECT id FROM files ORDER BY md5('42:' || id), id LIMIT 1000"))
def h12_sample(spark, d):
    return files(spark, d).select("id", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("h")).orderBy("h", "id").limit(1000).select("id")


# --- set operations -------------------------------------------------------------------------------------


@query(sql("SELECT id, max(a) AS lexical, max(b) AS semantic FROM (SELECT id, size_bytes AS a, NULL AS b FROM files WHERE size_bytes > 2000 UNION ALL SELECT vec_id, NULL, label FROM embeddings WHERE vec_id % 3 = 0) GROUP BY id"))
def i1_union_of_results(spark, d):
    a = files(spark, d).filter("size_bytes > 2000").select("id", F.col("size_bytes").alias("lexical"))
    b = table(spark, d, "embeddings").filter("vec_id % 3 = 0").groupBy(F.col("vec_id").alias("id")).agg(F.max("label").alias("semantic"))
    return a.join(b, "id", "full_outer")


@query(sql("SELECT id, CASE WHEN id % 4 = 1 THEN 'MISSING' ELSE 'ACTIVE' END AS state FROM files WHERE document_kind = 'ARCHIVE_MEMBER'"))
def i2_missing_members(spark, d):
    """Members of archives that a new listing does not hold are missing."""
    known = files(spark, d).filter("document_kind = 'ARCHIVE_MEMBER'").select("id", "path")
    seen = known.filter("id % 4 != 1").select("path", F.lit(True).alias("seen")).distinct()
    return known.join(seen, "path", "left").select("id", F.when(F.col("seen"), "ACTIVE").otherwise("MISSING").alias("state"))


@query(sql("SELECT count(*) FILTER (a AND NOT b) AS removed, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND b) AS unchanged FROM (SELECT id % 3 <> 0 AS a, id % 4 <> 0 AS b FROM files)"))
def i4_refresh_preview(spark, d):
    """What a refresh of a frozen membership would add, remove and keep, without doing it."""
    rows = files(spark, d).select("id")
    before, after = rows.filter("id % 3 != 0").withColumn("a", F.lit(True)), rows.filter("id % 4 != 0").withColumn("b", F.lit(True))
    both = before.join(after, "id", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("a") & F.col("b")).alias("unchanged"))


@query(sql("SELECT f.id, CASE WHEN f.scan_id = 3 OR (f.archive_parent_id IS NOT NULL AND p.scan_id = 3) THEN 'MISSING' ELSE 'ACTIVE' END AS state FROM files f LEFT JOIN files p ON p.id = f.archive_parent_id WHERE f.volume_id IN (0, 1, 2)"))
def i5_missing(spark, d):
    """Rows that the last scan of their scope did not see are missing, and with an archive its members."""
    from foliant.operators import lifecycle

    rows = files(spark, d).select("id", "archive_parent_id", "scan_id", F.lit("ACTIVE").alias("state"))
    return lifecycle.reconciled(rows.drop("scan_id"), rows.filter("scan_id != 3").select("id"), "id", "archive_parent_id", 2).select("id", "state")


@query(sql(f"SELECT file_id, pii_type FROM pii WHERE file_id IN (SELECT id FROM files WHERE {ACTIVE}) GROUP BY 1, 2", "pii"))
def i7_prune_derived(spark, d):
    live = files(spark, d).filter(store.active()).select(F.col("id").alias("file_id"))
    return corpus.pii(spark, d).join(live, "file_id", "left_semi").select("file_id", "pii_type").distinct()


@query(sql(f"WITH m AS (SELECT volume_id, parent_dir, id FROM files WHERE {ACTIVE} AND parent_dir IS NOT NULL) SELECT parent_dir, volume_id, count(*) AS members FROM m GROUP BY 1, 2 HAVING count(*) >= 2"))
def i8_prune_families(spark, d):
    """Members that are gone leave their families, and families with fewer than two members go."""
    return files(spark, d).filter(store.active() & F.col("parent_dir").isNotNull()).groupBy("parent_dir", "volume_id").agg(F.count("*").alias("members")).filter("members >= 2")


@query(sql(f"SELECT file_id, digest FROM hashes WHERE file_id IN (SELECT id FROM files WHERE {ACTIVE})", "hashes"))
def i9_prune_hashes(spark, d):
    return hashes(spark, d).join(files(spark, d).filter(store.active()).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", "digest")


@query(sql(f"SELECT file_id FROM queue WHERE file_id IN (SELECT id FROM files WHERE {ACTIVE})", "queue"))
def i10_prune_queue(spark, d):
    return corpus.queue(spark, d).join(files(spark, d).filter(store.active()).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id")


@query(sql("SELECT 'labels' AS part, count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM files WHERE id % 2 = 0) UNION ALL SELECT 'events', count(*) FROM events WHERE event_id NOT IN (SELECT id FROM files)"))
def i12_orphans(spark, d):
    """Rows of referencing tables whose file does not exist, a table a row."""
    ids = files(spark, d).select("id")
    part = lambda name, key, known: table(spark, d, name).select(F.col(key).alias("id")).join(known, "id", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("part"), "orphans")
    return part("labels", "doc_id", ids).unionByName(part("embeddings", "vec_id", ids.filter("id % 2 = 0"))).unionByName(part("events", "event_id", ids))


@query("SELECT event_type, min(event_id) AS place FROM events GROUP BY event_type")
def i15_distinct_in_order(spark, d):
    """Distinct values with the place of their first use."""
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("place"))
