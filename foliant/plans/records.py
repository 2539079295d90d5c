"""Queries of reports, dossiers, reconstruction, state keeping, tags, archives' rows, health and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import names, scores
from foliant.functions import text as t
from foliant.operators import lifecycle, relational, store
from foliant.operators.scratch import cut
from foliant.plans import corpus
from foliant.plans.corpus import ACTIVE, STAMP, files, hashes, sql, stamp
from foliant.plans.queries import query, table
from foliant.plans.retrieval import _EVENTS, _FULL, _SIM, _full_text, _similar, _timeline
from foliant.plans.texts import _CATEGORIES, _FAMILIES, bucket, k19_categories, version_table

_ids = lambda df, key="file_id": df.select(F.col(key).alias("id")).distinct()


def _flag(rows, ids, name: str):
    """rows with a boolean: whether its id is in ids."""
    return rows.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


# --- reports --------------------------------------------------------------------------------------------

_DUP = "dup AS (SELECT digest, count(*) AS copies, (count(*) - 1) * max(size_bytes) AS wasted FROM hashes WHERE state = 'OK' AND digest IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


def _duplicate_groups(spark, d):
    groups = hashes(spark, d).filter("state = 'OK' and digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.max("size_bytes").alias("size"))
    return groups.filter("copies > 1").select("digest", "copies", ((F.col("copies") - 1) * F.col("size")).alias("wasted"))


@query(sql(f"WITH {_DUP} SELECT 'duplicates' AS section, count(*) AS sources FROM dup UNION ALL SELECT 'timeline', count(*) FROM ({_EVENTS}) UNION ALL SELECT 'pii', count(DISTINCT file_id) FROM pii UNION ALL SELECT 'ingestion', count(*) FROM queue", "hashes", "pii", "queue"))
def o1_report_sections(spark, d):
    """Sources of each kind of report."""
    part = lambda name, df: df.agg(F.count("*").alias("sources")).select(F.lit(name).alias("section"), "sources")
    out = part("duplicates", _duplicate_groups(spark, d)).unionByName(part("timeline", _timeline(spark, d)))
    return out.unionByName(part("pii", _ids(corpus.pii(spark, d)))).unionByName(part("ingestion", corpus.queue(spark, d)))


@query(sql(f"WITH {_FULL} SELECT id, filename, score, row_number() OVER (ORDER BY score DESC, id) AS ref, substr(content_text, 1, 300) AS excerpt FROM found JOIN files USING (id) WHERE {ACTIVE} AND id NOT IN (SELECT file_id FROM pii WHERE severity = 'high') QUALIFY ref <= 50", "pii"))
def o2_search_report(spark, d):
    """The best fifty results with excerpts, sensitive documents left out."""
    rows = files(spark, d).filter(store.active()).select("id", "filename", F.substring("content_text", 1, 300).alias("excerpt")).join(_ids(corpus.pii(spark, d).filter("severity = 'high'")), "id", "left_anti")
    best = rows.join(_full_text(spark, d), "id").orderBy(F.desc("score"), "id").limit(50)
    return best.select("id", "filename", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("ref"), "excerpt")


def _dossier(spark, d):
    labels = table(spark, d, "labels")
    chosen = files(spark, d).filter(store.active() & (F.col("size_bytes") > 1000)).select("id")
    return lifecycle.membership(chosen, labels.filter("quality = 0").select(F.col("doc_id").alias("id")), labels.filter("toxic = 1").select(F.col("doc_id").alias("id")), "id")


_DOSSIER = f"dossier AS (SELECT id FROM files WHERE {ACTIVE} AND size_bytes > 1000 AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL) UNION SELECT doc_id FROM labels WHERE toxic = 1)"


@query(sql(f"WITH {_DOSSIER} SELECT file_type AS section, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes, min(id) AS first FROM dossier JOIN files USING (id) GROUP BY 1"))
def o3_dossier_report(spark, d):
    """Members of a dossier by section."""
    rows = files(spark, d).join(_dossier(spark, d), "id", "left_semi")
    return rows.groupBy(F.col("file_type").alias("section")).agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("bytes"), F.min("id").alias("first"))


@query(sql(f"SELECT parent_dir AS project, count(*) AS documents, count(DISTINCT file_type) AS types, strftime(max(modified_at), '{STAMP}') AS last FROM files WHERE {ACTIVE} AND parent_dir IS NOT NULL GROUP BY 1"))
def o4_project_report(spark, d):
    rows = files(spark, d).filter(store.active() & F.col("parent_dir").isNotNull()).groupBy(F.col("parent_dir").alias("project"))
    return rows.agg(F.count("*").alias("documents"), F.countDistinct("file_type").alias("types"), stamp(F.max("modified_at")).alias("last"))


@query(sql(f"SELECT substr(date, 1, 7) AS bucket, count(*) AS documents, min(id) AS first FROM ({_EVENTS}) GROUP BY 1", "pii"))
def o5_timeline_report(spark, d):
    return _timeline(spark, d).groupBy(bucket(F.col("modified_at"), "month").alias("bucket")).agg(F.count("*").alias("documents"), F.min("id").alias("first"))


@query(sql(f"WITH {_DUP} SELECT digest, copies, wasted::BIGINT AS wasted, row_number() OVER (ORDER BY wasted DESC, digest) AS place FROM dup QUALIFY place <= 100", "hashes"))
def o6_duplicates_report(spark, d):
    """The hundred groups of copies that waste most."""
    best = _duplicate_groups(spark, d).orderBy(F.desc("wasted"), "digest").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("wasted"), "digest")))


@query(sql(f"WITH {_CATEGORIES} SELECT category, count(*) AS documents, round(avg(score), 4) AS score FROM categories JOIN files USING (id) WHERE {ACTIVE} GROUP BY 1"))
def o7_category_report(spark, d):
    live = files(spark, d).filter(store.active()).select("id")
    return k19_categories(spark, d).join(live, "id", "left_semi").groupBy("category").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 4).alias("score"))


@query(sql(f"SELECT pii_type, severity, count(DISTINCT file_id) AS documents, sum(hits)::BIGINT AS hits FROM pii WHERE file_id IN (SELECT id FROM files WHERE {ACTIVE}) GROUP BY 1, 2", "pii"))
def o8_pii_report(spark, d):
    live = files(spark, d).filter(store.active()).select(F.col("id").alias("file_id"))
    a_doc = corpus.pii(spark, d).join(live, "file_id", "left_semi").groupBy("pii_type", "severity", "file_id").agg(F.sum("hits").alias("hits"))
    return a_doc.groupBy("pii_type", "severity").agg(F.count("*").alias("documents"), F.sum("hits").alias("hits"))


@query(sql(f"SELECT outcome, count(*) AS files, max(attempts) AS most, count(*) FILTER (ignored) AS ignored, strftime(max(last_attempted), '{STAMP}') AS last FROM queue GROUP BY 1", "queue"))
def o9_ingestion_report(spark, d):
    return corpus.queue(spark, d).groupBy("outcome").agg(F.count("*").alias("files"), F.max("attempts").alias("most"), F.count_if("ignored").alias("ignored"), stamp(F.max("last_attempted")).alias("last"))


@query(sql(f"WITH {_FAMILIES} SELECT family, id, CASE WHEN confidence = 'HIGH' THEN rank END AS rank, is_primary AND confidence = 'HIGH' AS is_primary, CASE WHEN confidence <> 'HIGH' THEN 'modification time (probable)' END AS probable_order, CASE WHEN confidence = 'HIGH' THEN 'KNOWN' ELSE 'INFERRED' END AS certainty FROM families"))
def o10_version_reconstruction(spark, d):
    """Families are ordered by explicit markers only; a last version is claimed for those alone."""
    sure = F.col("confidence") == "HIGH"
    return version_table(spark, d).select("family", "id", F.when(sure, F.col("rank")).alias("rank"), (F.col("is_primary") & sure).alias("is_primary"), F.when(~sure, "modification time (probable)").alias("probable_order"), F.when(sure, "KNOWN").otherwise("INFERRED").alias("certainty"))


@query("SELECT conv_id, turn, row_number() OVER w AS place, role, lag(turn) OVER w AS in_reply_to, substr(text, 1, 2000) AS body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY place <= 200")
def o11_thread_reconstruction(spark, d):
    """Messages of every thread in order, two hundred at most, each with the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, 2000).alias("body"))
    return rows.withColumns({"place": F.row_number().over(w), "in_reply_to": F.lag("turn").over(w)}).filter("place <= 200")


@query(sql(f"SELECT archive_parent_id, count(*) AS members, count(*) FILTER ({ACTIVE}) AS active, sum(size_bytes)::BIGINT AS bytes, min(path) AS first FROM files WHERE archive_parent_id IS NOT NULL GROUP BY 1"))
def o12_archive_package(spark, d):
    rows = files(spark, d).filter("archive_parent_id is not null").groupBy("archive_parent_id")
    return rows.agg(F.count("*").alias("members"), F.count_if(store.active()).alias("active"), F.sum("size_bytes").alias("bytes"), F.min("path").alias("first"))


@query(sql(f"WITH {_DUP} SELECT file_id AS id, digest, 'exact' AS relation, copies FROM hashes JOIN dup USING (digest) WHERE state = 'OK'", "hashes"))
def o13_duplicate_pack(spark, d):
    rows = hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest")
    return rows.join(_duplicate_groups(spark, d).select("digest", "copies"), "digest").select("id", "digest", F.lit("exact").alias("relation"), "copies")


@query(sql(f"SELECT id, date, source FROM ({_EVENTS}) ORDER BY date, id LIMIT 500", "pii"))
def o14_timeline_pack(spark, d):
    rows = _timeline(spark, d).select("id", F.date_format("modified_at", "yyyy-MM-dd").alias("date"), F.lit("modified_at").alias("source"))
    return rows.orderBy("date", "id").limit(500)


@query(sql("SELECT doc_id AS id, CASE WHEN f.id IS NULL THEN 'UNAVAILABLE' ELSE 'KNOWN' END AS provenance, coalesce(filename, 'document ' || doc_id) AS label, extension FROM (SELECT DISTINCT doc_id + (doc_id % 50 = 0)::BIGINT * 10000000 AS doc_id FROM labels) LEFT JOIN files f ON f.id = doc_id"))
def o15_registered_sources(spark, d):
    """Sources of a report with what is known of them; those whose file is gone are marked unavailable."""
    wanted = table(spark, d, "labels").select((F.col("doc_id") + (F.col("doc_id") % 50 == 0).cast("long") * 10000000).alias("id")).distinct()
    rows = wanted.join(files(spark, d).select("id", "filename", "extension"), "id", "left")
    return rows.select("id", F.when(F.col("filename").isNull(), "UNAVAILABLE").otherwise("KNOWN").alias("provenance"), F.coalesce("filename", F.concat(F.lit("document "), F.col("id").cast("string"))).alias("label"), "extension")


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1) SELECT user_id AS source, row_number() OVER (ORDER BY first) AS number, user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS dangling FROM f")
def o16_citation_numbers(spark, d):
    """Sources numbered in the order of their first citation; dangling ones are not registered. Sources are a bounded list here."""
    first = table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.min("event_id").alias("first"))
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source"), F.lit(True).alias("known"))
    rows = first.join(known, "source", "left").withColumn("number", F.row_number().over(Window.orderBy("first")))
    return rows.select("source", "number", F.col("known").isNull().alias("dangling"))


@query(sql(f"WITH {_DOSSIER} SELECT id FROM dossier"))
def o17_dynamic_dossier(spark, d):
    return _dossier(spark, d)


@query(sql(f"WITH {_DOSSIER} SELECT count(*) AS members, bit_xor(('0x' || substr(md5(id::VARCHAR), 1, 15))::BIGINT) AS fingerprint FROM dossier"))
def o18_frozen_dossier(spark, d):
    """A frozen membership: its size and a fingerprint that does not depend on order, so tasks can add to it."""
    part = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
    return _dossier(spark, d).agg(F.count("*").alias("members"), F.bit_xor(part).alias("fingerprint"))


@query(sql("SELECT file_type AS report, sha256(to_json(struct_pack(kind := file_type, documents := count(*), bytes := sum(size_bytes)::BIGINT))::VARCHAR) AS fingerprint FROM files GROUP BY file_type"))
def o19_report_fingerprint(spark, d):
    """SHA-256 of a report's canonical JSON."""
    rows = files(spark, d).groupBy("file_type").agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("bytes"))
    return rows.select(F.col("file_type").alias("report"), F.sha2(F.to_json(F.struct(F.col("file_type").alias("kind"), "documents", "bytes")), 256).alias("fingerprint"))


@query(sql("SELECT file_type AS section, count(*) AS sources, count(content_text) AS with_text FROM files GROUP BY 1"))
def f38_report_counts(spark, d):
    return files(spark, d).groupBy(F.col("file_type").alias("section")).agg(F.count("*").alias("sources"), F.count("content_text").alias("with_text"))


# --- state ----------------------------------------------------------------------------------------------

_LIVE = f"{ACTIVE} AND coalesce(length(content_text) > 0, false)"
_HAVE = "have AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN 'old' ELSE '' END AS salt FROM embeddings)"


def _state(spark, d):
    """(id, live, version, embedded): the version of the content now and the one that was embedded."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 3, "old").otherwise("").alias("salt"))
    rows = files(spark, d).select("id", (store.active() & F.coalesce(F.length("content_text") > 0, F.lit(False))).alias("live"), F.md5(F.coalesce("content_text", F.lit(""))).alias("version"))
    return rows.join(have, "id", "left").withColumn("embedded", F.when(F.col("salt").isNotNull(), F.concat("salt", "version"))).drop("salt")


_STATE = f"{_HAVE}, st AS (SELECT f.id, {_LIVE} AS live, md5(coalesce(content_text, '')) AS version, h.salt || md5(coalesce(content_text, '')) AS embedded FROM files f LEFT JOIN have h ON h.id = f.id)"


@query(sql(f"WITH {_STATE} SELECT id FROM st WHERE live AND embedded IS DISTINCT FROM version"))
def p1_dirty(spark, d):
    """Documents whose content is not the one that was embedded."""
    return _state(spark, d).filter(F.col("live") & ~F.col("version").eqNullSafe(F.col("embedded"))).select("id")


@query(sql(f"WITH {_STATE} SELECT id FROM st WHERE live AND embedded IS DISTINCT FROM version ORDER BY id LIMIT 256"))
def p2_dirty_batch(spark, d):
    return p1_dirty(spark, d).orderBy("id").limit(256)


@query(sql(f"WITH {_STATE} SELECT id FROM st WHERE NOT live AND embedded IS NOT NULL ORDER BY id LIMIT 256"))
def p3_prune_batch(spark, d):
    return _state(spark, d).filter("not live and embedded is not null").select("id").orderBy("id").limit(256)


@query(sql(f"WITH {_STATE}, b AS (SELECT id FROM st WHERE live AND embedded IS DISTINCT FROM version ORDER BY id LIMIT 256) SELECT st.id, CASE WHEN b.id IS NOT NULL THEN version ELSE embedded END AS embedded FROM st LEFT JOIN b ON b.id = st.id"))
def p4_mark_embedded(spark, d):
    """The state after a batch was embedded."""
    rows = _flag(_state(spark, d), p2_dirty_batch(spark, d), "done")
    return rows.select("id", F.when(F.col("done"), F.col("version")).otherwise(F.col("embedded")).alias("embedded"))


@query(sql(f"SELECT id, {_LIVE} AS dirty, NULL::VARCHAR AS embedded FROM files"))
def p5_reset(spark, d):
    """Everything that has text is to be embedded anew."""
    return files(spark, d).select("id", (store.active() & F.coalesce(F.length("content_text") > 0, F.lit(False))).alias("dirty"), F.lit(None).cast("string").alias("embedded"))


@query(sql(f"WITH {_STATE} SELECT id, live AND embedded IS DISTINCT FROM version AS dirty, NOT live AND embedded IS NOT NULL AS prune FROM st"))
def p6_reconciled_state(spark, d):
    return _state(spark, d).select("id", (F.col("live") & ~F.col("version").eqNullSafe(F.col("embedded"))).alias("dirty"), (~F.col("live") & F.col("embedded").isNotNull()).alias("prune"))


@query(sql(f"WITH {_STATE} SELECT id, version AS embedded FROM st WHERE live"))
def p7_refreshed(spark, d):
    """The store after a whole refresh: what is gone is pruned, what is dirty is embedded; a second refresh changes nothing."""
    state = _state(spark, d).filter("live or embedded is not null")
    kept = state.filter("live")
    return kept.select("id", F.when(F.col("version").eqNullSafe(F.col("embedded")), F.col("embedded")).otherwise(F.col("version")).alias("embedded"))


_RETRY = "outcome IN (" + ", ".join(f"'{o}'" for o in scores.RETRYABLE) + ") AND attempts < 3"


@query(sql(f"SELECT file_id, outcome, attempts, NOT ({_RETRY}) AS terminal, CASE WHEN {_RETRY} THEN strftime(last_attempted + least(3600, 60 * pow(5, attempts - 1))::INTEGER * INTERVAL 1 SECOND, '{STAMP}') END AS retry_after FROM queue", "queue"))
def p9_queue_records(spark, d):
    """Outcome, attempts, whether the end is reached, and when to try again."""
    again = scores.retryable(F.col("outcome"), F.col("attempts"))
    due = F.timestamp_add("SECOND", scores.backoff_seconds(F.col("attempts")), "last_attempted")
    return corpus.queue(spark, d).select("file_id", "outcome", "attempts", (~again).alias("terminal"), F.when(again, stamp(due)).alias("retry_after"))


_HINTED = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(e, '{h}')''' for h in hints)} THEN '{o}'" for o, hints in scores.ERROR_HINTS.items()) + " ELSE 'PERMANENT_ERROR' END"
_ERRORS = ("Connection timed out", "File is encrypted", "password needed", "corrupt xref", "library not installed", "no suitable extractor", "too large", "empty page", "odd", "")
_ERROR_SQL = "[" + ", ".join(f"'{e}'" for e in _ERRORS) + "]"


@query(sql(f"SELECT id, CASE WHEN length(content_text) >= 200 THEN 'EXTRACTED' WHEN length(content_text) > 0 THEN 'PARTIAL' ELSE {_HINTED} END AS outcome FROM (SELECT *, lower({_ERROR_SQL}[(id % 10 + 1)::INTEGER]) AS e FROM files)"))
def p10_extraction_outcome(spark, d):
    """Text, little text, or the outcome that the error tells."""
    error = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("id") % 10 + 1).cast("int"))
    n = F.length("content_text")
    return files(spark, d).select("id", F.when(n >= 200, "EXTRACTED").when(n > 0, "PARTIAL").otherwise(scores.error_outcome(error)).alias("outcome"))


@query(sql(f"SELECT extension, count(*) AS eligible FROM files WHERE {ACTIVE} AND size_bytes BETWEEN 1 AND 52428800 AND extension IN ('.pdf', '.docx', '.txt', '.md', '.html', '.eml') AND id NOT IN (SELECT file_id FROM queue WHERE NOT ({_RETRY})) GROUP BY 1", "queue"))
def p11_extraction_run(spark, d):
    """What a run would extract, by extension."""
    return a51_eligible(spark, d).groupBy("extension").agg(F.count("*").alias("eligible"))


@query(sql(f"SELECT file_id FROM queue WHERE {_RETRY} AND NOT ignored AND last_attempted + least(3600, 60 * pow(5, attempts - 1))::INTEGER * INTERVAL 1 SECOND <= TIMESTAMP '2024-01-15' AND file_id IN (SELECT id FROM files WHERE {ACTIVE})", "queue"))
def p12_retry_run(spark, d):
    due = F.timestamp_add("SECOND", scores.backoff_seconds(F.col("attempts")), "last_attempted") <= F.lit("2024-01-15").cast("timestamp")
    rows = corpus.queue(spark, d).filter(scores.retryable(F.col("outcome"), F.col("attempts")) & ~F.col("ignored") & due)
    return rows.join(files(spark, d).filter(store.active()).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id")


_RUNS = "runs AS (SELECT user_id AS run_id, '/corpus/src' || (user_id % 12) || CASE WHEN user_id % 5 = 0 THEN '/sub' ELSE '' END AS root, CASE WHEN user_id % 4 = 0 THEN 'RUNNING' WHEN user_id % 7 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, min(ts) AS started, max(ts) AS finished, count(*) AS files, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"


def runs(spark, d):
    """Scan runs: the events of a user, with a root and a status."""
    u = F.col("user_id")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"), F.count("*").alias("files"), F.count_if(F.col("event_type") == "error").alias("errors"))
    root = F.concat(F.lit("/corpus/src"), (u % 12).cast("string"), F.when(u % 5 == 0, "/sub").otherwise(""))
    return rows.select(u.alias("run_id"), root.alias("root"), F.when(u % 4 == 0, "RUNNING").when(u % 7 == 0, "FAILED").otherwise("COMPLETED").alias("status"), "started", "finished", "files", "errors")


@query(f"WITH {_RUNS}, r AS (SELECT DISTINCT root FROM runs WHERE status = 'RUNNING') SELECT a.root, bool_or(a.root = b.root OR starts_with(a.root, b.root || '/') OR starts_with(b.root, a.root || '/')) AS refused FROM (SELECT DISTINCT root FROM runs) a, r b GROUP BY 1")
def p13_overlapping_roots(spark, d):
    """A scan is refused if its root holds, or lies in, the root of a running one. A root meets another by its path's parts, so no
    pair of unrelated roots is formed."""
    every = runs(spark, d).select("root").distinct()
    running = runs(spark, d).filter("status = 'RUNNING'").select("root").distinct()
    ups = lambda df, name: df.select(F.col("root").alias(name), F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("root", "/"))), lambda i: F.array_join(F.slice(F.split("root", "/"), F.lit(1), i), "/"))).alias("up"))
    below = ups(every, "a").join(running.withColumnRenamed("root", "up"), "up").select(F.col("a").alias("root"))
    above = ups(running, "b").join(every.withColumnRenamed("root", "up"), "up").select(F.col("up").alias("root"))
    hit = below.unionByName(above).distinct().withColumn("refused", F.lit(True))
    return every.join(hit, "root", "left").select("root", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(sql(f"WITH {_RUNS} SELECT f.id, r.run_id FROM files f JOIN runs r ON r.run_id = f.scan_id"))
def p14_recorded_files(spark, d):
    return files(spark, d).select("id", F.col("scan_id").alias("run_id")).join(runs(spark, d).select("run_id"), "run_id", "left_semi").select("id", "run_id")


@query(f"WITH {_RUNS} SELECT run_id, root || '/' || event_id AS scope, 'unreadable' AS kind FROM events JOIN runs ON runs.run_id = user_id WHERE event_type = 'error'")
def p15_unreadable_scopes(spark, d):
    errors = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("run_id"), "event_id")
    return errors.join(runs(spark, d).select("run_id", "root"), "run_id").select("run_id", F.concat("root", F.lit("/"), F.col("event_id").cast("string")).alias("scope"), F.lit("unreadable").alias("kind"))


@query(f"WITH {_RUNS} SELECT run_id, CASE WHEN status = 'RUNNING' AND finished < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'FAILED' ELSE status END AS status FROM runs")
def p16_recovered_runs(spark, d):
    """Runs that are marked running but have been silent for six hours have failed."""
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))  # one row
    stale = (F.col("status") == "RUNNING") & (F.col("finished") < F.col("last") - F.expr("INTERVAL 6 HOURS"))
    return runs(spark, d).crossJoin(F.broadcast(last)).select("run_id", F.when(stale, "FAILED").otherwise(F.col("status")).alias("status"))


@query(sql(f"WITH {_RUNS} SELECT run_id, status, files, errors, status = 'COMPLETED' AND errors = 0 AS reconciles FROM runs"))
def p17_scan_outcomes(spark, d):
    """Only a complete run without errors may mark files as missing."""
    return runs(spark, d).select("run_id", "status", "files", "errors", ((F.col("status") == "COMPLETED") & (F.col("errors") == 0)).alias("reconciles"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def p18_retention(spark, d):
    """What is older than 24 hours before the newest goes."""
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))
    return table(spark, d, "events").crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 24 HOURS")).select("event_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1")
def p19_history(spark, d):
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))
    rows = table(spark, d, "events").crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 6 HOURS"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(sql(f"WITH {_RUNS}, ok AS (SELECT run_id FROM runs WHERE status = 'COMPLETED' AND errors = 0) SELECT f.id, CASE WHEN f.scan_id IN (SELECT run_id FROM ok) AND f.id % 3 = 0 THEN 'MISSING' ELSE coalesce(f.state, 'ACTIVE') END AS state FROM files f"))
def i6_complete_scan(spark, d):
    """Unseen files (a third here) go missing only under runs that may reconcile; under all others states stay."""
    fine = p17_scan_outcomes(spark, d).filter("reconciles").select(F.col("run_id").alias("scan_id"), F.lit(True).alias("ok"))
    rows = files(spark, d).select("id", "scan_id", F.coalesce("state", F.lit("ACTIVE")).alias("state")).join(fine, "scan_id", "left")
    return rows.select("id", F.when(F.coalesce("ok", F.lit(False)) & (F.col("id") % 3 == 0), "MISSING").otherwise(F.col("state")).alias("state"))


# --- sources and archives' rows -------------------------------------------------------------------------


@query(sql("SELECT id, path FROM files WHERE starts_with(path, '/corpus/src1/') OR starts_with(path, '/archives/')"))
def a2_several_roots(spark, d):
    return files(spark, d).filter(names.in_subtree(F.col("path"), "/corpus/src1") | names.in_subtree(F.col("path"), "/archives")).select("id", "path")


@query(sql("SELECT id, regexp_matches(lower(string_split(parent_dir, '/')[-1]), '^src1.$') OR parent_dir = '/archives' OR starts_with(parent_dir, '/archives/') AS excluded FROM files WHERE parent_dir IS NOT NULL"))
def a3_user_exclusions(spark, d):
    """A pattern without a separator holds for a folder's own name, one with a separator for a subtree."""
    return files(spark, d).filter("parent_dir is not null").select("id", names.excluded_by_user(F.col("parent_dir"), ["SRC1?", "/archives"]).alias("excluded"))


_ODD = "CASE id % 5 WHEN 0 THEN '/home/Node_Modules/x' WHEN 1 THEN '/c/AppData/Local/Temp/y' WHEN 2 THEN '/work/.git' ELSE coalesce(parent_dir, '/') END"


def _odd_folder():
    i = F.col("id")
    return F.when(i % 5 == 0, "/home/Node_Modules/x").when(i % 5 == 1, "/c/AppData/Local/Temp/y").when(i % 5 == 2, "/work/.git").otherwise(F.coalesce("parent_dir", F.lit("/")))


@query(sql(f"SELECT id, len(list_intersect(string_split(lower(p), '/'), [{', '.join(repr(x) for x in names.SKIPPED_FOLDERS)}])) > 0 OR contains(lower(p), '/appdata/local/temp') AS skipped FROM (SELECT id, {_ODD} AS p FROM files)"))
def a4_skipped_folders(spark, d):
    return files(spark, d).select("id", names.skipped_folder(_odd_folder()).alias("skipped"))


@query(sql(f"SELECT id, extension IN ({', '.join(repr(x) for x in names.SKIPPED_EXTENSIONS)}) OR id % 10 = 4 AS skipped FROM files"))
def a5_skipped_files(spark, d):
    """By extension, and hidden ones (every tenth is, here)."""
    name = F.when(F.col("id") % 10 == 4, F.concat(F.lit("."), "filename")).otherwise(F.col("filename"))
    return files(spark, d).select("id", names.skipped_file(name).alias("skipped"))


@query(sql(f"SELECT id, filename, size_bytes, file_type FROM files WHERE NOT (extension IN ({', '.join(repr(x) for x in names.SKIPPED_EXTENSIONS)})) AND document_kind = 'PHYSICAL_FILE'"))
def a6_indexed_files(spark, d):
    """What a scan puts into the index: files that no rule leaves out."""
    rows = files(spark, d).filter(~names.skipped_file(F.col("filename")) & ~names.skipped_folder(F.coalesce("parent_dir", F.lit("/"))) & (F.col("document_kind") == "PHYSICAL_FILE"))
    return rows.select("id", "filename", "size_bytes", "file_type")


@query(sql("SELECT id, CASE WHEN size_bytes <= 20000 THEN md5(content_text) END AS checksum, extension IN ('.jpg', '.png', '.pdf') AND coalesce(length(content_text), 0) = 0 AS ocr FROM files"))
def a7_checksums(spark, d):
    """Checksums of files that are not too large, and which files hold no text but could be read from their image."""
    return files(spark, d).select("id", F.when(F.col("size_bytes") <= 20000, F.md5("content_text")).alias("checksum"), (F.col("extension").isin(".jpg", ".png", ".pdf") & (F.coalesce(F.length("content_text"), F.lit(0)) == 0)).alias("ocr"))


@query(sql("SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT parent_dir) AS folders, false AS lower_bound FROM files"))
def a8_estimate(spark, d):
    """Before a scan: files, bytes, folders. A count over the listing is exact, so it is no lower bound."""
    return files(spark, d).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.countDistinct("parent_dir").alias("folders")).withColumn("lower_bound", F.lit(False))


# Extractors by extension, in the order in which they are asked.
EXTRACTORS = {"pdf": (".pdf",), "office": (".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt"), "legacy": (".rtf", ".wpd"), "email": (".eml", ".mht", ".msg"), "text": (".txt", ".md", ".csv", ".py", ".html", ".json", ".log")}


@query(sql(f"SELECT id, {names.by_extension_sql('extension', EXTRACTORS, 'NULL')} AS extractor FROM files"))
def a33_extractor(spark, d):
    return files(spark, d).select("id", names.by_extension(F.col("extension"), EXTRACTORS, None).alias("extractor"))


_ORDER = "CASE WHEN extension = '.pdf' THEN 0 WHEN extension IN ('.docx', '.xlsx', '.pptx') THEN 1 WHEN extension IN ('.doc', '.xls', '.ppt', '.rtf') THEN 2 WHEN extension IN ('.txt', '.md', '.csv') THEN 3 ELSE 4 END"


def _extraction_order():
    e = F.col("extension")
    return F.when(e == ".pdf", 0).when(e.isin(".docx", ".xlsx", ".pptx"), 1).when(e.isin(".doc", ".xls", ".ppt", ".rtf"), 2).when(e.isin(".txt", ".md", ".csv"), 3).otherwise(4)


@query(sql(f"SELECT id FROM files ORDER BY {_ORDER}, size_bytes, id LIMIT 100"))
def a36_priority_batch(spark, d):
    return files(spark, d).orderBy(_extraction_order(), "size_bytes", "id").limit(100).select("id")


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND coalesce(length(content_text), 0) < 500 AND id NOT IN (SELECT file_id FROM queue) ORDER BY CASE WHEN file_type = 'document' THEN 0 WHEN extension IN ('.txt', '.md') THEN 1 ELSE 2 END, size_bytes, id LIMIT 200", "queue"))
def a37_candidates(spark, d):
    """Files without (here: with little) text that were not tried yet, documents first, small ones first."""
    rows = files(spark, d).filter(store.active() & (F.coalesce(F.length("content_text"), F.lit(0)) < 500)).join(_ids(corpus.queue(spark, d)), "id", "left_anti")
    return rows.orderBy(F.when(F.col("file_type") == "document", 0).when(F.col("extension").isin(".txt", ".md"), 1).otherwise(2), "size_bytes", "id").limit(200).select("id")


_MEMBER = "CASE id % 8 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:\\x' WHEN 3 THEN './a//b/./c.txt' WHEN 4 THEN 'd\\e.txt' WHEN 5 THEN ' ' ELSE 'f/' || filename END"


def _member_name():
    i = F.col("id") % 8
    return F.when(i == 0, "/etc/x").when(i == 1, "a/../b").when(i == 2, "C:\\x").when(i == 3, "./a//b/./c.txt").when(i == 4, "d\\e.txt").when(i == 5, " ").otherwise(F.concat(F.lit("f/"), "filename"))


@query(sql(f"SELECT id, CASE id % 8 WHEN 3 THEN 'a/b/c.txt' WHEN 4 THEN 'd/e.txt' WHEN 6 THEN 'f/' || filename WHEN 7 THEN 'f/' || filename END AS safe FROM files"))
def a46_safe_members(spark, d):
    return files(spark, d).select("id", names.safe_member(_member_name()).alias("safe"))


@query(sql("SELECT id, '/archives/a' || archive_parent_id || '.zip' || '!/' || filename AS virtual FROM files WHERE archive_parent_id IS NOT NULL"))
def a47_virtual_paths(spark, d):
    rows = files(spark, d).filter("archive_parent_id is not null")
    return rows.select("id", names.virtual_path(F.concat(F.lit("/archives/a"), F.col("archive_parent_id").cast("string"), F.lit(".zip")), F.col("filename")).alias("virtual"))


@query(sql("SELECT id, size_bytes || ':' || epoch(modified_at)::BIGINT || ':' || sha1(coalesce(content_text, '')) AS fingerprint FROM files WHERE extension = '.zip' AND modified_at IS NOT NULL"))
def a48_archive_fingerprints(spark, d):
    rows = files(spark, d).filter("extension = '.zip' and modified_at is not null")
    return rows.select("id", F.concat_ws(":", F.col("size_bytes").cast("string"), F.unix_seconds("modified_at").cast("string"), F.sha1(F.coalesce("content_text", F.lit("")))).alias("fingerprint"))


@query(sql(f"SELECT a.id, count(m.id) AS members FROM files a LEFT JOIN files m ON m.archive_parent_id = a.id WHERE a.extension = '.zip' AND coalesce(a.state, 'ACTIVE') = 'ACTIVE' AND a.id NOT IN (SELECT file_id FROM hashes WHERE state = 'OK') GROUP BY 1", "hashes"))
def a50_index_archives(spark, d):
    """Archives that are to be listed (no fingerprint is known), with the members that are known of them."""
    rows = files(spark, d)
    due = rows.filter((F.col("extension") == ".zip") & store.active()).select("id").join(_ids(hashes(spark, d).filter("state = 'OK'")), "id", "left_anti")
    members = rows.filter("archive_parent_id is not null").groupBy(F.col("archive_parent_id").alias("id")).agg(F.count("*").alias("members"))
    return due.join(members, "id", "left").select("id", F.coalesce("members", F.lit(0)).alias("members"))


@query(sql(f"SELECT id, extension FROM files WHERE {ACTIVE} AND size_bytes BETWEEN 1 AND 52428800 AND extension IN ('.pdf', '.docx', '.txt', '.md', '.html', '.eml') AND id NOT IN (SELECT file_id FROM queue WHERE NOT ({_RETRY}))", "queue"))
def a51_eligible(spark, d):
    """Files to extract: active, of a size and extension, and without a terminal outcome."""
    rows = files(spark, d).filter(store.active() & F.col("size_bytes").between(1, 50 << 20) & F.col("extension").isin(".pdf", ".docx", ".txt", ".md", ".html", ".eml"))
    ended = corpus.queue(spark, d).filter(~scores.retryable(F.col("outcome"), F.col("attempts")))
    return rows.select("id", "extension").join(_ids(ended), "id", "left_anti")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{k}')" for k, es in EXTRACTORS.items() for e in es) + ") t(extension, extractor)")
def a52_capabilities(spark, d):
    return spark.createDataFrame([(e, k) for k, es in EXTRACTORS.items() for e in es], "extension string, extractor string")


@query(sql("WITH i AS (SELECT id, filename FROM files WHERE id % 2 = 0 UNION ALL SELECT id, 'imported ' || filename FROM files WHERE id % 3 = 0) SELECT id, min(filename) FILTER (NOT starts_with(filename, 'imported')) IS NULL AS imported FROM i GROUP BY id"))
def a60_import(spark, d):
    """Rows of an export are added; those that exist stay as they are."""
    have = files(spark, d).filter("id % 2 = 0").select("id", F.lit(False).alias("imported"))
    new = files(spark, d).filter("id % 3 = 0").select("id", F.lit(True).alias("imported")).join(have, "id", "left_anti")
    return have.unionByName(new)


# --- containers, runs, tags and other rows --------------------------------------------------------------


@query(sql("SELECT archive_parent_id, coalesce(state, 'ACTIVE') AS member_state, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files WHERE archive_parent_id IS NOT NULL GROUP BY 1, 2"))
def v1_container_summary(spark, d):
    rows = files(spark, d).filter("archive_parent_id is not null").groupBy("archive_parent_id", F.coalesce("state", F.lit("ACTIVE")).alias("member_state"))
    return rows.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(sql(f"SELECT id, path FROM files WHERE archive_parent_id IS NOT NULL AND {ACTIVE} ORDER BY path, id LIMIT 10 OFFSET 5"))
def v2_member_page(spark, d):
    return files(spark, d).filter(store.active() & F.col("archive_parent_id").isNotNull()).select("id", "path").orderBy("path", "id").offset(5).limit(10)


@query(sql("SELECT id, filename, size_bytes, substr(content_text, 1, 500) AS preview FROM files WHERE archive_parent_id IS NOT NULL"))
def v3_member_detail(spark, d):
    return files(spark, d).filter("archive_parent_id is not null").select("id", "filename", "size_bytes", F.substring("content_text", 1, 500).alias("preview"))


@query(sql("SELECT archive_parent_id, bool_and(starts_with(path, '/archives/a' || archive_parent_id || '.zip!/')) AS matches FROM files WHERE archive_parent_id IS NOT NULL GROUP BY 1"))
def v4_members_match_parent(spark, d):
    rows = files(spark, d).filter("archive_parent_id is not null")
    prefix = F.concat(F.lit("/archives/a"), F.col("archive_parent_id").cast("string"), F.lit(".zip!/"))
    return rows.groupBy("archive_parent_id").agg(F.bool_and(F.startswith("path", prefix)).alias("matches"))


@query(sql(f"SELECT archive_parent_id, id, row_number() OVER (PARTITION BY archive_parent_id ORDER BY path, id) AS place FROM files WHERE archive_parent_id IS NOT NULL AND {ACTIVE} QUALIFY place <= 10000"))
def v5_members_by_path(spark, d):
    rows = files(spark, d).filter(store.active() & F.col("archive_parent_id").isNotNull()).select("archive_parent_id", "id", "path")
    return relational.top_per_group(rows, "archive_parent_id", [F.col("path"), F.col("id")], 10000).drop("path")


@query(sql("SELECT a.id, count(m.id) AS member_count, coalesce(sum(m.size_bytes), 0)::BIGINT AS expanded_size, CASE WHEN count(m.id) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM files a LEFT JOIN files m ON m.archive_parent_id = a.id WHERE a.extension = '.zip' GROUP BY 1"))
def v6_index_state(spark, d):
    """The result of inspecting each container (v7 reads the same rows)."""
    rows = files(spark, d)
    sums = rows.filter("archive_parent_id is not null").groupBy(F.col("archive_parent_id").alias("id")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("s"))
    both = rows.filter("extension = '.zip'").select("id").join(sums, "id", "left")
    return both.select("id", F.coalesce("n", F.lit(0)).alias("member_count"), F.coalesce("s", F.lit(0)).alias("expanded_size"), F.when(F.col("n").isNull(), "EMPTY").otherwise("OK").alias("status"))


@query(sql("SELECT m.id, CASE WHEN p.state = 'MISSING' THEN 'MISSING' ELSE coalesce(m.state, 'ACTIVE') END AS state FROM files m LEFT JOIN files p ON p.id = m.archive_parent_id WHERE m.archive_parent_id IS NOT NULL"))
def v8_members_missing(spark, d):
    """Members of a container that is gone are missing too."""
    rows = files(spark, d)
    gone = rows.filter("state = 'MISSING'").select(F.col("id").alias("archive_parent_id"), F.lit(True).alias("gone"))
    members = rows.filter("archive_parent_id is not null").join(gone, "archive_parent_id", "left")
    return members.select("id", F.when(F.col("gone"), "MISSING").otherwise(F.coalesce("state", F.lit("ACTIVE"))).alias("state"))


@query(sql(f"SELECT m.id, CASE WHEN coalesce(p.state, 'ACTIVE') = 'ACTIVE' AND p.id IS NOT NULL THEN 'ACTIVE' ELSE coalesce(m.state, 'ACTIVE') END AS state FROM files m LEFT JOIN files p ON p.id = m.archive_parent_id WHERE m.archive_parent_id IS NOT NULL"))
def v9_members_active(spark, d):
    rows = files(spark, d)
    back = rows.filter(store.active()).select(F.col("id").alias("archive_parent_id"), F.lit(True).alias("back"))
    members = rows.filter("archive_parent_id is not null").join(back, "archive_parent_id", "left")
    return members.select("id", F.when(F.col("back"), "ACTIVE").otherwise(F.coalesce("state", F.lit("ACTIVE"))).alias("state"))


@query(sql("SELECT id, CASE WHEN length(content_text) > 0 THEN 'EXTRACTED' ELSE 'ATTEMPTED' END AS outcome FROM files"))
def v10_member_outcomes(spark, d):
    """Extracted, or (v11) tried without text."""
    return files(spark, d).select("id", F.when(F.length("content_text") > 0, "EXTRACTED").otherwise("ATTEMPTED").alias("outcome"))


@query(sql(f"SELECT id, length(content_text) AS n FROM files WHERE {ACTIVE} AND length(content_text) > 50 AND id IN (SELECT doc_id FROM labels)"))
def v12_documents_by_ids(spark, d):
    rows = files(spark, d).filter(store.active() & (F.length("content_text") > 50)).select("id", F.length("content_text").alias("n"))
    return rows.join(_ids(table(spark, d, "labels"), "doc_id"), "id", "left_semi")


@query(sql("SELECT volume_id, count(*) AS files, max(inode) AS last FROM files GROUP BY 1"))
def v13_volumes(spark, d):
    return files(spark, d).groupBy("volume_id").agg(F.count("*").alias("files"), F.max("inode").alias("last"))


@query(f"WITH {_RUNS} SELECT run_id, CASE WHEN status = 'RUNNING' THEN 'COMPLETED' ELSE status END AS status, strftime(finished, '{STAMP}') AS finished FROM runs")
def v14_finished_runs(spark, d):
    return runs(spark, d).select("run_id", F.when(F.col("status") == "RUNNING", "COMPLETED").otherwise(F.col("status")).alias("status"), stamp("finished").alias("finished"))


@query(f"WITH {_RUNS} SELECT root, list_sort(list(run_id)) AS runs FROM runs GROUP BY 1")
def v15_scopes(spark, d):
    return runs(spark, d).groupBy("root").agg(F.sort_array(F.collect_list("run_id")).alias("runs"))  # runs, not files


@query(f"WITH {_RUNS} SELECT run_id, CASE WHEN status = 'RUNNING' AND run_id % 8 = 0 THEN 'CANCELLED' WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status, errors FROM runs")
def v16_ended_runs(spark, d):
    """Running ones are cancelled or fail (v16 to v18), with their number of errors."""
    running = F.col("status") == "RUNNING"
    return runs(spark, d).select("run_id", F.when(running & (F.col("run_id") % 8 == 0), "CANCELLED").when(running, "FAILED").otherwise(F.col("status")).alias("status"), "errors")


@query(sql("SELECT max(id) + count(*) FILTER (id % 9 = 2) AS generation, count(*) FILTER (id % 9 = 2) > 0 AS sweep_due FROM files"))
def v19_generation(spark, d):
    """The generation grows with every change (v19, v20); a sweep is due when there was one (v21)."""
    changes = F.count_if(F.col("id") % 9 == 2)
    return files(spark, d).agg((F.max("id") + changes).alias("generation"), (changes > 0).alias("sweep_due"))


@query(sql(f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM files WHERE {ACTIVE})"))
def v22_prune_marks(spark, d):
    live = files(spark, d).filter(store.active()).select(F.col("id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(live, "vec_id", "left_anti")


@query(sql("SELECT id, digest, h.state FROM files LEFT JOIN hashes h ON h.file_id = id", "hashes"))
def v26_hash_of(spark, d):
    return files(spark, d).select("id").join(hashes(spark, d).select(F.col("file_id").alias("id"), "digest", "state"), "id", "left")


@query(sql(f"WITH {_FAMILIES} SELECT count(DISTINCT family) AS families, count(*) AS members, count(*) FILTER (is_primary) AS primaries FROM families"))
def v28_family_counts(spark, d):
    return version_table(spark, d).agg(F.countDistinct("family").alias("families"), F.count("*").alias("members"), F.count_if("is_primary").alias("primaries"))


@query(sql(f"SELECT id, filename, parent_dir FROM files WHERE {ACTIVE} AND document_kind = 'PHYSICAL_FILE' AND starts_with(path, '/corpus/')"))
def v29_family_candidates(spark, d):
    return files(spark, d).filter(store.active() & (F.col("document_kind") == "PHYSICAL_FILE") & F.col("path").startswith("/corpus/")).select("id", "filename", "parent_dir")


@query(sql(f"WITH {_FAMILIES} SELECT f.id, family FROM files f LEFT JOIN families USING (id)"))
def v30_family_of(spark, d):
    return files(spark, d).select("id").join(version_table(spark, d).select("id", "family"), "id", "left")


@query(sql("SELECT l.doc_id AS id, count(*) AS dossiers, bool_or(toxic = 1) AS pinned FROM labels l WHERE quality IS DISTINCT FROM -1 GROUP BY 1"))
def v32_dossiers_of(spark, d):
    return table(spark, d, "labels").filter(~F.col("quality").eqNullSafe(-1)).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("dossiers"), F.bool_or(F.col("toxic") == 1).alias("pinned"))


@query(sql("SELECT file_id AS id, pii_type, fingerprint, hits, severity, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, hits DESC, pii_type, fingerprint) AS place FROM pii QUALIFY place <= 30", "pii"))
def v34_findings_of(spark, d):
    """At most thirty findings of each document, the most severe first (v34, v57 and v59)."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = corpus.pii(spark, d).select(F.col("file_id").alias("id"), "pii_type", "fingerprint", "hits", "severity")
    return relational.top_per_group(rows, "id", [rank, F.desc("hits"), F.col("pii_type"), F.col("fingerprint")], 30)


@query(sql("SELECT f.id, f.lang, e.label FROM files f LEFT JOIN embeddings e ON e.vec_id = f.id"))
def v47_language_of(spark, d):
    return files(spark, d).select("id", "lang").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", "left")


@query(sql("SELECT id, filename, extension, coalesce(state, 'ACTIVE') AS state, document_kind FROM files"))
def v48_document_headers(spark, d):
    return files(spark, d).select("id", "filename", "extension", F.coalesce("state", F.lit("ACTIVE")).alias("state"), "document_kind")


@query(sql(f"SELECT file_id, outcome, filename FROM queue JOIN files ON files.id = file_id WHERE NOT ignored ORDER BY last_attempted DESC, file_id LIMIT 500", "queue"))
def v49_issues(spark, d):
    rows = corpus.queue(spark, d).filter("not ignored").join(files(spark, d).select(F.col("id").alias("file_id"), "filename"), "file_id")
    return rows.orderBy(F.desc("last_attempted"), "file_id").limit(500).select("file_id", "outcome", "filename")


@query(sql("SELECT file_id FROM queue WHERE file_id NOT IN (SELECT id FROM files WHERE length(content_text) > 500)", "queue"))
def v50_cleared_queue(spark, d):
    done = files(spark, d).filter(F.length("content_text") > 500).select(F.col("id").alias("file_id"))
    return corpus.queue(spark, d).select("file_id").join(done, "file_id", "left_anti")


@query(sql("SELECT file_id, ignored OR outcome = 'ENCRYPTED' AS ignored FROM queue", "queue"))
def v51_ignored(spark, d):
    return corpus.queue(spark, d).select("file_id", (F.col("ignored") | (F.col("outcome") == "ENCRYPTED")).alias("ignored"))


@query("SELECT conv_id, turn, 'm' || conv_id || '-' || turn AS message_id, CASE WHEN turn > 0 THEN 'm' || conv_id || '-' || (turn - 1) END AS in_reply_to, 'thread:' || substr(sha1('m' || conv_id || '-0'), 1, 16) AS thread_key FROM conversations")
def v52_thread_headers(spark, d):
    """Identifiers of messages, and the key of their thread from the first one."""
    key = lambda n: F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), n.cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", key(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("in_reply_to"), lifecycle.thread_key(key(F.lit(0))).alias("thread_key"))


@query("SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'work_career' ELSE 'media' END AS category, max(quality) = 1 AS include FROM labels GROUP BY 1")
def v54_overrides(spark, d):
    """Decisions by hand on all documents (v54, v55)."""
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return rows.select("doc_id", F.when(F.col("q") == 1, "work_career").otherwise("media").alias("category"), (F.col("q") == 1).alias("include"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def v62_audit_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", stamp("ts").alias("at"))


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND length(content_text) > 0 ORDER BY {names.RANK_SQL}, modified_at DESC NULLS LAST, id LIMIT 300"))
def v68_documents_by_priority(spark, d):
    rows = files(spark, d).filter(store.active() & (F.length("content_text") > 0))
    return rows.orderBy(names.priority_rank(F.col("priority")), F.desc_nulls_last("modified_at"), "id").limit(300).select("id")


@query("SELECT count(*) AS vectors, count(DISTINCT label) AS clusters, max(len(embedding)) AS dims FROM embeddings")
def v69_semantic_statistics(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("clusters"), F.max(F.size("embedding")).alias("dims"))


@query(sql("SELECT id, substr(content_text, 1, 3000) AS content, quality AS summary FROM files LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = id WHERE id % 6 = 2"))
def v73_contents(spark, d):
    notes = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("summary"))
    return files(spark, d).filter("id % 6 = 2").select("id", F.substring("content_text", 1, 3000).alias("content")).join(notes, "id", "left")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def v74_question_history(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)


@query(sql("SELECT id, path, substr(content_text, 1, 4000) AS text, coalesce(length(content_text) > 4000, false) AS truncated FROM files WHERE id = 12 OR path = (SELECT min(path) FROM files)"))
def v75_document_by(spark, d):
    """A document by identifier, and one by path."""
    first = files(spark, d).agg(F.min("path").alias("path"))  # one row
    rows = files(spark, d)
    hit = rows.filter("id = 12").unionByName(rows.join(F.broadcast(first), "path", "left_semi").filter("id != 12"))
    return hit.select("id", "path", F.substring("content_text", 1, 4000).alias("text"), F.coalesce(F.length("content_text") > 4000, F.lit(False)).alias("truncated"))


@query(sql(f"SELECT 'files' AS part, count(*) AS n, strftime(max(indexed_at), '{STAMP}') AS last FROM files UNION ALL SELECT 'hashes', count(*), strftime(max(mtime), '{STAMP}') FROM hashes UNION ALL SELECT 'queue', count(*), strftime(max(last_attempted), '{STAMP}') FROM queue UNION ALL SELECT 'events', count(*), strftime(max(ts), '{STAMP}') FROM events", "hashes", "queue"))
def v77_table_counts(spark, d):
    part = lambda name, df, at: df.agg(F.count("*").alias("n"), stamp(F.max(at)).alias("last")).select(F.lit(name).alias("part"), "n", "last")
    out = part("files", files(spark, d), "indexed_at").unionByName(part("hashes", hashes(spark, d), "mtime"))
    return out.unionByName(part("queue", corpus.queue(spark, d), "last_attempted")).unionByName(part("events", table(spark, d, "events"), "ts"))


@query("SELECT label AS model, count(*) AS vectors FROM embeddings GROUP BY 1")
def v78_store_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("model")).agg(F.count("*").alias("vectors"))


@query("SELECT l_orderkey AS dossier, count(*) AS members, coalesce(o_orderpriority, 'none') AS title FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 3 ORDER BY members DESC, dossier LIMIT 200")
def v82_dossier_list(spark, d):
    """Dossiers (orders) with their number of members (lines)."""
    members = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("dossier")).agg(F.count("*").alias("members"))
    rows = members.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("dossier"), F.col("o_orderpriority").alias("title")), "dossier", "left")
    return rows.select("dossier", "members", F.coalesce("title", F.lit("none")).alias("title")).orderBy(F.desc("members"), "dossier").limit(200)


@query("SELECT l_orderkey AS dossier, l_linenumber AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS position, l_returnflag AS section FROM lineitem WHERE l_linestatus = 'O'")
def v84_reordered_members(spark, d):
    """Membership edits: some members are removed, the others put into a new order."""
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")) - 1
    return rows.select(F.col("l_orderkey").alias("dossier"), F.col("l_linenumber").alias("member"), place.alias("position"), F.col("l_returnflag").alias("section"))


@query(sql(f"WITH {_DOSSIER} SELECT id FROM dossier WHERE id NOT IN (SELECT id FROM files WHERE id % 4 = 1)"))
def v87_excluded_members(spark, d):
    """A dossier after some documents were excluded by hand (v85, v87)."""
    return _dossier(spark, d).join(files(spark, d).filter("id % 4 = 1").select("id"), "id", "left_anti")


@query("SELECT o_orderkey AS report, strftime(coalesce(greatest(o_orderdate, max(l_shipdate)), o_orderdate), '%Y-%m-%d') AS changed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY changed DESC, report LIMIT 200")
def v90_definitions_by_change(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), "o_orderdate").join(last, "report", "left")
    changed = F.date_format(F.coalesce(F.greatest("o_orderdate", "last"), "o_orderdate"), "yyyy-MM-dd")
    return rows.select("report", changed.alias("changed")).orderBy(F.desc("changed"), "report").limit(200)


@query("SELECT l_orderkey AS report, l_linenumber AS artifact FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def v91_artifacts(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("report"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("artifact")).join(done, "report", "left_semi")


@query(sql("SELECT t.tag_id, upper(name) AS name, t.tag_id = 7 AS deleted FROM tags t", "tags"))
def v93_edited_tags(spark, d):
    return corpus.tags(spark).select("tag_id", F.upper("name").alias("name"), (F.col("tag_id") == 7).alias("deleted"))


@query(sql("WITH n AS (SELECT file_id, tag_id FROM file_tags UNION SELECT id, 2 FROM files WHERE id % 5 = 0) SELECT tag_id, count(*) AS uses FROM n GROUP BY 1", "file_tags"))
def v94_tagged(spark, d):
    """Uses after a tag was put on files that partly have it: each link counts once."""
    new = files(spark, d).filter("id % 5 = 0").select(F.col("id").alias("file_id"), F.lit(2).cast("long").alias("tag_id"))
    return corpus.file_tags(spark, d).select("file_id", "tag_id").unionByName(new).distinct().groupBy("tag_id").agg(F.count("*").alias("uses"))


@query(sql("SELECT t.tag_id, count(f.file_id) AS uses FROM tags t LEFT JOIN (SELECT * FROM file_tags WHERE file_id % 2 = 1) f ON f.tag_id = t.tag_id GROUP BY 1", "tags", "file_tags"))
def v95_untagged(spark, d):
    """Uses after links were removed: never below 0."""
    left = corpus.file_tags(spark, d).filter("file_id % 2 = 1").groupBy("tag_id").agg(F.count("*").alias("n"))
    return corpus.tags(spark).select("tag_id").join(left, "tag_id", "left").select("tag_id", F.coalesce("n", F.lit(0)).alias("uses"))


@query(sql("SELECT file_id, list_sort(list(name)) AS tags FROM file_tags JOIN tags USING (tag_id) GROUP BY 1", "tags", "file_tags"))
def v96_tags_of(spark, d):
    return corpus.file_tags(spark, d).join(F.broadcast(corpus.tags(spark)), "tag_id").groupBy("file_id").agg(F.sort_array(F.collect_list("name")).alias("tags"))  # a handful of tags


@query(sql("SELECT tag_id, file_id, row_number() OVER (PARTITION BY tag_id ORDER BY tagged_at DESC NULLS LAST, file_id) AS place FROM file_tags QUALIFY place <= 100", "file_tags"))
def v97_files_of_tag(spark, d):
    return relational.top_per_group(corpus.file_tags(spark, d), "tag_id", [F.desc_nulls_last("tagged_at"), F.col("file_id")], 100).drop("tagged_at")


@query(sql("SELECT file_id, filename FROM favourites JOIN files ON files.id = file_id ORDER BY added_at DESC, file_id LIMIT 100", "favourites"))
def v98_favourites(spark, d):
    rows = corpus.favourites(spark, d).join(files(spark, d).select(F.col("id").alias("file_id"), "filename"), "file_id")
    return rows.orderBy(F.desc("added_at"), "file_id").limit(100).select("file_id", "filename")


@query(sql("SELECT id, id IN (SELECT file_id FROM favourites) AS favourite FROM files", "favourites"))
def v99_is_favourite(spark, d):
    return _flag(files(spark, d).select("id"), _ids(corpus.favourites(spark, d)), "favourite")


@query("SELECT event_type AS kind, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def v100_sync_statistics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), stamp(F.max("ts")).alias("last"))


@query(sql("SELECT parent_dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE parent_dir IS NOT NULL GROUP BY 1 ORDER BY files DESC, parent_dir LIMIT 20"))
def v102_top_folders(spark, d):
    rows = files(spark, d).filter("parent_dir is not null").groupBy("parent_dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return rows.orderBy(F.desc("files"), "parent_dir").limit(20)


@query("WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap FROM events) SELECT event_type, round(median(1000000.0 / gap), 6) AS rate, round(1000 / median(1000000.0 / gap), 3) AS eta FROM g WHERE gap > 0 GROUP BY 1")
def v103_rates(spark, d):
    """The median of momentary rates, and what a thousand more would take. The median needs a type's gaps together, as the feature
    does over a scan's last steps."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, d, "events").select("event_type", (at - F.lag(at).over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).alias("gap")).filter("gap > 0")
    rate = F.median(1000000.0 / F.col("gap"))
    return gaps.groupBy("event_type").agg(F.round(rate, 6).alias("rate"), F.round(1000 / rate, 3).alias("eta"))


@query(sql("SELECT 'state' AS part, coalesce(state, 'ACTIVE') AS name, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'type', file_type, count(*) FROM files GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'extension', extension, count(*) AS n FROM files GROUP BY 2 ORDER BY n DESC, extension LIMIT 20) UNION ALL SELECT * FROM (SELECT 'largest', id::VARCHAR, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 10)"))
def v104_showcase(spark, d):
    rows = files(spark, d)
    by = store.facets(rows.select(F.coalesce("state", F.lit("ACTIVE")).alias("state"), F.col("file_type").alias("type")), ["state", "type"]).select(F.col("facet").alias("part"), F.col("value").alias("name"), "n")
    ext = rows.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(20).select(F.lit("extension").alias("part"), F.col("extension").alias("name"), "n")
    big = rows.orderBy(F.desc("size_bytes"), "id").limit(10).select(F.lit("largest").alias("part"), F.col("id").cast("string").alias("name"), F.col("size_bytes").alias("n"))
    return by.unionByName(ext).unionByName(big)


@query(sql("SELECT id, extension FROM files WHERE extension IN ('.pdf', '.docx', '.eml', '.txt') ORDER BY CASE extension WHEN '.pdf' THEN 0 WHEN '.docx' THEN 1 WHEN '.eml' THEN 2 ELSE 3 END, size_bytes, id LIMIT 500"))
def v105_legal_selection(spark, d):
    e = F.col("extension")
    rank = F.when(e == ".pdf", 0).when(e == ".docx", 1).when(e == ".eml", 2).otherwise(3)
    return files(spark, d).filter(e.isin(".pdf", ".docx", ".eml", ".txt")).orderBy(rank, "size_bytes", "id").limit(500).select("id", "extension")


@query(sql("SELECT id, path FROM files WHERE state = 'MISSING'"))
def v106_missing(spark, d):
    return files(spark, d).filter("state = 'MISSING'").select("id", "path")


# --- serving and health ---------------------------------------------------------------------------------


@query(sql(f"""WITH {_SIM}, {_FULL}, s AS (SELECT vec_id AS id, sim AS score FROM sims WHERE sim >= 0.3 AND vec_id IN (SELECT id FROM files WHERE {ACTIVE}) ORDER BY sim DESC, vec_id LIMIT 5), l AS (SELECT id, score FROM found WHERE id IN (SELECT id FROM files WHERE {ACTIVE}) ORDER BY score DESC, id LIMIT 5)
SELECT id, 'semantic' AS how FROM s UNION ALL SELECT id, 'lexical' FROM l WHERE (SELECT count(*) FROM s) = 0"""))
def s8_chat_documents(spark, d):
    """Five documents for an answer: similar ones, or else those that full text finds."""
    live = files(spark, d).filter(store.active()).select("id")
    near = _similar(spark, d).withColumnRenamed("vec_id", "id").filter("sim >= 0.3").join(live, "id", "left_semi").orderBy(F.desc("sim"), "id").limit(5).select("id", F.lit("semantic").alias("how"))
    near = cut(near, "near")
    found = _full_text(spark, d).join(live, "id", "left_semi").orderBy(F.desc("score"), "id").limit(5).select("id", F.lit("lexical").alias("how"))
    some = near.agg((F.count("*") > 0).alias("some"))  # one row
    return near.unionByName(found.crossJoin(F.broadcast(some)).filter("not some").drop("some"))


@query(sql(f"WITH {_FULL}, b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n FROM found QUALIFY n <= 5) SELECT string_agg('[' || n || '] ' || filename || ': ' || substr(content_text, 1, 500), chr(10) ORDER BY n) AS context, count(*) AS documents FROM b JOIN files USING (id)"))
def s9_prompt_context(spark, d):
    """Excerpts of the five best documents as one text."""
    best = _full_text(spark, d).orderBy(F.desc("score"), "id").limit(5).withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    rows = best.join(files(spark, d).select("id", "filename", F.substring("content_text", 1, 500).alias("part")), "id")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "filename", F.lit(": "), "part")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"), F.count("*").alias("documents"))  # five rows


@query(sql("SELECT id, (CASE WHEN contains(lower(content_text), 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content_text), 'ment') THEN 2 ELSE 0 END + CASE WHEN contains(lower(filename), 'report') THEN 3 ELSE 0 END)::BIGINT AS relevance FROM files WHERE contains(lower(content_text), 'tion') OR contains(lower(content_text), 'ment') OR contains(lower(filename), 'report') ORDER BY relevance DESC, id LIMIT 20"))
def s10_keyword_retrieval(spark, d):
    has = lambda c, w: F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
    tests = ((has("content_text", "tion"), 2), (has("content_text", "ment"), 2), (has("filename", "report"), 3))
    points = reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), tests, F.lit(0))
    return files(spark, d).select("id", points.cast("long").alias("relevance")).filter("relevance > 0").orderBy(F.desc("relevance"), "id").limit(20)


@query("SELECT count(*) AS rows, count(*) FILTER (len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) > 0) AS indexed FROM documents".replace("\\\\", "\\"))
def s12_index_consistency(spark, d):
    """Documents, and those of which the index would hold a word."""
    return table(spark, d, "documents").agg(F.count("*").alias("rows"), F.count_if(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(t.WORD)) > 0).alias("indexed"))


@query(sql(f"SELECT (SELECT count(*) FROM embeddings) AS vectors, count(*) FILTER ({_LIVE}) AS eligible, count(*) FILTER ({_LIVE} AND id NOT IN (SELECT vec_id FROM embeddings)) AS missing, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM files WHERE {_LIVE})) AS orphans FROM files"))
def s13_vector_consistency(spark, d):
    live = files(spark, d).filter(store.active() & (F.length("content_text") > 0)).select("id")
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    both = live.withColumn("a", F.lit(1)).join(have.withColumn("b", F.lit(1)), "id", "full_outer")
    return both.agg(F.count("b").alias("vectors"), F.count("a").alias("eligible"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("orphans"))


@query(sql(f"SELECT count(*) AS files, count(*) FILTER ({ACTIVE}) AS active, count(*) FILTER (length(content_text) > 0) AS searchable, (SELECT count(*) FROM queue WHERE NOT ignored) AS issues, (SELECT count(*) FROM embeddings) AS vectors FROM files", "queue"))
def s15_health(spark, d):
    rows = files(spark, d).agg(F.count("*").alias("files"), F.count_if(store.active()).alias("active"), F.count_if(F.length("content_text") > 0).alias("searchable"))
    issues = corpus.queue(spark, d).agg(F.count_if(~F.col("ignored")).alias("issues"))
    return rows.crossJoin(issues).crossJoin(table(spark, d, "embeddings").agg(F.count("*").alias("vectors")))


@query("SELECT event_type, count(*) AS kept, round(avg(value), 6) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY 1")
def s16_last_values(spark, d):
    """The last thousand values of each metric."""
    rows = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    last = relational.top_per_group(rows, "event_type", [F.desc("ts"), F.desc("event_id")], 1000)
    return last.groupBy("event_type").agg(F.count("*").alias("kept"), F.round(F.avg("value"), 6).alias("mean"))
