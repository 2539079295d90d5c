"""Queries over names and texts: tokens, stems, markers, dates, types, masks, entities, categories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import entities, names, scores
from foliant.functions import text as t
from foliant.operators import categories, families, lifecycle, relational, store
from foliant.operators.scratch import cut
from foliant.plans import corpus
from foliant.plans.corpus import ACTIVE, STAMP, files, sql, stamp
from foliant.plans.queries import query, table, texts
from foliant.sources import markup

LATIN = f"regexp_extract_all(lower(coalesce(content_text, '')), '{t.LATIN}')"

# --- tokens and names -----------------------------------------------------------------------------------


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{t.LATIN}') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM w")
def j1_token_counts(spark, d):
    rows = texts(spark, d).select("doc_id", t.latin_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{t.LATIN}') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(greatest(len(w) - 4, 0) + 1), lambda i: array_to_string(w[i + 1:i + 4], ' ')))) END AS n_shingles FROM w")
def j2_shingles(spark, d):
    rows = texts(spark, d).select("doc_id", t.latin_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size(scores.shingles(F.col("w"))).cast("long").alias("n_shingles"))


@query()
def j3_simhash(spark, d):
    rows = cut(texts(spark, d).select("doc_id", t.latin_tokens(F.col("text")).alias("w")), "tokens")  # else each run would split the text again
    hashed = rows.select("doc_id", scores.simhash64(scores.shingles(F.col("w"))).alias("simhash"))
    return hashed.withColumn("bands", scores.band_keys(F.col("simhash")))


@query(sql("WITH p AS (SELECT a.id AS a, b.id AS b, a.h AS x, b.h AS y FROM (SELECT id, id * 7919 % 1048573 AS h FROM files) a JOIN (SELECT id, id * 7919 % 1048573 AS h FROM files) b ON b.id = a.id + 1) SELECT a, b, bit_count(xor(x, y))::INTEGER AS distance FROM p"))
def j4_hamming(spark, d):
    h = files(spark, d).select("id", (F.col("id") * 7919 % 1048573).alias("h"))
    pairs = h.select(F.col("id").alias("a"), F.col("h").alias("x")).join(h.select(F.col("id").alias("b"), F.col("h").alias("y")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", scores.hamming(F.col("x"), F.col("y")).alias("distance"))


@query(sql("SELECT id, [h & 65535, (h >> 16) & 65535, (h >> 32) & 65535, (h >> 48) & 65535] AS bands FROM (SELECT id, id * 1099511627791 % 9007199254740881 AS h FROM files)"))
def j5_band_keys(spark, d):
    h = (F.col("id") * 1099511627791) % 9007199254740881
    return files(spark, d).select("id", scores.band_keys(h).alias("bands"))


_BARE = r"regexp_replace(filename, '(?i)(?:\.tar\.(?:gz|bz2|xz|zst)|\.[^.]*)$', '')"


@query(sql(f"SELECT id, {_BARE} AS bare FROM files"))
def j7_bare_name(spark, d):
    return files(spark, d).select("id", names.bare_name(F.col("filename")).alias("bare"))


@query(sql(f"SELECT id, {names.version_stem_sql('filename')} AS stem FROM files"))
def j8_version_stem(spark, d):
    return files(spark, d).select("id", names.version_stem(F.col("filename")).alias("stem"))


_DATE1 = r"'(?:^|[^0-9])(20[0-9]{2})[-_.]?([0-9]{2})[-_.]?([0-9]{2})(?:[^0-9]|$)'"
_DATE2 = r"'(?:^|[^0-9])([0-9]{2})[-_.]?([0-9]{2})[-_.]?(20[0-9]{2})(?:[^0-9]|$)'"
_MARKERS = f"""markers AS (SELECT *, CASE WHEN regexp_matches(filename, {_DATE1}) OR regexp_matches(filename, {_DATE2}) THEN 'date' WHEN numbers[-1] IS NOT NULL THEN 'number' END AS kind,
  CASE WHEN regexp_matches(filename, {_DATE1}) THEN regexp_extract(filename, {_DATE1}, 1) || '-' || regexp_extract(filename, {_DATE1}, 2) || '-' || regexp_extract(filename, {_DATE1}, 3)
    WHEN regexp_matches(filename, {_DATE2}) THEN regexp_extract(filename, {_DATE2}, 3) || '-' || regexp_extract(filename, {_DATE2}, 2) || '-' || regexp_extract(filename, {_DATE2}, 1) ELSE numbers[-1] END AS value
  FROM (SELECT *, list_filter(regexp_extract_all({_BARE}, '[0-9]+'), lambda x: length(x) <= 4) AS numbers FROM files))"""


@query(sql(f"WITH {_MARKERS} SELECT id, kind, value FROM markers"))
def j9_version_marker(spark, d):
    """A date first, by year or by day; else the last number of one to four digits."""
    return files(spark, d).select("id", names.version_marker(F.col("filename")).alias("m")).select("id", "m.kind", "m.value")


_TOPICAL = f"list_filter(regexp_extract_all(lower(coalesce(content_text, '')), '{t.TOPIC}'), lambda x: NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({', '.join(repr(w) for w in t.STOPWORDS)}))[1:4000]"


@query(sql(f"SELECT id, len({_TOPICAL}) AS n, array_to_string({_TOPICAL}[1:5], ' ') AS first FROM files"))
def j10_topic_tokens(spark, d):
    rows = files(spark, d).select("id", t.topic_tokens(F.col("content_text")).alias("w"))
    return rows.select("id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 5), " ").alias("first"))


@query(r"SELECT DISTINCT url AS term, length(url) BETWEEN 3 AND 40 AND NOT regexp_matches(url, '^[0-9]+$|[@/:\\]|^[0-9]{2,}') AS safe FROM pages UNION SELECT DISTINCT p_name, length(p_name) BETWEEN 3 AND 40 AND NOT regexp_matches(p_name, '^[0-9]+$|[@/:\\]|^[0-9]{2,}') FROM part")
def j11_safe_terms(spark, d):
    terms = table(spark, d, "pages").select(F.col("url").alias("term")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("term"))).distinct()
    return terms.select("term", t.safe_term(F.col("term")).alias("safe"))


# --- dates ----------------------------------------------------------------------------------------------

_GROUPS = {"day": "'%Y-%m-%d'", "month": "'%Y-%m'", "year": "'%Y'", "week": "'%G-W%V'"}


def bucket(at, group: str):
    return scores.iso_week(at) if group == "week" else F.date_format(at, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[group])


@query(" UNION ALL ".join(f"SELECT '{g}' AS kind, strftime(o_orderdate, {f}) AS bucket, count(*) AS n FROM orders GROUP BY 2" for g, f in _GROUPS.items()))
def j14_date_buckets(spark, d):
    """Day, month, year and ISO week of every order, counted in one pass."""
    at = F.col("o_orderdate")
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("kind"), bucket(at, g).alias("bucket")) for g in _GROUPS])).alias("b")
    return table(spark, d, "orders").groupBy(F.to_date(at).alias("o_orderdate")).agg(F.count("*").alias("k")).select("k", each).groupBy("b.kind", "b.bucket").agg(F.sum("k").alias("n"))


@query(sql("SELECT id, strftime(modified_at, '%Y-%m') AS month, strftime(modified_at, '%G-W%V') AS week FROM files"))
def j15_bucket_or_null(spark, d):
    return files(spark, d).select("id", bucket(F.col("modified_at"), "month").alias("month"), F.when(F.col("modified_at").isNotNull(), bucket(F.col("modified_at"), "week")).alias("week"))


_TEXT_DATE = f"CASE id % 4 WHEN 0 THEN strftime(indexed_at - id * INTERVAL 1 HOUR, '{STAMP}') WHEN 1 THEN strftime(indexed_at - id * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN '2024-13-99 odd' END"


def _text_date():
    at = F.timestamp_add("HOUR", -F.col("id"), "indexed_at")
    return F.when(F.col("id") % 4 == 0, stamp(at)).when(F.col("id") % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("id") % 4 == 2, "2024-13-99 odd")


@query(sql(f"SELECT id, CASE WHEN s IS NOT NULL THEN coalesce(strftime(try_cast(replace(s, 'T', ' ') AS TIMESTAMP), '%Y-%m-%d'), substr(s, 1, 10)) END AS date FROM (SELECT id, {_TEXT_DATE} AS s FROM files)"))
def j16_event_date(spark, d):
    """The date of a written time; what is no time counts by its first ten characters."""
    s = _text_date()
    return files(spark, d).select("id", F.coalesce(F.date_format(F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" "))), "yyyy-MM-dd"), F.substring(s, 1, 10)).alias("date"))


@query(sql(f"""WITH {_MARKERS} SELECT id, coalesce(h, CASE WHEN kind = 'date' THEN value END, strftime(modified_at, '%Y-%m-%d'), strftime(created_at, '%Y-%m-%d')) AS date,
CASE WHEN h IS NOT NULL THEN 'email_header' WHEN kind = 'date' THEN 'filename_version_marker' WHEN modified_at IS NOT NULL THEN 'modified_at' WHEN created_at IS NOT NULL THEN 'created_at' END AS source,
CASE WHEN h IS NOT NULL THEN 'KNOWN' WHEN kind = 'date' THEN 'INFERRED' WHEN modified_at IS NOT NULL OR created_at IS NOT NULL THEN 'KNOWN' ELSE 'UNAVAILABLE' END AS provenance
FROM markers LEFT JOIN (SELECT event_id AS eid, strftime(min(ts), '%Y-%m-%d') AS h FROM events WHERE event_type = 'click' GROUP BY 1) ON eid = id"""))
def j17_provenance_date(spark, d):
    """A message's own date, else a date in the name, else the time of change or creation, with where it comes from."""
    header = table(spark, d, "events").filter("event_type = 'click'").groupBy(F.col("event_id").alias("id")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("h"))
    rows = files(spark, d).select("id", "modified_at", "created_at", names.version_marker(F.col("filename")).alias("m")).join(header, "id", "left")
    inname = F.when(F.col("m.kind") == "date", F.col("m.value"))
    changed, created = F.date_format("modified_at", "yyyy-MM-dd"), F.date_format("created_at", "yyyy-MM-dd")
    source = F.when(F.col("h").isNotNull(), "email_header").when(inname.isNotNull(), "filename_version_marker").when(changed.isNotNull(), "modified_at").when(created.isNotNull(), "created_at")
    rows = rows.select("id", F.coalesce("h", inname, changed, created).alias("date"), source.alias("source"))
    return rows.withColumn("provenance", F.when(F.col("source") == "filename_version_marker", "INFERRED").when(F.col("source").isNotNull(), "KNOWN").otherwise("UNAVAILABLE"))


@query(sql(f"SELECT id, strftime(try_cast(replace(replace(s, 'T', ' '), 'Z', '') AS TIMESTAMP), '{STAMP}') AS at FROM (SELECT id, {_TEXT_DATE} AS s FROM files)"))
def j19_parse_or_null(spark, d):
    return files(spark, d).select("id", stamp(F.try_to_timestamp(F.translate(_text_date(), "TZ", " "))).alias("at"))


# --- sizes, types, labels -------------------------------------------------------------------------------


@query(sql("SELECT id, CASE WHEN s >= 1073741824 THEN format('{:.1f} GB', s / 1073741824) WHEN s >= 1048576 THEN format('{:.1f} MB', s / 1048576) WHEN s >= 1024 THEN format('{:.1f} KB', s / 1024) ELSE s::BIGINT || ' B' END AS shown FROM (SELECT id, (size_bytes * (id % 5) * (id % 7) * 64)::DOUBLE AS s FROM files)"))
def j21_human_size(spark, d):
    return files(spark, d).select("id", names.human_size(F.col("size_bytes") * (F.col("id") % 5) * (F.col("id") % 7) * 64).alias("shown"))


@query(sql("""SELECT id, CASE WHEN s <= 0 THEN NULL WHEN s <= 1 THEN '<1MB' WHEN s <= 10 THEN '1-10MB' WHEN s <= 100 THEN '10-100MB' WHEN s <= 1000 THEN '100MB-1GB' ELSE '>1GB' END AS size_class, year(modified_at)::INTEGER AS year, month(modified_at)::INTEGER AS month, dayname(modified_at) AS weekday, hour(modified_at)::INTEGER AS hour,
coalesce(nullif(regexp_extract(filename, '\\.([^.]+)$', 1), ''), 'no_ext') AS ext, length(path) - length(replace(path, '/', '')) AS folder_depth FROM (SELECT *, size_bytes * (id % 9) * (id % 9) * 100 / 1048576.0 AS s FROM files)""".replace("\\\\", "\\")))
def j22_size_classes(spark, d):
    size = F.col("size_bytes") * (F.col("id") % 9) * (F.col("id") % 9) * 100
    at, ext = F.col("modified_at"), F.regexp_extract("filename", r"\.([^.]+)$", 1)
    return files(spark, d).select("id", names.size_class(size).alias("size_class"), F.year(at).alias("year"), F.month(at).alias("month"), F.date_format(at, "EEEE").alias("weekday"), F.hour(at).alias("hour"), F.when(ext == "", "no_ext").otherwise(ext).alias("ext"), (F.length("path") - F.length(F.replace("path", F.lit("/")))).cast("long").alias("folder_depth"))


@query(sql("SELECT id, file_type FROM files"))
def j23_file_type(spark, d):
    return files(spark, d).select("id", "file_type")


@query(sql("SELECT id, priority FROM files"))
def j24_priority(spark, d):
    return files(spark, d).select("id", "priority")


@query(sql(f"SELECT id, {names.by_extension_sql('extension', names.QUICK_TYPES)} AS quick_type FROM files"))
def j25_quick_type(spark, d):
    return files(spark, d).select("id", names.by_extension(F.col("extension"), names.QUICK_TYPES).alias("quick_type"))


@query(sql(f"SELECT id, {names.by_extension_sql('extension', names.MEMBER_TYPES)} AS member_type FROM files WHERE document_kind = 'ARCHIVE_MEMBER'"))
def j26_member_type(spark, d):
    return files(spark, d).filter("document_kind = 'ARCHIVE_MEMBER'").select("id", names.by_extension(F.col("extension"), names.MEMBER_TYPES).alias("member_type"))


@query(sql(f"""SELECT id, list_sort(list_distinct(list_concat(list_filter(list_transform(list_filter(string_split(path, '/'), lambda p: length(p) > 2 AND NOT starts_with(p, '.')), lambda p: lower(replace(replace(p, '_', ' '), '-', ' '))), lambda p: p NOT IN ({', '.join(repr(x) for x in names.NO_TAGS)})),
list_filter([{names.by_extension_sql('extension', names.TAG_TYPES, 'NULL')}], lambda k: k IS NOT NULL), list_filter([{', '.join(repr(x) for x in names.TAG_WORDS)}], lambda w: contains(lower(coalesce(content_text, '')), w)))))[1:10] AS tags FROM files"""))
def j27_suggested_tags(spark, d):
    return files(spark, d).select("id", names.suggested_tags(F.col("path"), F.col("content_text")).alias("tags"))


@query(sql(f"SELECT id, 'version:' || substr(sha1(coalesce(parent_dir, '') || '|' || {names.version_stem_sql('filename')}), 1, 16) AS family FROM files"))
def j29_family_key(spark, d):
    return files(spark, d).select("id", names.family_key(F.col("parent_dir"), names.version_stem(F.col("filename"))).alias("family"))


@query(sql("SELECT id, sha256(coalesce(content_text, '')) AS digest FROM files"))
def j30_content_hash(spark, d):
    return files(spark, d).select("id", F.sha2(F.coalesce("content_text", F.lit("")), 256).alias("digest"))


@query(sql("SELECT id, substr(sha256('salt' || chr(31) || filename), 1, 24) AS fingerprint FROM files"))
def j31_salted_fingerprint(spark, d):
    """Salted, 24 places; SHA-256 in place of the reference's BLAKE2b, which no built-in function gives."""
    return files(spark, d).select("id", F.substring(F.sha2(F.concat(F.lit("salt\x1f"), "filename"), 256), 1, 24).alias("fingerprint"))


@query(sql("SELECT id, substr(sha256(coalesce(content_text, '')), 1, 32) AS version FROM files"))
def j32_content_version(spark, d):
    return files(spark, d).select("id", F.substring(F.sha2(F.coalesce("content_text", F.lit("")), 256), 1, 32).alias("version"))


@query("SELECT label, substr(sha256('model|64|' || count(*) || '|' || max(vec_id)), 1, 32) AS signature FROM embeddings GROUP BY label")
def j33_freshness_signature(spark, d):
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("g"))
    return rows.select("label", lifecycle.freshness_signature(F.lit("model"), F.lit(64), F.col("n"), F.col("g")).alias("signature"))


@query(sql("SELECT id, sha256('{\"language\":\"' || coalesce(lang, '') || '\",\"min_size\":' || size_bytes || '}') AS fingerprint FROM files"))
def j34_query_fingerprint(spark, d):
    """SHA-256 of a query as JSON with sorted keys."""
    text = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("language"), F.col("size_bytes").alias("min_size")))
    return files(spark, d).select("id", F.sha2(text, 256).alias("fingerprint"))


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))")
def j35_unit_vectors(spark, d):
    from foliant.functions import vectors as v

    unit = v.normalised(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("square"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(sql("SELECT id, CASE WHEN path IS NOT NULL AND path <> '' THEN '<redacted>/' || string_split(path, '/')[-1] END AS shown FROM files"))
def j39_shown_path(spark, d):
    return files(spark, d).select("id", names.shown_path(F.col("path"), True).alias("shown"))


_MAIL = "'Subject: Note ' || id || chr(10) || 'FROM:  Person' || (id % 9) || ' ' || chr(10) || CASE WHEN id % 3 = 0 THEN chr(10) ELSE '' END || 'Date: 2024-01-0' || (id % 9 + 1) || chr(10) || chr(10) || coalesce(content_text, '')"


@query(sql("SELECT id, 'Person' || (id % 9) AS sender, CASE WHEN id % 3 <> 0 THEN '2024-01-0' || (id % 9 + 1) END AS sent FROM files"))
def j40_header_values(spark, d):
    """Headers of messages; what stands after the first blank line is none."""
    i = F.col("id")
    text = F.concat(F.lit("Subject: Note "), i.cast("string"), F.lit("\nFROM:  Person"), (i % 9).cast("string"), F.lit(" \n"), F.when(i % 3 == 0, "\n").otherwise(""), F.lit("Date: 2024-01-0"), (i % 9 + 1).cast("string"), F.lit("\n\n"), F.coalesce("content_text", F.lit("")))
    return files(spark, d).select("id", names.header_value(text, "From").alias("sender"), names.header_value(text, "Date").alias("sent"))


@query(sql("SELECT id, list_distinct(['D' || (id % 7), 'E' || (id % 3), 'D' || (id % 5)]) AS refs FROM files".replace("list_distinct(", "list_transform(list_sort(list_transform(list_distinct(list_transform(").replace(") AS refs", ", lambda x: x)), lambda x: x)), lambda x: x) AS refs")))
def j42_citations(spark, d):
    i = F.col("id")
    text = F.concat(F.lit("see [D"), (i % 7).cast("string"), F.lit(":p3], [E"), (i % 3).cast("string"), F.lit("] and [D"), (i % 5).cast("string"), F.lit("] not [X9]"))
    return files(spark, d).select("id", F.array_sort(names.citations(text)).alias("refs"))


@query(sql("SELECT id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(filename, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'item') AS slug FROM files"))
def j43_slug(spark, d):
    return files(spark, d).select("id", names.slug(F.col("filename"), "item").alias("slug"))


# Words that show the wish to search, and words that are no search terms.
SEARCH_SIGNS = "trouve|cherche|recherche|find|search|look for|montre|show|display|affiche|liste|list|où|where|quel|which|what|qui|who".split("|")
CHAT_STOPWORDS = "le la les un une des de du et ou mais donc or ni car the a an and but in on trouve cherche montre affiche find search moi me je tu il elle nous vous document fichier file docs".split()


@query("SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in SEARCH_SIGNS) + " THEN array_to_string(list_filter(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+'), lambda w: length(w) > 2 AND w NOT IN (" .replace("\\\\", "\\") + ", ".join(repr(w) for w in CHAT_STOPWORDS) + "))[1:3], ' ') ELSE '' END AS terms FROM conversations")
def j44_chat_keywords(spark, d):
    """The first three words of a message that asks for something, without stop words; nothing of other messages."""
    low = F.lower("text")
    asks = F.lit(False)
    for w in SEARCH_SIGNS:
        asks = asks | F.contains(low, F.lit(w))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([^ \t\n\r]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*CHAT_STOPWORDS))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(asks, F.array_join(F.slice(words, 1, 3), " ")).otherwise("").alias("terms"))


@query(sql("SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE lpad(lower(to_hex(id * 2654435761 & 4294967295)), 8, '0') END AS crc FROM files"))
def j45_crc_text(spark, d):
    value = F.when(F.col("id") % 6 != 0, (F.col("id") * 2654435761).bitwiseAND(4294967295))
    return files(spark, d).select("id", names.crc_text(value).alias("crc"))


# --- personal data, entities, categories ----------------------------------------------------------------

_IBAN = "'DE' || lpad((id % 100)::VARCHAR, 2, '0') || lpad((id * 7919)::VARCHAR, 18, '0')"


@query(sql(f"SELECT id, (substr(v, 5) || '1314' || substr(v, 3, 2))::HUGEINT % 97 = 1 AS valid, substr(v, 1, 4) || ' **** **** ' || right(v, 4) AS masked FROM (SELECT id, {_IBAN} AS v FROM files)"))
def k4_iban_check(spark, d):
    i = F.col("id")
    v = F.concat(F.lit("DE"), F.lpad((i % 100).cast("string"), 2, "0"), F.lpad((i * 7919).cast("string"), 18, "0"))
    return files(spark, d).select("id", t.iban_ok(v).alias("valid"), t.mask_iban(v).alias("masked"))


_NIR = "(CASE WHEN id % 2 = 0 THEN '1' ELSE '2' END) || lpad((id % 100)::VARCHAR, 2, '0') || lpad((id % 12 + 1)::VARCHAR, 2, '0') || '75' || lpad((id % 1000)::VARCHAR, 3, '0') || '042'"


@query(sql(f"SELECT id, 97 - (v::BIGINT % 97) = id % 97 + 1 AS valid FROM (SELECT id, {_NIR} AS v FROM files)"))
def k5_national_key(spark, d):
    i = F.col("id")
    two = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    v = F.concat(F.when(i % 2 == 0, "1").otherwise("2"), two(i % 100), two(i % 12 + 1), F.lit("75"), two(i % 1000, 3), F.lit("042"), two(i % 97 + 1))
    return files(spark, d).select("id", t.national_ok(v).alias("valid"))


@query(sql("WITH f AS (SELECT id, unnest(regexp_extract_all(coalesce(content_text, ''), '\\b[0-9]{13,19}\\b')) AS v FROM files) SELECT id, right(v, 4) AS tail, length(v) IN (15, 16) AND substr(v, 1, 1) IN ('3', '4', '5', '6') AND list_sum(list_transform(range(length(v)), lambda i: CASE WHEN i % 2 = 0 THEN substr(v, (length(v) - i)::BIGINT, 1)::INT ELSE (substr(v, (length(v) - i)::BIGINT, 1)::INT * 2) // 10 + (substr(v, (length(v) - i)::BIGINT, 1)::INT * 2) % 10 END)) % 10 = 0 AS accepted FROM f".replace("\\\\", "\\")))
def k6_card_accepted(spark, d):
    """15 or 16 digits that begin with 3 to 6 and pass the Luhn check."""
    rows = files(spark, d).select("id", F.explode(F.regexp_extract_all(F.coalesce("content_text", F.lit("")), F.lit(r"(\b[0-9]{13,19}\b)"), 1)).alias("v"))
    return rows.select("id", F.right("v", F.lit(4)).alias("tail"), (F.length("v").isin(15, 16) & F.substring("v", 1, 1).isin("3", "4", "5", "6") & t.luhn_ok(F.col("v"))).alias("accepted"))


@query(sql("SELECT id, repeat('*', 9) || right(p, 2) AS phone, '10.' || (id % 256) || '.*.*' AS ip, substr(filename, 1, 1) || '***' AS person, CASE WHEN length(path) > 8 THEN substr(path, 1, 8) || '…' ELSE '…' END AS address, '**/**/' || right('12.03.' || (1950 + id % 50), 4) AS dob FROM (SELECT *, '33' || lpad((id * 7919 % 1000000000)::VARCHAR, 9, '0') AS p FROM files)"))
def k8_maskers(spark, d):
    """Phone numbers, addresses of machines, persons, postal addresses and dates of birth as they may be shown."""
    i = F.col("id")
    phone = F.concat(F.lit("+33 "), F.lpad((i * 7919 % 1000000000).cast("string"), 9, "0"))
    ip = F.concat(F.lit("10."), (i % 256).cast("string"), F.lit(".7.8"))
    return files(spark, d).select("id", t.mask_phone(phone).alias("phone"), t.mask_ip(ip).alias("ip"), t.mask_name(F.col("filename")).alias("person"), t.mask_address(F.col("path")).alias("address"), t.mask_dob(F.concat(F.lit("12.03."), (1950 + i % 50).cast("string"))).alias("dob"))


@query(sql("SELECT id, coalesce(s >= 1, false) AS medium, coalesce(s >= 2, false) AS high FROM files LEFT JOIN (SELECT file_id, max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS s FROM pii GROUP BY 1) ON file_id = id", "pii"))
def k15_sensitive(spark, d):
    """Whether a document holds a finding of medium severity at least, and of high severity."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    worst = corpus.pii(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.max(rank).alias("s"))
    at_least = lambda n: F.coalesce(F.col("s") >= n, F.lit(False))
    return files(spark, d).select("id").join(worst, "id", "left").select("id", at_least(1).alias("medium"), at_least(2).alias("high"))


@query(entities.entities_sql("documents", "doc_id", "text"))
def k18_entities(spark, d):
    return entities.entities(texts(spark, d), "doc_id", "text")


_KEYWORD_HITS = " UNION ALL ".join(
    f"SELECT id, '{c}' AS category, n, " + " + ".join(f"contains(low, '{k}')::INTEGER" if " " in k else f"list_contains(w, '{k}')::INTEGER" for k in ks) + " AS hits FROM w" for c, ks in categories.TAXONOMY.items()
)
_CATEGORIES = f"""w AS (SELECT id, extension, lower(coalesce(content_text, '')) AS low, list_distinct({LATIN}) AS w, greatest(len({LATIN}), 1) AS n FROM files), h AS ({_KEYWORD_HITS}),
every AS (SELECT id, {names.by_extension_sql('extension', names.STRUCTURE, 'NULL')} AS category, 1.0::DOUBLE AS score, 'structural' AS source FROM files UNION ALL SELECT id, category, round(least(100.0::DOUBLE * hits / n, 1), 3), 'keyword' FROM h WHERE 100.0::DOUBLE * hits / n >= 1),
best AS (SELECT * FROM every WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, category ORDER BY score DESC, source DESC) = 1),
categories AS (SELECT id, category, score, source FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY score DESC, category) AS place FROM best) WHERE source = 'structural' OR place <= 3)"""


@query(sql(f"WITH {_CATEGORIES} SELECT * FROM categories"))
def k19_categories(spark, d):
    """The structural category of the extension and the three best topics by keywords."""
    return categories.classified(files(spark, d), "id", "content_text", "extension")


@query(sql(f"SELECT id, {names.by_extension_sql('extension', names.STRUCTURE, 'NULL')} AS category FROM files"))
def k20_structural(spark, d):
    return files(spark, d).select("id", names.by_extension(F.col("extension"), names.STRUCTURE, None).alias("category"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {len(ks)})" for c, ks in categories.TAXONOMY.items()) + ") t(category, keywords)")
def k21_taxonomy(spark, d):
    return spark.createDataFrame([(c, len(ks)) for c, ks in categories.TAXONOMY.items()], "category string, keywords int")


@query(sql(f"""WITH {_CATEGORIES}, o AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'work_career' ELSE 'media' END AS category, quality = 1 AS include FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1))
SELECT id, category, score, source FROM categories c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = c.id AND o.category = c.category) UNION ALL SELECT id, category, 1.0::DOUBLE, 'manual' FROM o WHERE include"""))
def k22_overrides(spark, d):
    """Manual decisions win: included categories have score 1, excluded ones go."""
    manual = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q")).select("id", F.when(F.col("q") == 1, "work_career").otherwise("media").alias("category"), (F.col("q") == 1).alias("include"))
    return categories.overridden(k19_categories(spark, d), manual, "id")


@query(sql(f"WITH {_CATEGORIES} SELECT id, lang, length(content_text) AS chars, (SELECT count(*) FROM pii WHERE file_id = id) AS findings, (SELECT count(*) FROM categories c WHERE c.id = files.id) AS categories FROM files WHERE {ACTIVE} AND length(content_text) >= 20", "pii"))
def k23_annotate(spark, d):
    """All annotations of every document that has text, in one pass over the texts and one join a kind."""
    rows = files(spark, d).filter(store.active() & (F.length("content_text") >= 20)).select("id", "lang", F.length("content_text").cast("long").alias("chars"))
    found = corpus.pii(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("findings"))
    kinds = k19_categories(spark, d).groupBy("id").agg(F.count("*").alias("categories"))
    return rows.join(found, "id", "left").join(kinds, "id", "left").na.fill(0, ["findings", "categories"])


@query(sql(f"SELECT id FROM files WHERE lang = 'de' AND {ACTIVE} ORDER BY id LIMIT 100"))
def k24_by_language(spark, d):
    return files(spark, d).filter(store.active() & (F.col("lang") == "de")).select("id").orderBy("id").limit(100)


@query(sql(f"WITH {_CATEGORIES} SELECT id, score FROM categories WHERE category = 'document_pdf' ORDER BY score DESC, id LIMIT 100"))
def k25_by_category(spark, d):
    return k19_categories(spark, d).filter("category = 'document_pdf'").orderBy(F.desc("score"), "id").limit(100).select("id", "score")


@query(sql(f"SELECT a.file_id AS src, b.file_id AS dst, count(*) AS shared FROM pii a JOIN pii b ON a.pii_type = b.pii_type AND a.fingerprint = b.fingerprint AND a.file_id < b.file_id GROUP BY 1, 2", "pii"))
def k26_shared_entities(spark, d):
    """Pairs of documents by the entities that both mention."""
    a = corpus.pii(spark, d).select("pii_type", "fingerprint", F.col("file_id").alias("src"))
    pairs = a.join(a.withColumnRenamed("src", "dst"), ["pii_type", "fingerprint"]).filter("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("shared"))


@query("SELECT event_id, event_type AS action, substr(props, 1, 200) AS detail FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def k28_audit(spark, d):
    """Records of allowed actions only, their detail cut to 200 characters."""
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase")).select("event_id", F.col("event_type").alias("action"), F.substring("props", 1, 200).alias("detail"))


# --- duplicates and versions ----------------------------------------------------------------------------


@query(sql("SELECT id, CASE WHEN content_text IS NULL THEN 'UNREADABLE' WHEN size_bytes > 20000 THEN 'TOO_LARGE' ELSE 'OK' END AS state, CASE WHEN size_bytes <= 20000 THEN sha256(content_text) END AS digest FROM files"))
def l2_hash_one(spark, d):
    """Hash and outcome of every file; what is beyond the limit is not read."""
    state = F.when(F.col("content_text").isNull(), "UNREADABLE").when(F.col("size_bytes") > 20000, "TOO_LARGE").otherwise("OK")
    return files(spark, d).select("id", state.alias("state"), F.when(F.col("size_bytes") <= 20000, F.sha2("content_text", 256)).alias("digest"))


@query(sql("SELECT f.id, sha256(content_text) AS digest FROM files f LEFT JOIN hashes h ON h.file_id = f.id AND h.size_bytes = f.size_bytes AND h.mtime IS NOT DISTINCT FROM f.modified_at WHERE h.file_id IS NULL AND content_text IS NOT NULL", "hashes"))
def l3_backfill(spark, d):
    """Only files whose hash is missing or of another size or time are hashed again."""
    known = corpus.hashes(spark, d).select(F.col("file_id").alias("id"), "size_bytes", F.col("mtime"))
    rows, k = files(spark, d).alias("f"), known.alias("h")
    fresh = (F.col("f.id") == F.col("h.id")) & (F.col("f.size_bytes") == F.col("h.size_bytes")) & F.col("f.modified_at").eqNullSafe(F.col("h.mtime"))
    return rows.join(k, fresh, "left_anti").filter("content_text is not null").select("id", F.sha2("content_text", 256).alias("digest"))


_FAMILIES = f"""{_MARKERS}, stems AS (SELECT *, {names.version_stem_sql('filename')} AS stem, regexp_matches(lower(filename), '(?:^|[\\s_\\-.(\\[{{])(?:{'|'.join(names.VERSION_WORDS)})(?:[\\s_\\-.)\\]}}]|$)') AS word FROM markers WHERE {ACTIVE} AND document_kind = 'PHYSICAL_FILE'),
groups AS (SELECT coalesce(parent_dir, '') AS folder, stem, count(*) AS members, CASE WHEN count(kind) >= 2 THEN 'HIGH' WHEN bool_or(word) THEN 'MEDIUM' ELSE 'UNORDERED' END AS confidence FROM stems WHERE stem <> '' GROUP BY 1, 2 HAVING count(*) >= 2),
families AS (SELECT id, 'version:' || substr(sha1(folder || '|' || g.stem), 1, 16) AS family, folder, g.stem, members, confidence, row_number() OVER w - 1 AS rank, row_number() OVER w = members AS is_primary
  FROM stems s JOIN groups g ON g.folder = coalesce(s.parent_dir, '') AND g.stem = s.stem
  WINDOW w AS (PARTITION BY folder, g.stem ORDER BY CASE WHEN confidence = 'HIGH' AND kind IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN confidence = 'HIGH' THEN kind END NULLS FIRST, CASE WHEN confidence = 'HIGH' THEN replace(value, '-', '')::BIGINT END NULLS FIRST, coalesce(strftime(modified_at, '{STAMP}'), ''), id))""".replace("\\\\", "\\")


def version_table(spark, d):
    rows = files(spark, d).filter(store.active() & (F.col("document_kind") == "PHYSICAL_FILE"))
    return families.version_families(rows, "parent_dir", "filename", "id", "modified_at")


@query(sql(f"WITH {_FAMILIES} SELECT * FROM families"))
def l10_version_families(spark, d):
    return version_table(spark, d)


@query(sql(f"WITH {_FAMILIES} SELECT f.id, m.id AS member, m.rank, m.is_primary FROM families f JOIN families m ON m.family = f.family WHERE f.id <> m.id"))
def l11_family_of_file(spark, d):
    rows = version_table(spark, d).select("family", "id", "rank", "is_primary")
    return rows.select("family", "id").join(rows.select("family", F.col("id").alias("member"), "rank", "is_primary"), "family").filter("id != member").select("id", "member", "rank", "is_primary")


@query(sql("SELECT id, other FROM (SELECT a.file_id AS id, b.file_id AS other, row_number() OVER (PARTITION BY a.file_id ORDER BY b.file_id) AS place FROM hashes a JOIN hashes b ON a.digest = b.digest AND a.file_id <> b.file_id WHERE a.state = 'OK' AND b.state = 'OK') WHERE place <= 50", "hashes"))
def l12_duplicates_of(spark, d):
    """At most fifty copies of every file, by identifier. A copy's rank in its group decides, so a group forms no pairs beyond them."""
    rows = corpus.hashes(spark, d).filter("state = 'OK' and digest is not null").select("digest", "file_id")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("file_id"))).filter("place <= 51").select("digest", F.col("file_id").alias("other"))
    pairs = rows.join(first, "digest").filter("file_id != other")
    return relational.top_per_group(pairs, "file_id", [F.col("other")], 50).select(F.col("file_id").alias("id"), "other")


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis'), '<(?:br|p|div|li|tr|h1|h2|h3|h4)(?:\s[^>]*|/)?>', chr(10), 'gi').regexp_replace('<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)),
lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), chr(10)) AS body FROM pages""")
def a24_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_text(F.col("html")).alias("body"))
