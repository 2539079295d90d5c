"""Queries of search, duplicates, relations, timeline, priority, clusters and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import names, scores
from foliant.functions import text as t
from foliant.functions.vectors import cosine
from foliant.operators import families, graph, relational, search, store, vectors
from foliant.operators.scratch import cut, in_order
from foliant.plans import corpus
from foliant.plans.corpus import ACTIVE, NOW, files, hashes, sql
from foliant.plans.queries import _COS, _TERMS, query, table
from foliant.plans.texts import _CATEGORIES, _FAMILIES, _MARKERS, k19_categories, version_table

DIMS = 64
_WORDS = r"regexp_extract_all(lower(coalesce(content_text, '')), '[\p{L}\p{N}_]+')"
_RANK = names.RANK_SQL


def _tf(i: int, k1b: str = "1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)") -> str:
    return f"ln((docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE) + 1) * t{i} * 2.2::DOUBLE / (t{i} + {k1b})"


_FULL = f"""words AS (SELECT id, {_WORDS} AS w FROM files),
counts AS (SELECT id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: starts_with(x, 're')))::DOUBLE AS t0, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::DOUBLE AS t1 FROM words),
stats AS (SELECT count(*)::DOUBLE AS docs, avg(len) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM counts),
found AS (SELECT id, round({_tf(0)} + {_tf(1)}, 6) AS score FROM counts, stats WHERE t0 > 0 AND t1 > 0)"""

# --- search ---------------------------------------------------------------------------------------------


def _full_text(spark, d):
    return search.full_text(files(spark, d, True), search.parse_query('"of the" re'), "id", "content_text")


@query(sql(f"WITH {_FULL} SELECT id, score, row_number() OVER (ORDER BY score DESC, {_RANK}, modified_at DESC NULLS LAST, id) AS place FROM found JOIN files USING (id) WHERE {ACTIVE} AND file_type IN ('document', 'code', 'other') QUALIFY place <= 50"))
def d2_full_text(spark, d):
    """A phrase and a prefix, filtered; by score, priority, time and identifier."""
    rows = files(spark, d).filter(store.active() & F.col("file_type").isin("document", "code", "other")).select("id", names.priority_rank(F.col("priority")).alias("rank"), "modified_at")
    order = [F.desc("score"), F.col("rank"), F.desc_nulls_last("modified_at"), F.col("id")]
    best = _full_text(spark, d).join(rows, "id").orderBy(*order).limit(50)
    return best.select("id", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(sql(f"SELECT id FROM files WHERE {ACTIVE} AND lang = 'fr' ORDER BY {_RANK}, modified_at DESC NULLS LAST, id LIMIT 100"))
def d4_filter_only(spark, d):
    return files(spark, d).filter(store.active() & (F.col("lang") == "fr")).orderBy(names.priority_rank(F.col("priority")), F.desc_nulls_last("modified_at"), "id").limit(100).select("id")


def search_files(spark, rows, text: str | None, limit: int = 100):
    """The canonical entry: without a usable query the filters alone, else full text; a query without words falls back to a
    substring of name, path or text."""
    ranked = rows.filter(store.active()).withColumn("rank", names.priority_rank(F.col("priority")))
    parsed = search.parse_query(text) if text and text.strip() else None
    if parsed:
        ranked = ranked.join(search.full_text(rows, parsed, "id", "content_text"), "id")
    elif text and text.strip():
        hit = reduce(lambda a, c: a | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.strip().lower())), ("filename", "path", "content_text"), F.lit(False))
        ranked = ranked.filter(hit).withColumn("score", F.lit(0.0))
    else:
        ranked = ranked.withColumn("score", F.lit(0.0))
    return ranked.orderBy(F.desc("score"), "rank", F.desc_nulls_last("modified_at"), "id").limit(limit).select("id", "score")


_D5 = f"SELECT '{{k}}' AS kind, id, score FROM (SELECT files.id, {{s}} AS score FROM files {{j}} WHERE {ACTIVE} {{w}} ORDER BY score DESC, {_RANK}, modified_at DESC NULLS LAST, files.id LIMIT 30)"


@query(sql(f"""WITH {_FULL}, {_FULL.replace('found AS', 'unused AS').replace('words AS', 'w2 AS').replace('FROM words', 'FROM w2').replace('counts AS', 'c2 AS').replace('FROM counts', 'FROM c2').replace('stats AS', 's2 AS').replace(', stats', ', s2')}
{_D5.format(k='words', s='score', j='JOIN found ON found.id = files.id', w='')} UNION ALL {_D5.format(k='empty', s='0.0', j='', w='')}
UNION ALL {_D5.format(k='signs', s='0.0', j='', w="AND (contains(lower(filename), '%%%') OR contains(lower(path), '%%%') OR contains(lower(content_text), '%%%'))")}"""))
def d5_search_files(spark, d):
    rows = files(spark, d)
    one = lambda kind, text: search_files(spark, rows, text, 30).select(F.lit(kind).alias("kind"), "id", "score")
    return one("words", '"of the" re').unionByName(one("empty", "  ")).unionByName(one("signs", "%%%"))


@query(f"WITH {_TERMS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf FROM p GROUP BY 1")
def d6_postings(spark, d):
    """The inverted index, summed by term."""
    return search.postings(table(spark, d, "documents").select("doc_id", "text")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query(rf"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'replaced text of ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3), w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2) SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS words FROM p GROUP BY 1""")
def d7_index_sync(spark, d):
    """The index after some documents were changed and some removed equals that of the new texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = docs.filter("doc_id % 5 = 1 and doc_id % 7 != 3").select("doc_id", F.concat(F.lit("replaced text of "), F.col("doc_id").cast("string")).alias("text"))
    index = search.updated_index(search.postings(docs), changed, docs.filter("doc_id % 7 = 3"))
    return index.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


_SORTS = {"name": "filename, id", "size": "size_bytes DESC, id", "date": "modified_at DESC NULLS LAST, id", "relevance": "CASE WHEN contains(lower(filename), 'report') THEN 0 ELSE 1 END, filename, id"}


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS sort, id, place FROM (SELECT id, row_number() OVER (ORDER BY {o}) AS place FROM files) WHERE place <= 20" for k, o in _SORTS.items())))
def d8_sort_keys(spark, d):
    rows = files(spark, d).select("id", "filename", "size_bytes", "modified_at")
    orders = {"name": ["filename", "id"], "size": [F.desc("size_bytes"), "id"], "date": [F.desc_nulls_last("modified_at"), "id"], "relevance": [F.when(F.contains(F.lower("filename"), F.lit("report")), 0).otherwise(1), "filename", "id"]}
    parts = [rows.orderBy(*o).limit(20).select(F.lit(k).alias("sort"), "id", F.row_number().over(Window.orderBy(*o)).alias("place")) for k, o in orders.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT count(*) AS total, 3 AS page, ((count(*) + 25 - 1) // 25)::BIGINT AS total_pages FROM documents")
def d10_page_metadata(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("total")).select("total", F.lit(50 // 25 + 1).alias("page"), F.floor((F.col("total") + 24) / 25).alias("total_pages"))


# Families of legal terms, and the extensions that a legal search covers, by rank.
LEGAL = {
    "contracts": ["contract", "contrat", "vertrag", "overeenkomst", "договор"],
    "loans": ["loan", "prêt", "crédit", "lening", "darlehen", "кредит"],
    "agreements": ["agreement", "accord", "vereinbarung", "overeenkomst", "соглашение"],
    "property": ["property", "propriété", "immobilier", "eigendom", "immobilie", "недвижимость"],
    "sale": ["sale", "vente", "verkauf", "verkoop", "продажа"],
    "purchase": ["purchase", "achat", "kauf", "aankoop", "покупка"],
    "notary": ["notary", "notaire", "notar", "notaris", "нотариус"],
    "deed": ["deed", "acte", "urkunde", "akte", "акт"],
    "invoice": ["invoice", "facture", "rechnung", "factuur", "счет"],
    "payment": ["payment", "paiement", "zahlung", "betaling", "платеж"],
}
LEGAL_RANK = {1: (".pdf", ".doc", ".docx"), 2: (".msg", ".eml"), 3: (".rtf", ".txt")}


def legal_terms(text: str) -> list[str]:
    """The query and all words of the families of which it holds one."""
    low = text.lower()
    return sorted({text, *(w for ws in LEGAL.values() if any(x in low for x in ws) for w in ws)})


_PROBE = "tion"
_LEGAL_HIT = " OR ".join(f"contains(lower({c}), '{w}')" for w in legal_terms(_PROBE) for c in ("filename", "path", "content_text"))
_OCCURS = f"(length(lower(content_text)) - length(replace(lower(content_text), '{_PROBE}', ''))) // {len(_PROBE)}"
_LEGAL_SCORE = f"""(CASE WHEN extension IN ('.pdf', '.doc', '.docx') THEN 10 WHEN extension IN ('.msg', '.eml') THEN 8 ELSE 0 END + CASE WHEN contains(lower(filename), '{_PROBE}') THEN 20 ELSE 0 END
 + CASE WHEN contains(lower(content_text), '{_PROBE}') THEN 15 + least({_OCCURS} * 2, 10) ELSE 0 END + CASE WHEN contains(lower(filename), 'de') THEN 15 ELSE 0 END + CASE WHEN contains(lower(content_text), 'de') THEN 10 ELSE 0 END + """ + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(content_text), '{w}')" for w in ws) + " THEN 5 ELSE 0 END" for ws in LEGAL.values()) + ")"


def legal_score(text: str, people: list[str]):
    low, name = F.lower(F.coalesce("content_text", F.lit(""))), F.lower("filename")
    has = lambda c, w: F.contains(c, F.lit(w.lower()))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    count = F.floor((F.length(low) - F.length(F.replace(low, F.lit(text)))) / len(text))
    out = F.when(F.col("extension").isin(*LEGAL_RANK[1]), 10).when(F.col("extension").isin(*LEGAL_RANK[2]), 8).otherwise(0)
    out = out + points(has(name, text), 20) + F.when(has(low, text), 15 + F.least(count * 2, F.lit(10))).otherwise(0)
    for p in people:
        out = out + points(has(name, p), 15) + points(has(low, p), 10)
    for ws in LEGAL.values():
        out = out + points(reduce(lambda a, w: a | has(low, w), ws, F.lit(False)), 5)
    return out


@query(sql(f"SELECT id, {_LEGAL_SCORE}::BIGINT AS relevance FROM files WHERE extension IN ('.pdf', '.doc', '.docx', '.rtf', '.msg', '.eml', '.txt') AND ({_LEGAL_HIT}) ORDER BY relevance DESC, CASE WHEN extension IN ('.pdf', '.doc', '.docx') THEN 1 WHEN extension IN ('.msg', '.eml') THEN 2 ELSE 3 END, modified_at DESC NULLS LAST, id LIMIT 100"))
def d11_legal_search(spark, d):
    """Documents of legal kinds that hold the query or a translation, by relevance."""
    hit = reduce(lambda a, w: a | reduce(lambda b, c: b | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)), ("filename", "path", "content_text"), F.lit(False)), legal_terms(_PROBE), F.lit(False))
    rank = F.when(F.col("extension").isin(*LEGAL_RANK[1]), 1).when(F.col("extension").isin(*LEGAL_RANK[2]), 2).otherwise(3)
    rows = files(spark, d).filter(F.col("extension").isin(*[x for xs in LEGAL_RANK.values() for x in xs]) & hit)
    rows = rows.select("id", legal_score(_PROBE, ["de"]).cast("long").alias("relevance"), rank.alias("rank"), "modified_at")
    return rows.orderBy(F.desc("relevance"), "rank", F.desc_nulls_last("modified_at"), "id").limit(100).select("id", "relevance")


@query("SELECT DISTINCT unnest([" + ", ".join(f"'{w}'" for w in legal_terms("Facture et paiement")) + "]) AS term")
def d12_legal_terms(spark, d):
    families_ = spark.createDataFrame([(ws,) for ws in LEGAL.values()], "words array<string>")
    asked = F.lit("Facture et paiement")
    hit = families_.filter(F.exists("words", lambda w: F.contains(F.lower(asked), w))).select(F.explode("words").alias("term"))
    return hit.unionByName(spark.range(1).select(asked.alias("term"))).distinct()


@query(sql(f"SELECT id, {_LEGAL_SCORE.replace('lower(content_text)', 'lower(coalesce(content_text, $$$$))')}::BIGINT AS relevance FROM files"))
def d13_legal_relevance(spark, d):
    return files(spark, d).select("id", legal_score(_PROBE, ["de"]).cast("long").alias("relevance"))


@query(sql("SELECT b.id FROM files a JOIN files b ON b.id <> a.id AND (b.parent_dir = a.parent_dir OR (length(string_split(regexp_replace(a.filename, '\\.[^.]*$', ''), '_')[1]) > 3 AND contains(lower(b.filename), lower(string_split(regexp_replace(a.filename, '\\.[^.]*$', ''), '_')[1])))) WHERE a.id = 7 ORDER BY b.modified_at DESC NULLS LAST, b.id LIMIT 10".replace("\\\\", "\\")))
def d15_related_by_name(spark, d):
    """Files of the same folder, or whose name holds the first long part of the name."""
    rows = files(spark, d)
    part = F.element_at(F.split(F.regexp_replace("filename", r"\.[^.]*$", ""), "_"), 1)
    probe = rows.filter("id = 7").select(F.col("parent_dir").alias("folder"), F.when(F.length(part) > 3, F.lower(part)).alias("part"))  # one row
    near = rows.crossJoin(F.broadcast(probe)).filter((F.col("id") != 7) & ((F.col("parent_dir") == F.col("folder")) | F.contains(F.lower("filename"), F.col("part"))))
    return near.orderBy(F.desc_nulls_last("modified_at"), "id").limit(10).select("id")


_SIM = f"v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT e FROM v WHERE vec_id = 5), sims AS (SELECT a.vec_id, round(coalesce({_COS}, 0), 5) AS sim FROM v a, p b)"


def _similar(spark, d, probe: int = 5):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    one = rows.filter(F.col("vec_id") == probe).select(F.col("embedding").alias("probe"))  # one row
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 5).alias("sim"))


_LIVE = f"SELECT id FROM files WHERE {ACTIVE} AND length(content_text) > 50"


def _live(spark, d):
    return files(spark, d).filter(store.active() & (F.length("content_text") > 50)).select("id")


@query(sql(f"WITH {_SIM} SELECT vec_id AS id, sim AS similarity FROM sims WHERE sim >= 0.3 AND vec_id IN ({_LIVE}) ORDER BY sim DESC, vec_id LIMIT 20"))
def d17_semantic_search(spark, d):
    """The most similar active documents from the threshold on; the limit counts what is left after the filters."""
    rows = _similar(spark, d).filter("sim >= 0.3").join(_live(spark, d).withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    return rows.orderBy(F.desc("sim"), "vec_id").limit(20).select(F.col("vec_id").alias("id"), F.col("sim").alias("similarity"))


@query(sql(f"WITH {_SIM} SELECT vec_id AS id, sim AS similarity FROM sims WHERE sim >= 0.3 AND vec_id <> 5 ORDER BY sim DESC, vec_id LIMIT 20"))
def d18_by_embedding(spark, d):
    return _similar(spark, d).filter("sim >= 0.3 and vec_id != 5").orderBy(F.desc("sim"), "vec_id").limit(20).select(F.col("vec_id").alias("id"), F.col("sim").alias("similarity"))


@query(sql(f"WITH {_SIM} SELECT vec_id AS id, sim AS similarity FROM sims WHERE sim >= 0.5 AND vec_id <> 5 ORDER BY sim DESC, vec_id LIMIT 10"))
def d19_similar_documents(spark, d):
    return _similar(spark, d).filter("sim >= 0.5 and vec_id != 5").orderBy(F.desc("sim"), "vec_id").limit(10).select(F.col("vec_id").alias("id"), F.col("sim").alias("similarity"))


@query(sql(f"""WITH {_SIM}, {_FULL}, s AS (SELECT vec_id AS id, sim FROM sims WHERE sim >= 0.3 ORDER BY sim DESC, vec_id LIMIT 40), x AS (SELECT id FROM found ORDER BY score DESC, id LIMIT 40),
y AS (SELECT id, CASE WHEN contains(lower(filename), 're') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN len(w) > 0 THEN least(1.0::DOUBLE, 10 * ((length(lower(content_text)) - length(replace(lower(content_text), 're', ''))) / 2.0::DOUBLE) / len(w)) ELSE 0 END AS text FROM x JOIN files USING (id) JOIN (SELECT id, regexp_extract_all(lower(coalesce(content_text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM files) USING (id))
SELECT coalesce(s.id, y.id) AS id, round(0.7::DOUBLE * coalesce(sim, 0) + 0.3::DOUBLE * coalesce(text, 0), 6) AS score FROM s FULL JOIN y ON s.id = y.id ORDER BY score DESC, id LIMIT 20""".replace("\\\\", "\\")))
def d20_hybrid_search(spark, d):
    """0.7 of the cosine and 0.3 of the text score, over the union of both results."""
    semantic = _similar(spark, d).filter("sim >= 0.3").orderBy(F.desc("sim"), "vec_id").limit(40).select(F.col("vec_id").alias("id"), "sim")
    best = _full_text(spark, d).orderBy(F.desc("score"), "id").limit(40).select("id")
    lexical = files(spark, d).join(best, "id", "left_semi").select("id", scores.text_score("re", F.col("filename"), F.col("content_text")).alias("text"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return semantic.join(lexical, "id", "full_outer").select("id", F.round(0.7 * none("sim") + 0.3 * none("text"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 4 THEN NULL ELSE embedding::DOUBLE[] END AS e FROM embeddings), p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 2) SELECT vec_id, round(coalesce({_COS}, 0), 5) AS similarity FROM v a, p b WHERE a.e IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 10")
def d22_find_similar(spark, d):
    """Top ten by cosine; rows without a vector are left out."""
    rows = table(spark, d, "embeddings")
    probe = rows.filter("vec_id = 2").select("embedding")
    return vectors.nearest(rows.filter("vec_id % 9 != 4"), probe, "vec_id", "embedding", 10)


_FUSION = f"""x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS p1 FROM found QUALIFY p1 <= 60), y AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sim DESC, vec_id) AS p2 FROM sims WHERE vec_id IN (SELECT id FROM files) QUALIFY p2 <= 60),
m AS (SELECT coalesce(x.id, y.id) AS id, p1, p2 FROM x FULL JOIN y ON x.id = y.id),
b AS (SELECT m.*, round(coalesce(1.0::DOUBLE / (60 + p1), 0) + coalesce(1.0::DOUBLE / (60 + p2), 0) + CASE WHEN contains(lower(filename) || ' ' || lower(path), 're') AND contains(lower(filename) || ' ' || lower(path), 'of') THEN 0.5::DOUBLE ELSE 0 END, 8) AS score, digest, family FROM m JOIN files USING (id) LEFT JOIN hashes h ON h.file_id = m.id AND h.state = 'OK' LEFT JOIN families USING (id)),
u AS (SELECT * FROM b QUALIFY digest IS NULL OR row_number() OVER (PARTITION BY digest ORDER BY score DESC, coalesce(p1, 1000000000), coalesce(p2, 1000000000), id) = 1),
w9 AS (SELECT * FROM u QUALIFY family IS NULL OR row_number() OVER (PARTITION BY family ORDER BY score DESC, coalesce(p1, 1000000000), coalesce(p2, 1000000000), id) = 1)"""


def _exact_titles(rows, words):
    hay = F.concat_ws(" ", F.lower("filename"), F.lower("path"))
    return rows.filter(reduce(lambda a, w: a & F.contains(hay, F.lit(w)), words, F.lit(True))).select("id")


@query(sql(f"WITH {_SIM}, {_FULL}, {_FAMILIES.replace('WITH ', '')}, {_FUSION} SELECT id, p1, p2, score, row_number() OVER (ORDER BY score DESC, coalesce(p1, 1000000000), coalesce(p2, 1000000000), id) AS place FROM w9 QUALIFY place <= 20", "hashes"))
def d24_fused_results(spark, d):
    """Two rankings fused, with the bonus for exact names; one of each content and version family stays."""
    rows = files(spark, d)
    lexical = search.top(_full_text(spark, d), "score", "id", 60)
    semantic = search.top(_similar(spark, d).withColumnRenamed("vec_id", "id").join(rows.select("id"), "id", "left_semi"), "sim", "id", 60)
    digests = hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest")
    return search.fused(lexical, semantic, "id", _exact_titles(rows, ["re", "of"]), digests, version_table(spark, d).select("id", "family"))


@query(sql("SELECT id FROM files WHERE contains(lower(filename) || ' ' || lower(path), 'invoice') AND contains(lower(filename) || ' ' || lower(path), 'src')"))
def d25_exact_title(spark, d):
    return _exact_titles(files(spark, d), ["invoice", "src"])


@query(sql(f"WITH {_FULL} SELECT id, score FROM found JOIN files USING (id) WHERE {ACTIVE} AND lang = 'en' AND id NOT IN (SELECT file_id FROM pii WHERE severity = 'high') AND id IN (SELECT file_id FROM pii) ORDER BY score DESC, id LIMIT 50", "pii"))
def d27_search_with_findings(spark, d):
    """Full text among documents of a language that hold personal data, but none of high severity."""
    found = corpus.pii(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.max(F.col("severity") == "high").alias("high")).filter("not high")
    rows = files(spark, d).filter(store.active() & (F.col("lang") == "en")).select("id").join(found, "id", "left_semi")
    return _full_text(spark, d).join(rows, "id", "left_semi").orderBy(F.desc("score"), "id").limit(50)


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), row_number() OVER (ORDER BY count(*) DESC, source) FROM documents GROUP BY source")
def d28_facets(spark, d):
    """Values of each facet by frequency."""
    rows = store.facets(table(spark, d, "documents"), ["lang", "source"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc_nulls_last("value"))))


@query(rf"""WITH {_TERMS}, q AS (SELECT doc_id AS target, (SELECT min(x) FROM (SELECT unnest(w) AS x) WHERE length(x) >= 8) AS term FROM w WHERE doc_id % 20 = 0), h AS (SELECT q.target, q.term, w.doc_id, len(list_filter(w, lambda x: x = q.term))::DOUBLE / len(w) AS s FROM q JOIN w ON list_contains(w, q.term)),
r AS (SELECT target, doc_id, row_number() OVER (PARTITION BY target ORDER BY s DESC, doc_id) AS place FROM h), f AS (SELECT q.target, r.place FROM q LEFT JOIN r ON r.target = q.target AND r.doc_id = q.target WHERE term IS NOT NULL)
SELECT round(avg((coalesce(place <= 5, false))::INTEGER), 6) AS recall_5, round(avg((coalesce(place <= 10, false))::INTEGER), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM f""")
def d31_retrieval_quality(spark, d):
    """Recall and mean reciprocal rank of finding documents by one of their long words."""
    rows = search.postings(table(spark, d, "documents").select("doc_id", "text"))
    rows = cut(rows, "postings")
    probes = rows.filter((F.col("doc_id") % 20 == 0) & (F.length("term") >= 8)).groupBy(F.col("doc_id").alias("target")).agg(F.min("term").alias("term"))
    hits = rows.join(probes, "term").withColumn("s", F.col("tf") / F.col("len"))
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("s"), "doc_id"))).filter("doc_id = target").select("target", "place")
    found = search.retrieval_metrics(probes.join(placed, "target", "left"), "target", "place")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# --- relations ------------------------------------------------------------------------------------------

MOST = 20


def _edges(df, kind: str, score):
    return df.select(F.lit(kind).alias("type"), "src", "dst", score.alias("score"))


def _sql_neighbours(table_: str, by: str, order: str, extra: str = "") -> str:
    """SQL: each row with the first others of its group."""
    return f"(SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id, {', '.join(f'a.{c.strip()}' for c in by.split(','))} ORDER BY {order}) AS n FROM {table_} a JOIN {table_} b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND a.id <> b.id{extra}) WHERE n <= {MOST})"


_ACT = f"act AS (SELECT *, CASE WHEN {ACTIVE} THEN parent_dir END AS pd FROM files WHERE {ACTIVE}), okh AS (SELECT file_id AS id, digest FROM hashes WHERE state = 'OK' AND digest IS NOT NULL AND file_id IN (SELECT id FROM act)), ft AS (SELECT file_id AS id, tag_id FROM file_tags WHERE file_id IN (SELECT id FROM act))"
_EXACT_SQL = f"SELECT 'EXACT_DUPLICATE' AS type, src, dst, 1.0::DOUBLE AS score FROM {_sql_neighbours('okh', 'digest', 'b.id')}"
_PATH_SQL = f"SELECT 'PATH_CONTEXT' AS type, src, dst, 0.3::DOUBLE AS score FROM {_sql_neighbours('act', 'pd', 'b.modified_at DESC NULLS LAST, b.id')}"
_TAG_SQL = f"SELECT DISTINCT 'USER_TAG' AS type, src, dst, 1.0::DOUBLE AS score FROM {_sql_neighbours('ft', 'tag_id', 'b.id')}"
_ARCHIVE_SQL = "SELECT 'ARCHIVE_CONTAINS' AS type, archive_parent_id AS src, id AS dst, 1.0::DOUBLE AS score FROM act WHERE archive_parent_id IS NOT NULL"
_LANG_SQL = f"SELECT 'SAME_LANGUAGE' AS type, src, dst, 0.9::DOUBLE AS score FROM {_sql_neighbours('act', 'lang', 'b.id')}"


def _active_files(spark, d):
    return files(spark, d).filter(store.active())


@query(sql(f"WITH {_ACT} {_EXACT_SQL}", "hashes", "file_tags"))
def m2_exact_duplicate(spark, d):
    rows = hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest").join(_active_files(spark, d).select("id"), "id", "left_semi")
    return _edges(graph.neighbours(rows, ["digest"], "id", [F.col("id")], MOST), "EXACT_DUPLICATE", F.lit(1.0))


@query()
def m3_near_duplicate(spark, d):
    return l7_near_duplicates(spark, d).select(F.lit("NEAR_DUPLICATE").alias("type"), "src", "dst", F.coalesce("semantic", F.lit(0.0)).alias("score"))


@query(sql(f"WITH {_FAMILIES} SELECT 'VERSION_OF' AS type, a.id AS src, b.id AS dst, 0.8::DOUBLE AS score, b.rank FROM families a JOIN families b ON a.family = b.family AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.rank) <= {MOST}"))
def m4_version_of(spark, d):
    """The first members of a file's version family by rank."""
    rows = cut(version_table(spark, d).select("id", "family", "rank"), "versions")
    pairs = graph.neighbours(rows, ["family"], "id", [F.col("rank")], MOST)
    return _edges(pairs, "VERSION_OF", F.lit(0.8)).join(rows.select(F.col("id").alias("dst"), "rank"), "dst").select("type", "src", "dst", "score", "rank")


@query(sql(f"WITH {_ACT} {_ARCHIVE_SQL}", "hashes", "file_tags"))
def m5_archive_contains(spark, d):
    rows = _active_files(spark, d).filter("archive_parent_id is not null").select(F.col("archive_parent_id").alias("src"), F.col("id").alias("dst"))
    return _edges(rows, "ARCHIVE_CONTAINS", F.lit(1.0))


@query(sql(f"WITH p AS (SELECT file_id AS id, pii_type || ':' || fingerprint AS entity FROM pii WHERE file_id IN (SELECT id FROM files WHERE {ACTIVE})) SELECT DISTINCT 'SAME_ENTITY' AS type, src, dst, 0.95::DOUBLE AS score FROM {_sql_neighbours('p', 'entity', 'b.id')}", "pii"))
def m6_same_entity(spark, d):
    rows = corpus.pii(spark, d).select(F.col("file_id").alias("id"), F.concat_ws(":", "pii_type", "fingerprint").alias("entity")).join(_active_files(spark, d).select("id"), "id", "left_semi")
    return _edges(graph.neighbours(rows, ["entity"], "id", [F.col("id")], MOST).select("src", "dst").distinct(), "SAME_ENTITY", F.lit(0.95))


@query(sql(f"WITH {_CATEGORIES}, c AS (SELECT id, category, score FROM categories WHERE source <> 'structural' AND id IN (SELECT id FROM files WHERE {ACTIVE})) SELECT DISTINCT 'SAME_CATEGORY' AS type, src, dst FROM {_sql_neighbours('c', 'category', 'b.score DESC, b.id')}"))
def m7_same_category(spark, d):
    rows = k19_categories(spark, d).filter("source != 'structural'").join(_active_files(spark, d).select("id"), "id", "left_semi")
    return graph.neighbours(rows, ["category"], "id", [F.desc("score"), F.col("id")], MOST).select(F.lit("SAME_CATEGORY").alias("type"), "src", "dst").distinct()


@query(sql(f"WITH {_ACT} {_LANG_SQL}", "hashes", "file_tags"))
def m8_same_language(spark, d):
    return _edges(graph.neighbours(_active_files(spark, d).select("id", "lang"), ["lang"], "id", [F.col("id")], MOST), "SAME_LANGUAGE", F.lit(0.9))


@query(sql(f"WITH {_ACT} {_PATH_SQL}", "hashes", "file_tags"))
def m9_path_context(spark, d):
    rows = _active_files(spark, d).select("id", "parent_dir", "modified_at")
    return _edges(graph.neighbours(rows, ["parent_dir"], "id", [F.desc_nulls_last("modified_at"), F.col("id")], MOST), "PATH_CONTEXT", F.lit(0.3))


_TEMPORAL = f"WITH t AS (SELECT id, epoch(modified_at)::BIGINT AS s, row_number() OVER (ORDER BY modified_at, id) AS pos FROM files WHERE {ACTIVE} AND modified_at IS NOT NULL) SELECT a.id AS src, b.id AS dst, round(greatest(0, 1 - abs(a.s - b.s) / 86400.0::DOUBLE), 6) AS score FROM t a JOIN t b ON abs(a.pos - b.pos) BETWEEN 1 AND 10 AND abs(a.s - b.s) <= 86400"


@query(sql(_TEMPORAL))
def m10_temporal_proximity(spark, d):
    """Files changed within a day of each other, ten on either side at most in the order of time; nearer ones score higher. Places in
    time come from sorted ranges, so a crowded day forms ten pairs a file and no more."""
    rows = _active_files(spark, d).filter("modified_at is not null").select("id", F.unix_seconds("modified_at").alias("s"))
    at = in_order(rows, [F.col("s"), F.col("id")])
    ahead = at.select(F.col("id").alias("other"), F.col("s").alias("then"), F.explode(F.sequence(F.col("place") - 10, F.col("place") + 10)).alias("place"))
    near = at.join(ahead, "place").filter("id != other and abs(s - then) <= 86400")
    return near.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("s") - F.col("then")) / 86400.0), 6).alias("score"))


@query(sql(f"WITH {_ACT} {_TAG_SQL}", "hashes", "file_tags"))
def m11_user_tag(spark, d):
    rows = corpus.file_tags(spark, d).select(F.col("file_id").alias("id"), "tag_id").join(_active_files(spark, d).select("id"), "id", "left_semi")
    return _edges(graph.neighbours(rows, ["tag_id"], "id", [F.col("id")], MOST).select("src", "dst").distinct(), "USER_TAG", F.lit(1.0))


@query(sql(f"WITH v AS (SELECT file_id AS id, 1 AS one FROM favourites) SELECT 'FAVORITE' AS type, src, dst, 1.0::DOUBLE AS score FROM {_sql_neighbours('v', 'one', 'b.id')}", "favourites"))
def m12_favourite(spark, d):
    rows = corpus.favourites(spark, d).select(F.col("file_id").alias("id"), F.lit(1).alias("one"))
    return _edges(graph.neighbours(rows, ["one"], "id", [F.col("id")], MOST), "FAVORITE", F.lit(1.0))


@query(f"SELECT 'EMAIL_REPLY_TO' AS type, a.conv_id, a.turn AS src, b.turn AS dst, 1.0::DOUBLE AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn) <= {MOST}")
def m13_email_reply(spark, d):
    """Messages of one thread; directed from each to the others, the first ones in their order."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    pairs = graph.neighbours(rows, ["conv_id"], "turn", [F.col("turn")], MOST)
    return pairs.select(F.lit("EMAIL_REPLY_TO").alias("type"), "conv_id", "src", "dst", F.lit(1.0).alias("score"))


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(coalesce({_COS}, 0), 5) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM s QUALIFY place <= 10")
def m14_semantic_related(spark, d):
    """The ten most similar others of every vector, exactly."""
    rows = vectors.nearest_of_all(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS, 10)
    return rows.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("similarity").alias("score"), "place")


_ALL_SQL = f"{_EXACT_SQL} UNION ALL {_PATH_SQL} UNION ALL {_TAG_SQL} UNION ALL {_ARCHIVE_SQL}"


def _all_edges(spark, d):
    return m2_exact_duplicate(spark, d).unionByName(m9_path_context(spark, d)).unionByName(m11_user_tag(spark, d)).unionByName(m5_archive_contains(spark, d))


@query(sql(f"WITH {_ACT} {_ALL_SQL}", "hashes", "file_tags"))
def m1_relations(spark, d):
    """Relations of all files, four types of them, at most twenty a file and type."""
    return _all_edges(spark, d)


@query(sql(f"""WITH {_ACT}, e AS (SELECT DISTINCT src, dst FROM ({_ALL_SQL})), d0 AS (SELECT 1::BIGINT AS id, 0 AS depth), d1 AS (SELECT DISTINCT dst AS id, 1 AS depth FROM e WHERE src = 1 AND dst <> 1 ORDER BY id LIMIT 49),
d2 AS (SELECT DISTINCT dst AS id, 2 AS depth FROM e WHERE src IN (SELECT id FROM d1) AND dst NOT IN (SELECT id FROM d1) AND dst <> 1) SELECT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) ORDER BY depth, id LIMIT 50""", "hashes", "file_tags"))
def m15_neighbourhood(spark, d):
    """At most fifty files within two steps of a file, nearest first."""
    edges = cut(_all_edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "edges")
    return graph.reached(edges, spark.createDataFrame([(1,)], "id long"), 2, 50)


@query(sql("WITH n AS (SELECT pii_type, fingerprint, count(*) AS docs FROM pii GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY docs DESC, pii_type, fingerprint LIMIT 200) SELECT 'e:' || p.pii_type || ':' || substr(p.fingerprint, 1, 12) AS source, 'd:' || file_id AS target, docs FROM n JOIN pii p USING (pii_type, fingerprint) ORDER BY docs DESC, source, file_id LIMIT 1000", "pii"))
def m16_entity_graph(spark, d):
    """Values that two documents at least mention, linked with these documents."""
    found = cut(corpus.pii(spark, d), "pii")
    nodes = found.groupBy("pii_type", "fingerprint").agg(F.count("*").alias("docs")).filter("docs >= 2").orderBy(F.desc("docs"), "pii_type", "fingerprint").limit(200)
    edges = found.join(F.broadcast(nodes), ["pii_type", "fingerprint"]).select(F.concat_ws(":", F.lit("e"), "pii_type", F.substring("fingerprint", 1, 12)).alias("source"), F.concat(F.lit("d:"), F.col("file_id").cast("string")).alias("target"), "docs", "file_id")
    return edges.orderBy(F.desc("docs"), "source", "file_id").limit(1000).select("source", "target", "docs")


@query(sql(f"WITH {_ACT}, a AS ({_ALL_SQL}) SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, round(avg(score), 4) AS score FROM a GROUP BY 1", "hashes", "file_tags"))
def m17_relation_statistics(spark, d):
    return _all_edges(spark, d).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.avg("score"), 4).alias("score"))


@query(sql(f"WITH {_ACT}, a AS ({_ALL_SQL}) SELECT src, dst, max(type) AS type, arg_max(score, type) AS score FROM a GROUP BY 1, 2", "hashes", "file_tags"))
def m18_directed_graph(spark, d):
    """Parallel edges collapse; the last type by name wins."""
    return _all_edges(spark, d).groupBy("src", "dst").agg(F.max("type").alias("type"), F.max_by("score", "type").alias("score"))


@query(sql(f"WITH {_ACT}, a AS ({_ALL_SQL}), e AS (SELECT src, dst, arg_max(score, type) AS score FROM a GROUP BY 1, 2) SELECT id, count(*) AS degree, round(sum(w), 6) AS weighted FROM (SELECT src AS id, score AS w FROM e UNION ALL SELECT dst, 0.0 FROM e) GROUP BY 1", "hashes", "file_tags"))
def m19_degrees(spark, d):
    return graph.degrees(m18_directed_graph(spark, d), "src", "dst", "score").select("id", "degree", F.round("weighted", 6).alias("weighted"))


@query(sql(f"WITH {_ACT}, a AS ({_ALL_SQL}), e AS (SELECT DISTINCT src, dst FROM a), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, max(n) AS max_degree, round(avg(n), 3) AS mean_degree FROM g", "hashes", "file_tags"))
def m22_graph_summary(spark, d):
    edges = _all_edges(spark, d).select("src", "dst", F.lit(1.0).alias("w")).distinct()
    by = graph.degrees(edges, "src", "dst", "w")
    return by.agg(F.count("*").alias("nodes"), F.floor(F.sum("degree") / 2).alias("edges"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 3).alias("mean_degree"))


_EVENTS = f"SELECT id, strftime(modified_at, '%Y-%m-%d') AS date, 'modified_at' AS source, 'HIGH' AS confidence FROM files WHERE {ACTIVE} AND modified_at >= TIMESTAMP '2024-02-01' AND modified_at <= TIMESTAMP '2024-10-31' AND lang = 'en' AND id NOT IN (SELECT file_id FROM pii WHERE severity = 'high')"


def _timeline(spark, d):
    at = F.col("modified_at")
    rows = files(spark, d).filter(store.active() & (at >= F.lit("2024-02-01").cast("timestamp")) & (at <= F.lit("2024-10-31").cast("timestamp")) & (F.col("lang") == "en"))
    return rows.join(corpus.pii(spark, d).filter("severity = 'high'").select(F.col("file_id").alias("id")), "id", "left_anti")


@query(sql(f"WITH {_MARKERS} {_EVENTS} UNION ALL SELECT id, value, 'version_date', 'MEDIUM' FROM markers WHERE {ACTIVE} AND kind = 'date'", "pii"))
def m23_timeline_events(spark, d):
    """Dated files with source and confidence: by their time of change, filtered, and by a date in their name."""
    by_time = _timeline(spark, d).select("id", F.date_format("modified_at", "yyyy-MM-dd").alias("date"), F.lit("modified_at").alias("source"), F.lit("HIGH").alias("confidence"))
    named = _active_files(spark, d).select("id", names.version_marker(F.col("filename")).alias("m")).filter("m.kind = 'date'")
    return by_time.unionByName(named.select("id", F.col("m.value").alias("date"), F.lit("version_date").alias("source"), F.lit("MEDIUM").alias("confidence")))


@query(sql("SELECT 'modified_at' AS source, count(modified_at) AS available, 'HIGH' AS confidence FROM files UNION ALL SELECT 'created_at', count(created_at), 'MEDIUM' FROM files UNION ALL SELECT 'indexed_at', count(indexed_at), 'LOW' FROM files"))
def m24_date_sources(spark, d):
    counts = files(spark, d).agg(*[F.count(c).alias(c) for c in ("modified_at", "created_at", "indexed_at")])
    parts = [F.struct(F.lit(c).alias("source"), F.col(c).alias("available"), F.lit(k).alias("confidence")) for c, k in (("modified_at", "HIGH"), ("created_at", "MEDIUM"), ("indexed_at", "LOW"))]
    return counts.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


# Weights of the signals of priority, and the penalty of a version that is not the primary one.
WEIGHTS = {"favorite": 3.0, "user_tag": 2.0, "query_match": 1.5, "entity_match": 1.0, "centrality": 1.0, "category_relevance": 0.5, "recency": 0.5}
PENALTY = 0.5

_SIGNALS = {"favorite": "CASE WHEN v.file_id IS NOT NULL THEN 1.0::DOUBLE END", "user_tag": "CASE WHEN tags > 0 THEN least(1.0::DOUBLE, tags / 3.0::DOUBLE) END", "query_match": "CASE WHEN contains(lower(filename) || ' ' || lower(path), 'report') THEN 1.0::DOUBLE END", "entity_match": "CASE WHEN q.file_id IS NOT NULL THEN 1.0::DOUBLE END", "centrality": "CASE WHEN degree > 0 THEN least(1.0::DOUBLE, ln(1 + degree) / ln(21.0::DOUBLE)) END", "category_relevance": "topic", "recency": f"exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400.0::DOUBLE) / 365)"}


@query(sql(f"""WITH {_CATEGORIES}, {_FAMILIES.replace('WITH ', '')}, t9 AS (SELECT file_id, count(*) AS tags FROM file_tags GROUP BY 1), q AS (SELECT DISTINCT file_id FROM pii WHERE pii_type = 'email'), g9 AS (SELECT id, count(*) OVER (PARTITION BY parent_dir) - 1 AS degree FROM files WHERE parent_dir IS NOT NULL), k9 AS (SELECT id, max(score) AS topic FROM categories WHERE source <> 'structural' GROUP BY 1),
s AS (SELECT f.id, {', '.join(f'{e} AS {k}' for k, e in _SIGNALS.items())}, CASE WHEN m.id IS NOT NULL AND NOT m.is_primary THEN 1.0::DOUBLE ELSE 0 END AS penalty FROM files f LEFT JOIN favourites v ON v.file_id = f.id LEFT JOIN t9 ON t9.file_id = f.id LEFT JOIN q ON q.file_id = f.id LEFT JOIN g9 ON g9.id = f.id LEFT JOIN k9 ON k9.id = f.id LEFT JOIN families m ON m.id = f.id)
SELECT id, round(greatest(0, least(1, coalesce(({' + '.join(f'coalesce({k}, 0) * {w}::DOUBLE' for k, w in WEIGHTS.items())}) / nullif({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for k, w in WEIGHTS.items())}, 0), 0) - penalty * {PENALTY}::DOUBLE)), 4) AS score, (favorite IS NOT NULL OR user_tag IS NOT NULL) AS user_signals FROM s""", "favourites", "file_tags", "pii"))
def m25_priority(spark, d):
    """Weighted signals, normalised by the weights of those present, less a penalty for a version that is not the primary one."""
    rows = files(spark, d).select("id", "filename", "path", "parent_dir", "modified_at")
    one = lambda df, key, name: df.select(F.col(key).alias("id")).distinct().withColumn(name, F.lit(1.0))
    tags = corpus.file_tags(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.least(F.lit(1.0), F.count("*") / 3.0).alias("user_tag"))
    sizes = rows.filter("parent_dir is not null").groupBy("parent_dir").agg((F.count("*") - 1).alias("degree"))
    topic = k19_categories(spark, d).filter("source != 'structural'").groupBy("id").agg(F.max("score").alias("category_relevance"))
    family = version_table(spark, d).select("id", F.when(F.col("is_primary"), 0.0).otherwise(1.0).alias("penalty"))
    rows = rows.join(one(corpus.favourites(spark, d), "file_id", "favorite"), "id", "left").join(tags, "id", "left").join(one(corpus.pii(spark, d).filter("pii_type = 'email'"), "file_id", "entity_match"), "id", "left")
    rows = rows.join(sizes, "parent_dir", "left").join(topic, "id", "left").join(family, "id", "left")
    days = F.greatest(F.lit(0.0), (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds("modified_at")) / 86400.0)
    rows = rows.withColumns({"query_match": F.when(F.contains(F.concat_ws(" ", F.lower("filename"), F.lower("path")), F.lit("report")), 1.0), "centrality": F.when(F.col("degree") > 0, scores.centrality(F.col("degree"))), "recency": scores.recency(days)})
    total = reduce(lambda a, k: a + F.coalesce(k, F.lit(0.0)) * WEIGHTS[k], WEIGHTS, F.lit(0.0))
    weight = reduce(lambda a, k: a + F.when(F.col(k).isNotNull(), WEIGHTS[k]).otherwise(0.0), WEIGHTS, F.lit(0.0))
    score = F.when(weight > 0, total / weight).otherwise(0.0) - F.coalesce("penalty", F.lit(0.0)) * PENALTY
    return rows.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"), (F.col("favorite").isNotNull() | F.col("user_tag").isNotNull()).alias("user_signals"))


@query(None)
def h7_rank_documents(spark, d):
    """Given files by priority, ties by identifier."""
    return m25_priority(spark, d).filter("id % 10 = 3").orderBy(F.desc("score"), "id").limit(100).select("id", "score")


# --- near duplicates ------------------------------------------------------------------------------------


@query()
def l6_lexical_candidates(spark, d):
    """Pairs of texts that share a band of their SimHash, equal texts folded first; see families.simhash_pairs."""
    rows = _active_files(spark, d).select("id", "content_text")
    return families.simhash_pairs(rows, "id", "content_text")


def near_edges(spark, d, threshold: float = 0.9):
    """Similar vectors whose files are active and long enough and not equal, with the lexical score of their texts."""
    rows = _active_files(spark, d).filter(F.length("content_text") >= 200).select("id", "content_text")
    pairs = vectors.similar_pairs(table(spark, d, "embeddings").join(rows.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", DIMS, threshold)
    words = rows.select("id", F.sha2("content_text", 256).alias("digest"), F.array_distinct(t.latin_tokens(F.col("content_text"))).alias("w"))
    a, b = words.select(F.col("id").alias("a"), F.col("digest").alias("da"), F.col("w").alias("wa")), words.select(F.col("id").alias("b"), F.col("digest").alias("db"), F.col("w").alias("wb"))
    both = cut(pairs, "near").join(a, "a").join(b, "b").filter("da != db")
    lexical = F.round(F.when(F.size("wa") + F.size("wb") == 0, 1.0).otherwise(t.jaccard(F.col("wa"), F.col("wb"))), 5)
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("similarity").alias("semantic"), lexical.alias("lexical")).withColumn("reason", F.when(F.col("lexical") >= 0.6, "semantic+lexical").otherwise("semantic"))


_NEAR_SQL = f"""live AS (SELECT id, sha256(content_text) AS digest, list_distinct(regexp_extract_all(lower(content_text), '{t.LATIN}')) AS w, e FROM files JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) ON vec_id = id WHERE {ACTIVE} AND length(content_text) >= 200),
near AS (SELECT a.id AS src, b.id AS dst, round(coalesce({_COS}, 0), 5) AS semantic, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 5) AS lexical FROM live a JOIN live b ON a.id < b.id AND a.digest <> b.digest WHERE round(coalesce({_COS}, 0), 5) >= 0.4)"""


@query(sql(f"WITH {_NEAR_SQL} SELECT src, dst, semantic, lexical, CASE WHEN lexical >= 0.6 THEN 'semantic+lexical' ELSE 'semantic' END AS reason FROM near"))
def l7_near_duplicates(spark, d):
    """Candidates by vectors with both scores and the reason. The threshold is 0.4 here, as the test vectors hold no pair beyond 0.6."""
    return near_edges(spark, d, 0.4)


@query()
def g7_degree_cap(spark, d):
    """The strongest edges such that no file has more than three; the greedy rule, exactly."""
    return store.capped_degree(l7_near_duplicates(spark, d), "src", "dst", [-F.col("semantic"), -F.col("lexical"), F.col("src"), F.col("dst")], 3)


@query(sql(f"WITH {_NEAR_SQL} SELECT id, other, semantic FROM (SELECT src AS id, dst AS other, semantic FROM near UNION ALL SELECT dst, src, semantic FROM near) QUALIFY row_number() OVER (PARTITION BY id ORDER BY semantic DESC, other) <= 20"))
def l8_neighbours(spark, d):
    edges = cut(l7_near_duplicates(spark, d).select("src", "dst", "semantic"), "edges")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "semantic").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "semantic"))
    return relational.top_per_group(both, "id", [F.desc("semantic"), F.col("other")], 20).drop("place")


@query(sql(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(coalesce({_COS}, 0), 5) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id JOIN files f ON f.id = b.vec_id WHERE {ACTIVE}) SELECT r.id, other, similarity, CASE WHEN document_kind = 'ARCHIVE_MEMBER' THEN 'semantic+archive' ELSE 'semantic' END AS reason FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) <= 10) r JOIN files f ON f.id = other"))
def l9_related(spark, d):
    """The ten most similar active documents of every vector."""
    live = cut(_active_files(spark, d).select(F.col("id").alias("other"), "document_kind"), "live")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = vectors.nearest_of_all(rows, "vec_id", "embedding", DIMS, 10, rows.join(live.select(F.col("other").alias("vec_id")), "vec_id", "left_semi"))
    return near.join(live, "other").select("id", "other", "similarity", F.when(F.col("document_kind") == "ARCHIVE_MEMBER", "semantic+archive").otherwise("semantic").alias("reason"))
