"""Queries over whole tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import graph, relational, search, vectors
from foliant.operators.scratch import cut, folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PROBE_TERMS = ("the", "of")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for what costs much a row."""
    return spread(table(spark, sf_dir, "documents"))


_indexes: dict[tuple[str, str], search.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The inverted index of the documents, saved in the shared folder once a session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{folder(spark)}/index-{len(_indexes)}"
        search.save_index(texts(spark, sf_dir).select("doc_id", "text"), path)
        _indexes[key] = search.open_index(spark, path)
    return _indexes[key]


# --- aggregates -----------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 500 THEN 1 WHEN n_chars < 1000 THEN 2 WHEN n_chars < 2000 THEN 3 WHEN n_chars < 5000 THEN 4 WHEN n_chars < 10000 THEN 5 ELSE 6 END AS size_range,
  count(*) AS files, sum(n_chars)::BIGINT AS total FROM documents WHERE n_chars >= 0 GROUP BY 1""")
def f2_size_ranges(spark, d):
    return relational.size_ranges(table(spark, d, "documents"), "n_chars", (0, 100, 500, 1000, 2000, 5000, 10000))


@query("SELECT lang, count(*) AS files, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang")
def f3_type_share(spark, d):
    return relational.share(table(spark, d, "documents"), "lang")


@query("SELECT coalesce(source, 'Root') AS folder, count(*) AS files, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1")
def f6_directory_stats(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("Root")).alias("folder")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id, ((count(*) - 1) * max(n_chars))::BIGINT AS wasted FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def f9_exact_duplicate_groups(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("size")).filter("copies > 1")
    return groups.select("digest", "copies", "first_id", ((F.col("copies") - 1) * F.col("size")).alias("wasted"))


@query("SELECT count(*) AS groups, sum(n - 1)::BIGINT AS extra, sum((n - 1) * s)::BIGINT AS wasted FROM (SELECT count(*) AS n, max(n_chars) AS s FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def f10_duplicate_totals(spark, d):
    groups = f9_exact_duplicate_groups(spark, d)
    return groups.agg(F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("extra"), F.sum("wasted").alias("wasted"))


@query("SELECT n_chars AS size, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) > 1")
def f11_shared_sizes(spark, d):
    return table(spark, d, "documents").groupBy(F.col("n_chars").alias("size")).agg(F.count("*").alias("files")).filter("files > 1")


@query("SELECT count(*) AS files, count(text) AS hashed, count(DISTINCT text) AS different FROM documents")
def f12_hash_coverage(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.count("text").alias("hashed"), F.countDistinct(F.sha2("text", 256)).alias("different"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def f18_timeline_buckets(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (pos = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(value) FILTER (pos = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(value) FILTER (pos = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM r GROUP BY event_type""")
def f28_percentiles(spark, d):
    return relational.percentile_by_index(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT lang, source, count(*) AS files FROM documents GROUP BY ROLLUP (lang, source) HAVING count(*) >= 5")
def f29_hierarchy(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("files")).filter("files >= 5")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def f30_month_by_type(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH p AS (SELECT lang, quantile_cont(n_chars, 0.95) AS edge FROM documents GROUP BY lang)
SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS total FROM documents JOIN p USING (lang) WHERE n_chars <= edge GROUP BY lang""")
def f32_below_p95(spark, d):
    docs = table(spark, d, "documents")
    edges = docs.groupBy("lang").agg(F.percentile("n_chars", F.lit(0.95)).alias("edge"))
    return docs.join(edges, "lang").filter("n_chars <= edge").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def f4_price_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


# --- joins, sets, top-k ---------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def e4_without_label(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def e5_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT min(doc_id) AS first_id, max(doc_id) AS second_id FROM documents WHERE text IS NOT NULL GROUP BY text, lang HAVING count(*) = 2")
def e9_rename_pairs(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return relational.one_to_one(rows, ("digest", "lang"), "doc_id")


@query("""SELECT conv_id, turn, role, lag(turn) OVER w AS reply_to, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def e10_replies(spark, d):
    rows = table(spark, d, "conversations")
    whole = Window.partitionBy("conv_id")
    return rows.select("conv_id", "turn", "role", F.lag("turn").over(whole.orderBy("turn")).alias("reply_to"), F.count("*").over(whole).alias("turns"))


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def e11_all_tags(spark, d):
    return relational.all_of(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ("A", "N", "R"))


@query("""SELECT a.user_id, a.event_id, b.event_id AS other_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1000000.0::DOUBLE AS apart
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600 * 1000000""")
def e13_temporal_proximity(spark, d):
    return relational.range_pairs(table(spark, d, "events"), "user_id", "event_id", "ts", 600)


@query("""WITH w AS (SELECT event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER o AS p, lead(epoch_us(ts)) OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, least(coalesce(t - p, n - t), coalesce(n - t, t - p)) AS nearest FROM w""")
def e14_nearest_in_time(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", (at - F.lag(at).over(w)).alias("p"), (F.lead(at).over(w) - at).alias("n"))
    return rows.select("event_id", F.least("p", "n").alias("nearest"))


@query("""WITH u AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events)
SELECT a.event_type AS first, b.event_type AS second, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def e17_co_occurrence(spark, d):
    sets = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("s"))  # a few types
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: a < b), lambda b: F.struct(a.alias("first"), b.alias("second")))))).alias("p"))
    return pairs.groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT strftime(r.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (day)""")
def e22_calendar(spark, d):
    return relational.calendar(table(spark, d, "events"), "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 10""")
def g9_top_per_type(spark, d):
    rows = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return relational.top_per_group(rows, "lang", [F.col("n_chars").desc(), F.col("doc_id")], 10)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def g4_lowest_id_survives(spark, d):
    return table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""SELECT coalesce(c.c_custkey, o.k) AS custkey, CASE WHEN c.c_custkey IS NULL THEN 'added' WHEN o.k IS NULL THEN 'removed' WHEN o.n <> 1 THEN 'changed' ELSE 'same' END AS change
FROM customer c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.k""")
def i3_snapshot_diff(spark, d):
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.lit(1).cast("long").alias("n"))
    after = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return relational.snapshot_diff(before, after, "custkey", ["n"])


# --- text and search ------------------------------------------------------------------------------------


_TERMS = r"""w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)"""


@query(f"""WITH {_TERMS}, t AS (SELECT lang, unnest(w) AS term FROM w), c AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2),
a AS (SELECT lang, sum(tf) AS words FROM c GROUP BY 1), g AS (SELECT term, sum(tf) AS f FROM c GROUP BY 1),
s AS (SELECT c.lang, c.term, round(tf::DOUBLE / words::DOUBLE * ln(1 + (SELECT sum(words)::DOUBLE / count(*) FROM a) / f::DOUBLE), 6) AS score FROM c JOIN a USING (lang) JOIN g USING (term))
SELECT lang, term, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS place FROM s QUALIFY place <= 10""")
def j13_class_tfidf(spark, d):
    terms = texts(spark, d).select("lang", F.explode(t.tokens(F.col("text"))).alias("term"))
    counts = cut(terms.groupBy("lang", "term").agg(F.count("*").alias("tf")), "counts")
    words = counts.groupBy("lang").agg(F.sum("tf").alias("words"), F.count("*").alias("terms"))
    mean = words.agg((F.sum("words").cast("double") / F.count("*")).alias("mean"))  # one row
    every = counts.groupBy("term").agg(F.sum("tf").alias("f"), F.count("*").alias("langs"))
    rows = relational.looked_up(relational.looked_up(counts, words, "lang", "terms"), every, "term", "langs").crossJoin(F.broadcast(mean))
    score = F.round(F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("f")), 6)
    return relational.top_per_group(rows.select("lang", "term", score.alias("score")), "lang", [F.col("score").desc(), F.col("term")], 10)


_BM25 = f"""{_TERMS}, n AS (SELECT doc_id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'of'))::DOUBLE AS b FROM w),
s AS (SELECT count(*)::DOUBLE AS docs, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n),
r AS (SELECT doc_id, round(ln((docs - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE) + 1) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))
  + ln((docs - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE) + 1) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)), 6) AS score FROM n, s WHERE a > 0 AND b > 0)"""


@query(f"WITH {_BM25} SELECT doc_id, score FROM r")
def d2_bm25_search(spark, d):
    """From the saved index, which the first search of a session over these tables builds."""
    return search.search_index(spark, index(spark, d), PROBE_TERMS)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion of the')")
def d3_substring_search(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("tion of the"))).select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') || ' ' AS s FROM documents)
SELECT doc_id FROM w WHERE contains(s, ' of the ') AND contains(s, ' re')""")
def d1_phrase_and_prefix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return rows.filter(search.matches(F.col("w"), search.parse_query('"of the" re'))).select("doc_id")


@query(r"""SELECT doc_id, (CASE WHEN contains(lower(source), 'of the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'of the') THEN 2 ELSE 0 END
  + 1.0 * len(list_intersect(['of', 'the'], regexp_extract_all(lower(source), '[\p{L}\p{N}_]+'))) + 0.5 * len(list_intersect(['of', 'the'], regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))
  + CASE WHEN contains(lower(lang), 'of the') THEN 10 ELSE 0 END + 3.0 * len(list_intersect(['of', 'the'], regexp_extract_all(lower(lang), '[\p{L}\p{N}_]+'))))::DOUBLE AS score FROM documents""")
def d9_relevance(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", search.relevance(docs, "of the", "lang", "source", "text").alias("score"))


@query(f"""WITH {_BM25}, x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p1 FROM r QUALIFY p1 <= 50),
y AS (SELECT doc_id, row_number() OVER (ORDER BY round(a / len, 6) DESC, doc_id) AS p2 FROM n WHERE a > 0 QUALIFY p2 <= 50)
SELECT doc_id, p1, p2, round(coalesce(1.0::DOUBLE / (60 + p1), 0) + coalesce(1.0::DOUBLE / (60 + p2), 0), 8) AS score FROM x FULL JOIN y USING (doc_id)""")
def d24_rank_fusion(spark, d):
    held = index(spark, d)
    first = search.top(search.search_index(spark, held, PROBE_TERMS), "score", "doc_id", 50)
    density = held.postings(spark, ["the"]).select("doc_id", F.round(F.col("tf") / F.col("len"), 6).alias("score"))
    return search.rrf(first, search.top(density, "score", "doc_id", 50), "doc_id")


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 100) / 700.0)::BIGINT - 1))) AS chunk FROM documents WHERE length(text) > 0)
SELECT doc_id, chunk::INTEGER AS chunk, (chunk * 700)::INTEGER AS start, length(substr(text, (chunk * 700 + 1)::BIGINT, 800)) AS length FROM c""")
def d32_chunks(spark, d):
    return search.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "start", F.col("length").cast("long").alias("length"))


@query(rf"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{t.EMAIL}')) AS emails, len(regexp_extract_all(coalesce(text, ''), '{t.IPV4}')) AS addresses,
  len(regexp_extract_all(coalesce(text, ''), '{t.CARD}')) AS card_like, len(regexp_extract_all(coalesce(text, ''), '{t.ISO_DATE}')) AS dates FROM documents""")
def k2_personal_data_counts(spark, d):
    text = F.col("text")
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long")
    return texts(spark, d).select("doc_id", F.when(F.contains(text, F.lit("@")), count(t.EMAIL)).otherwise(F.lit(0).cast("long")).alias("emails"), count(t.IPV4).alias("addresses"), count(t.CARD).alias("card_like"), count(t.ISO_DATE).alias("dates"))


@query(rf"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{t.EMAIL}')) AS v FROM documents)
SELECT doc_id, sha256(lower(v)) AS fingerprint, min(regexp_replace(v, '^(.)[^@]*(@.*)$', '\1***\2')) AS masked, count(*) AS n FROM f GROUP BY doc_id, lower(v)""")
def k7_masked_findings(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(t.matches(F.col("text"), t.EMAIL)).alias("v"))
    return found.groupBy("doc_id", F.sha2(F.lower("v"), 256).alias("fingerprint")).agg(F.min(t.mask_email(F.col("v"))).alias("masked"), F.count("*").alias("n"))


@query(rf"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{t.CARD}')) AS v FROM documents)
SELECT doc_id, '**** **** **** ' || right(v, 4) AS masked, list_sum(list_transform(range(length(v)), lambda i: CASE WHEN i % 2 = 0 THEN substr(v, (length(v) - i)::BIGINT, 1)::INT
  ELSE (substr(v, (length(v) - i)::BIGINT, 1)::INT * 2) // 10 + (substr(v, (length(v) - i)::BIGINT, 1)::INT * 2) % 10 END)) % 10 = 0 AS valid FROM f""")
def k3_card_check(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(t.matches(F.col("text"), t.CARD)).alias("v"))
    return found.select("doc_id", t.mask_card(F.col("v")).alias("masked"), t.luhn_ok(F.col("v")).alias("valid"))


# --- vectors --------------------------------------------------------------------------------------------

_COS = "list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0)"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT e FROM v ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(coalesce({_COS}, 0), 5) AS similarity FROM v a, p b ORDER BY similarity DESC, vec_id LIMIT 10""")
def d16_vector_top_k(spark, d):
    rows = table(spark, d, "embeddings")
    probe = rows.groupBy().agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.nearest(rows, probe, "vec_id", "embedding", 10)


_CENTROIDS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY label)"""


@query(f"WITH {_CENTROIDS} SELECT a.label, count(*) AS size, round(avg(coalesce({_COS}, 0)), 5) AS cohesion FROM v a JOIN c b ON a.label = b.label GROUP BY a.label")
def n9_cohesion(spark, d):
    return vectors.cohesion(table(spark, d, "embeddings"), "label", "embedding")


_NEAR = f"""{_CENTROIDS}, s AS (SELECT a.vec_id, a.label, b.label AS near, round(coalesce({_COS}, 0), 5) AS sim FROM v a, c b),
n AS (SELECT vec_id, label, near FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, near) = 1)"""


@query(f"WITH {_NEAR} SELECT vec_id, near FROM n")
def n34_nearest_centroid(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.assign(rows, vectors.centroids(rows, "label", "embedding"), "vec_id", "embedding", "label")


@query(f"""WITH {_NEAR}, k AS (SELECT label, near, count(*) AS n FROM n GROUP BY 1, 2),
q AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM k) AS cells, (SELECT sum(n) FROM k) AS al,
  (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM k GROUP BY label)) AS ro, (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM k GROUP BY near)) AS co)
SELECT round(CASE WHEN (ro + co) / 2 = ro * co / (al * (al - 1) / 2.0) THEN 1.0 ELSE (cells - ro * co / (al * (al - 1) / 2.0)) / ((ro + co) / 2 - ro * co / (al * (al - 1) / 2.0)) END::DOUBLE, 6) AS ari FROM q""")
def n10_adjusted_rand(spark, d):
    rows = table(spark, d, "embeddings")
    near = vectors.assign(rows, vectors.centroids(rows, "label", "embedding"), "vec_id", "embedding", "label")
    return vectors.adjusted_rand(rows.select("vec_id", "label").join(near, "vec_id"), "label", "near")


@query()
def l5_similar_vectors(spark, d):
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 0.9)


# --- graph ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) - 1 AS degree FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 0 FROM documents WHERE source IS NULL")
def m9_path_context_degree(spark, d):
    return graph.shared_key_degree(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
f AS (SELECT b, min(a) AS low FROM e GROUP BY b), x AS (SELECT a AS id, least(low, e.b) AS component FROM e JOIN f USING (b) UNION SELECT b, least(low, b) FROM f)
SELECT id, component FROM x""")
def m20_connected_components(spark, d):
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return graph.components(customers.union(suppliers))


@query()
def m21_pagerank(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return graph.pagerank(edges.union(edges.select("b", "a"))).select("id", F.round("rank", 9).alias("rank"))
