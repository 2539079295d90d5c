"""More queries over whole tables: filters, facets, findings, scores, families and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import scores
from foliant.functions import text as t
from foliant.operators import families, relational
from foliant.operators.scratch import cut
from foliant.plans.queries import _TERMS, query, table, texts


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def c4_path_prefix(spark, d):
    return table(spark, d, "pages").filter(F.col("url").startswith("https://")).select("page_id", "url")


@query("SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}', 0, 'i'))" for p in scores.AMOUNTS) + " AS amounts FROM documents")
def d14_amounts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scores.amounts(F.col("text"))).cast("long").alias("amounts"))


@query(r"""WITH w AS (SELECT doc_id, source, lower(coalesce(text, '')) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
SELECT doc_id, round(CASE WHEN contains(lower(source), 'the') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN n > 0 THEN least(1.0::DOUBLE, 10 * ((length(s) - length(replace(s, 'the', ''))) / 3.0::DOUBLE) / n) ELSE 0 END, 6) AS score FROM w""")
def d21_text_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(scores.text_score("the", F.col("source"), F.col("text")), 6).alias("score"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def e12_three_way(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(items, "o_orderkey", "left")
    each = orders.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("items").alias("items"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "customer").select("c_custkey").join(each, "c_custkey", "left").select("c_custkey", none("orders"), none("items"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts::DATE > (SELECT max(ts)::DATE FROM events) - 30 GROUP BY 1")
def f5_last_days(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    last = days.agg(F.max("date").alias("last"))  # one row
    return days.join(F.broadcast(last), F.col("date") > F.date_sub("last", 30)).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "n")


_FOUND = f"""f AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{t.EMAIL}')) AS v FROM documents UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(coalesce(text, ''), '{t.IPV4}')) FROM documents
UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(coalesce(text, ''), '{t.CARD}')) FROM documents)"""


def _findings(docs):
    """(doc_id, kind, v) in one pass over the texts."""
    text = F.col("text")
    kinds = F.create_map(*[x for kind, p in (("email", t.EMAIL), ("ip", t.IPV4), ("card", t.CARD)) for x in (F.lit(kind), t.matches(text, p))])
    return docs.select("doc_id", F.explode(kinds).alias("kind", "all")).select("doc_id", "kind", F.explode("all").alias("v"))


@query(f"WITH {_FOUND} SELECT kind, sha256(lower(v)) AS fingerprint, count(DISTINCT doc_id) AS docs, count(*) AS mentions FROM f GROUP BY kind, lower(v)")
def f14_entity_frequency(spark, d):
    a_doc = _findings(table(spark, d, "documents")).groupBy("kind", F.sha2(F.lower("v"), 256).alias("fingerprint"), "doc_id").agg(F.count("*").alias("n"))
    return a_doc.groupBy("kind", "fingerprint").agg(F.count("doc_id").alias("docs"), F.sum("n").alias("mentions"))


@query(f"WITH {_FOUND} SELECT kind, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM f GROUP BY kind")
def f14_finding_kinds(spark, d):
    a_doc = _findings(table(spark, d, "documents")).groupBy("kind", "doc_id").agg(F.count("*").alias("n"))
    return a_doc.groupBy("kind").agg(F.count("doc_id").alias("docs"), F.sum("n").alias("hits"))


@query("SELECT doc_id, max(CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END) AS severity FROM labels GROUP BY doc_id")
def f17_worst_severity(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)).alias("severity"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def f30_users_by_month(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT count(DISTINCT conv_id) AS threads, count(*) AS messages FROM conversations")
def f21_threads(spark, d):
    return table(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("threads"), F.count("*").alias("messages"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER w - 1 AS place, row_number() OVER w = count(*) OVER (PARTITION BY l_orderkey) AS is_primary FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def g3_member_rank(spark, d):
    whole = Window.partitionBy("l_orderkey")
    place = F.row_number().over(whole.orderBy("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (place - 1).cast("long").alias("place"), (place == F.count("*").over(whole)).alias("is_primary"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM c QUALIFY place <= 3""")
def g5_top_categories(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return relational.top_per_group(counts, "user_id", [F.col("n").desc(), F.col("event_type")], 3)


@query("WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, lag(n) OVER (ORDER BY day) - 2 * n + lead(n) OVER (ORDER BY day) AS bend FROM c QUALIFY bend IS NOT NULL")
def g11_second_difference(spark, d):
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return families.second_differences(days, "day", "n")


@query(f"""WITH {_TERMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2), g AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT doc_id, c.term, round(tf::DOUBLE / len(w)::DOUBLE * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)::DOUBLE) + 1), 6) AS score FROM c JOIN g USING (term) JOIN w USING (doc_id))
SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM s QUALIFY place <= 10""")
def j12_tfidf(spark, d):
    """Frequent terms, whose counts are broadcast, have their score at once, the others bounds of it. Terms that cannot be among a
    document's ten go before the counts of the other terms are looked up."""
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", t.tokens(F.col("text")).alias("w"))
    counts = words.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    terms = cut(counts.groupBy("term").agg(F.count("*").alias("df")), "terms")
    often, most = relational.frequent(terms, "term", "df")
    total = F.lit(docs.count())
    score = lambda df: F.round(F.col("tf") / F.col("len") * (F.log((1 + total) / (1 + df)) + 1), 6)
    rows = counts.join(F.broadcast(often), "term", "left").withColumn("low", score(F.coalesce("df", F.lit(most))))
    whole = Window.partitionBy("doc_id").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("tenth", F.nth_value("low", 10).over(whole)).filter(F.col("tenth").isNull() | (score(F.coalesce("df", F.lit(1))) > F.col("tenth") - 2e-6))
    rows = cut(rows.select("doc_id", "term", "tf", "len", "df"), "candidates")
    rare = rows.filter("df is null").drop("df").join(terms.hint("merge"), "term")
    scored = rows.filter("df is not null").unionByName(rare).select("doc_id", "term", score(F.col("df")).alias("score"))
    return relational.top_per_group(scored, "doc_id", [F.col("score").desc(), F.col("term")], 10)


@query("""SELECT o_orderkey, round(exp(-date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) / 365.0::DOUBLE), 8) AS recency,
  round(least(1.0::DOUBLE, ln(1 + n) / ln(21.0::DOUBLE)), 8) AS centrality FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def j18_recency_and_centrality(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    last = orders.agg(F.max("day").alias("last"))  # one row
    rows = orders.join(items, "o_orderkey").crossJoin(F.broadcast(last))
    return rows.select("o_orderkey", F.round(scores.recency(F.datediff("last", "day")), 8).alias("recency"), F.round(scores.centrality(F.col("n")), 8).alias("centrality"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{h}')" for h in hints)} THEN '{o}'" for o, hints in scores.ERROR_HINTS.items()) + " ELSE 'PERMANENT_ERROR' END AS outcome FROM documents")
def j36_error_outcome(spark, d):
    return table(spark, d, "documents").select("doc_id", scores.error_outcome(F.col("text")).alias("outcome"))


@query("SELECT conv_id, turn, least(3600, 60 * pow(5, greatest(turn, 1) - 1))::BIGINT AS seconds FROM conversations")
def j37_backoff(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scores.backoff_seconds(F.col("turn")).alias("seconds"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND n_chars IN (SELECT n_chars FROM documents GROUP BY 1 HAVING count(*) > 1)")
def l1_hash_candidates(spark, d):
    docs = table(spark, d, "documents")
    shared = docs.groupBy("n_chars").agg(F.count("*").alias("n")).filter("n > 1")
    return docs.filter("text is not null").join(shared, "n_chars", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def n3_kmeans(spark, d):
    return families.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 12)
