"""Queries of clusters, projections and topics. `embeddings` is the vector store; a vector and the file of the same identifier
belong together, and the column `label` is a clustering run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.functions import vectors as v
from foliant.operators import families, relational, store, vectors
from foliant.operators.scratch import cut
from foliant.plans import corpus
from foliant.plans.corpus import files, hashes, sql
from foliant.plans.queries import _CENTROIDS, _COS, query, table
from foliant.plans.retrieval import DIMS
from foliant.plans.texts import _CATEGORIES, _FAMILIES, k19_categories, version_table


def _members(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("v"))


def _centres(spark, d):
    return vectors.centroids(_members(spark, d), "cluster", "v")


def _similar(spark, d):
    """(id, cluster, similarity) to the member's own centroid. Clusters are a bounded number of rows."""
    return _members(spark, d).join(F.broadcast(_centres(spark, d)), "cluster").select("id", "cluster", F.round(v.cosine(F.col("v"), F.col("centroid")), 5).alias("similarity"))


_OWN = f"own AS (SELECT a.vec_id AS id, a.label AS cluster, round(coalesce({_COS}, 0), 5) AS similarity FROM v a JOIN c b ON a.label = b.label)"


@query()
def n1_seeding(spark, d):
    """Starting centres by k-means|| (seeded), as the clustering uses them: one step of Lloyd's iteration from them."""
    return families.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 12, seed=3, steps=1)


@query(f"WITH {_CENTROIDS} SELECT count(*) AS rows, round(sum(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 3) AS inertia FROM v a JOIN c b ON a.label = b.label")
def n2_inertia(spark, d):
    both = _members(spark, d).join(F.broadcast(_centres(spark, d)), "cluster")
    total = vectors.inertia(both, "v", "centroid").select(F.round("inertia", 3).alias("inertia"))
    return both.agg(F.count("*").alias("rows")).crossJoin(total)


@query()
def n4_minibatch(spark, d):
    """k-means in few passes; Spark's passes are over partitions, so a mini-batch run is one with few steps."""
    return families.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 8, seed=1, steps=5)


@query()
def n6_dbscan(spark, d):
    return vectors.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS, 0.65, 4)


@query()
def n7_cluster_quality(spark, d):
    """A run's size, inertia and silhouette; more clusters than rows are cut to the rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    k = max(1, min(12, rows.count()))
    both = cut(rows.join(families.kmeans(rows, "vec_id", "embedding", k), "vec_id"), "clusters")
    centres = vectors.centroids(both, "cluster", "embedding")
    sums = vectors.inertia(both.join(F.broadcast(centres.select("cluster", "centroid")), "cluster"), "embedding", "centroid")
    score = vectors.silhouette(both, "vec_id", "cluster", "embedding").agg(F.avg("score").alias("silhouette"))
    return sums.crossJoin(score).crossJoin(centres.agg(F.count("*").alias("clusters"), F.max("size").alias("largest")))


@query(f"""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
m AS (SELECT a.id, a.label AS own, b.label AS other, sum(1 - list_dot_product(a.e, b.e)) AS s, count(*) AS n FROM u a JOIN u b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, max(s / n) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM m GROUP BY id)
SELECT id AS vec_id, round((b - a) / greatest(a, b), 5) AS score FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0""")
def n8_silhouette(spark, d):
    """Over all rows, not a sample."""
    return vectors.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("vec_id", F.round("score", 5).alias("score"))


@query()
def n11_seed_stability(spark, d):
    """Agreement of two runs with different seeds."""
    rows = table(spark, d, "embeddings")
    a, b = (families.kmeans(rows, "vec_id", "embedding", 10, seed).withColumnRenamed("cluster", n) for seed, n in ((0, "a"), (1, "b")))
    return vectors.adjusted_rand(a.join(b, "vec_id"), "a", "b")


@query()
def g10_run_agreement(spark, d):
    """Agreement of each run with the next one over three seeds."""
    rows = table(spark, d, "embeddings")
    runs = [families.kmeans(rows, "vec_id", "embedding", 10, s).select("vec_id", F.col("cluster").alias(f"c{s}")) for s in (0, 1, 2)]
    both = [vectors.adjusted_rand(runs[i].join(runs[i + 1], "vec_id"), f"c{i}", f"c{i + 1}").select(F.lit(i).alias("run"), "ari") for i in (0, 1)]
    return both[0].unionByName(both[1])


@query()
def n12_selected_k(spark, d):
    """Candidates between 4 and 24 with silhouette and inertia; the chosen one first."""
    found = vectors.chosen_k(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", (4, 8, 12))
    return spark.createDataFrame([(i == 0, int(k), float(s if s is not None else 0), float(e)) for i, (k, s, e) in enumerate(found)], "chosen boolean, k int, silhouette double, inertia double")


@query()
def n14_pca(spark, d):
    """Two coordinates on the directions of most variance, from the products of all rows."""
    return vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS)


@query()
def n15_svd(spark, d):
    return vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS, centred=False)


@query(f"WITH {_CENTROIDS}, {_OWN} SELECT * FROM own")
def n20_member_rows(spark, d):
    return _similar(spark, d)


@query(f"WITH {_CENTROIDS} SELECT label AS cluster, e[1:4] AS head FROM (SELECT label, list_transform(e, lambda x: round(x, 5)) AS e FROM c)")
def n21_centroids(spark, d):
    return _centres(spark, d).select("cluster", F.transform(F.slice("centroid", 1, 4), lambda x: F.round(x, 5)).alias("head"))


@query(f"WITH {_CENTROIDS}, {_OWN} SELECT cluster, count(*) AS size, round(avg(similarity), 4) AS cohesion FROM own GROUP BY 1")
def n19_cluster_cohesion(spark, d):
    return _similar(spark, d).groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("similarity"), 4).alias("cohesion"))


def collapsed(spark, d):
    """(id, kept): of equal contents the smallest identifier, of a version family's kept rows the primary one or else the smallest."""
    rows = files(spark, d).select("id").join(hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest"), "id", "left")
    own = F.coalesce("digest", F.concat(F.lit("id:"), F.col("id").cast("string")))
    first = rows.groupBy(own.alias("g")).agg(F.min("id").alias("id")).select("id")
    family = version_table(spark, d).select("id", "family", "is_primary")
    left = first.join(family, "id", "left")
    best = left.filter("family is not null").groupBy("family").agg(F.min_by("id", F.struct(~F.col("is_primary"), "id")).alias("best"))
    kept = left.join(best, "family", "left").filter("family is null or id = best").select("id", F.lit(True).alias("kept"))
    return files(spark, d).select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


_COLLAPSED = """firsts AS (SELECT min(f.id) AS id FROM files f LEFT JOIN hashes h ON h.file_id = f.id AND h.state = 'OK' GROUP BY coalesce(h.digest, 'id:' || f.id)),
bests AS (SELECT family, arg_min(id, struct_pack(a := NOT is_primary, b := id)) AS best FROM firsts JOIN families USING (id) GROUP BY 1),
keeps AS (SELECT firsts.id FROM firsts LEFT JOIN families m ON m.id = firsts.id LEFT JOIN bests USING (family) WHERE m.id IS NULL OR firsts.id = best)"""


@query(sql(f"WITH {_FAMILIES}, {_COLLAPSED} SELECT id, id IN (SELECT id FROM keeps) AS kept FROM files", "hashes"))
def n22_collapsed(spark, d):
    return collapsed(spark, d)


@query()
def n23_build_clusters(spark, d):
    """Clusters of a scope's vectors, copies and older versions left out: (id, cluster, similarity)."""
    live = files(spark, d).filter(store.active() & (F.length("content_text") > 50)).select("id").join(collapsed(spark, d).filter("kept"), "id", "left_semi")
    rows = cut(_members(spark, d).select("id", "v").join(live, "id", "left_semi"), "scope")
    labels = families.kmeans(rows, "id", "v", max(1, min(12, rows.count())))
    both = rows.join(labels, "id")
    centres = vectors.centroids(both, "cluster", "v")
    return both.join(F.broadcast(centres), "cluster").select("id", "cluster", F.round(v.cosine(F.col("v"), F.col("centroid")), 6).alias("similarity"))


_TOPIC_WORDS = f"list_filter(list_filter(regexp_extract_all(lower(coalesce(content_text, '')), '{t.TOPIC}'), lambda x: NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({', '.join(repr(w) for w in t.STOPWORDS)}))[1:4000], lambda x: length(x) <= 40 AND NOT regexp_matches(x, '^[0-9]{{2,}}'))"
_TOPICS = f"""u9 AS (SELECT label AS cluster, unnest({_TOPIC_WORDS}) AS term FROM files JOIN embeddings ON vec_id = id), c9 AS (SELECT cluster, term, count(*) AS tf FROM u9 GROUP BY 1, 2), a9 AS (SELECT cluster, sum(tf)::DOUBLE AS words FROM c9 GROUP BY 1), g9 AS (SELECT term, sum(tf)::DOUBLE AS f FROM c9 GROUP BY 1),
s9 AS (SELECT cluster, term, round(tf / words * ln(1 + greatest((SELECT sum(words) / count(*) FROM a9), 1) / f), 6) AS score FROM c9 JOIN a9 USING (cluster) JOIN g9 USING (term)),
topics AS (SELECT cluster, term, score, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS place FROM s9 QUALIFY place <= 12)"""


def topic_terms(spark, d):
    """(cluster, term, score, place): the twelve best terms of each cluster by class-based TF-IDF."""
    texts = files(spark, d).select("id", t.topic_tokens(F.col("content_text")).alias("w")).join(_members(spark, d).select("id", "cluster"), "id")
    counts = cut(texts.select("cluster", F.explode("w").alias("term")).filter(t.safe_term(F.col("term"))).groupBy("cluster", "term").agg(F.count("*").alias("tf")), "terms")
    words = counts.groupBy("cluster").agg(F.sum("tf").alias("words"))
    mean = words.agg(F.greatest(F.sum("words") / F.count("*"), F.lit(1.0)).alias("mean"))  # one row
    every = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    rows = relational.looked_up(counts.join(F.broadcast(words), "cluster"), every, "term").crossJoin(F.broadcast(mean))
    score = F.round(F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("f")), 6)
    return relational.top_per_group(rows.select("cluster", "term", score.alias("score")), "cluster", [F.desc("score"), F.col("term")], 12)


@query(sql(f"WITH {_TOPICS} SELECT * FROM topics"))
def n25_topics(spark, d):
    return topic_terms(spark, d)


@query()
def n24_build_topics(spark, d):
    """(cluster, size, cohesion, label, terms, representatives): one row a cluster."""
    terms = topic_terms(spark, d).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    near = n26_representatives(spark, d).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("representatives"))
    rows = n19_cluster_cohesion(spark, d).join(terms, "cluster", "left").join(near, "cluster", "left")
    return rows.select("cluster", "size", "cohesion", _label(F.col("terms"), F.col("size")).alias("label"), "terms", "representatives")


_REPRESENTATIVES = f"""r8 AS (SELECT own.id, own.cluster, similarity, coalesce(h.digest, 'id:' || own.id) AS dg, coalesce(m.family, 'id:' || own.id) AS fm FROM own LEFT JOIN hashes h ON h.file_id = own.id AND h.state = 'OK' LEFT JOIN families m ON m.id = own.id),
d8 AS (SELECT * FROM r8 QUALIFY row_number() OVER (PARTITION BY cluster, dg ORDER BY similarity DESC, id) = 1), f8 AS (SELECT * FROM d8 QUALIFY row_number() OVER (PARTITION BY cluster, fm ORDER BY similarity DESC, id) = 1)"""


@query(sql(f"WITH {_CENTROIDS}, {_OWN}, {_FAMILIES}, {_REPRESENTATIVES} SELECT cluster, id, similarity, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id) AS place FROM f8 QUALIFY place <= 5", "hashes"))
def n26_representatives(spark, d):
    """The five members nearest to each centroid, one of each content and version family."""
    rows = _similar(spark, d).join(hashes(spark, d).filter("state = 'OK'").select(F.col("file_id").alias("id"), "digest"), "id", "left").join(version_table(spark, d).select("id", "family"), "id", "left")
    own = F.concat(F.lit("id:"), F.col("id").cast("string"))
    order = [F.desc("similarity"), F.col("id")]
    for c in ("digest", "family"):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cluster", F.coalesce(c, own)).orderBy(*order))).filter("_n = 1").drop("_n")
    return relational.top_per_group(rows.select("cluster", "id", "similarity"), "cluster", order, 5)


def _label(terms, size):
    return F.coalesce(F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 4), " · ")), F.concat(F.lit("cluster-"), size.cast("string"), F.lit(" docs")))


@query(sql(f"WITH {_TOPICS}, l AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1) SELECT cluster, coalesce((SELECT string_agg(term, ' · ' ORDER BY place) FROM topics x WHERE x.cluster = l.cluster AND place <= 4), 'cluster-' || size || ' docs') AS label FROM l"))
def n27_labels(spark, d):
    """A cluster's first four terms, all of them safe to show, or its size."""
    terms = topic_terms(spark, d).filter("place <= 4").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    sizes = _members(spark, d).groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(terms, "cluster", "left").select("cluster", _label(F.col("terms"), F.col("size")).alias("label"))


@query(sql(f"WITH {_CATEGORIES} SELECT label AS cluster, category, count(*) AS docs FROM categories JOIN embeddings ON vec_id = id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, category) <= 8"))
def n28_cluster_categories(spark, d):
    """The eight most frequent categories of each cluster's documents."""
    rows = k19_categories(spark, d).join(_members(spark, d).select("id", "cluster"), "id").groupBy("cluster", "category").agg(F.count("*").alias("docs"))
    return relational.top_per_group(rows, "cluster", [F.desc("docs"), F.col("category")], 8).drop("place")


@query("SELECT n, CASE WHEN n <= 5000 THEN 'SMALL' WHEN n <= 25000 THEN 'MEDIUM' ELSE 'LARGE' END AS tier FROM (SELECT count(*) AS n FROM embeddings UNION ALL SELECT count(*) * 30 FROM embeddings UNION ALL SELECT count(*) * 1000 FROM embeddings)")
def n30_scale_tier(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("k")).select(F.explode(F.array(F.col("k"), F.col("k") * 30, F.col("k") * 1000)).alias("n"))
    return n.select("n", F.when(F.col("n") <= 5000, "SMALL").when(F.col("n") <= 25000, "MEDIUM").otherwise("LARGE").alias("tier"))


@query(sql("SELECT f.id, lang, extension, coalesce(s, 'none') AS severity, (SELECT count(*) FROM file_tags t WHERE t.file_id = f.id) AS tags, v.file_id IS NOT NULL AS favourite FROM files f LEFT JOIN (SELECT file_id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS s FROM pii GROUP BY 1) p ON p.file_id = f.id LEFT JOIN favourites v ON v.file_id = f.id", "pii", "file_tags", "favourites"))
def n31_overlays(spark, d):
    """What a map shows of every document, by one join a table."""
    worst = F.max(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1))
    found = corpus.pii(spark, d).groupBy(F.col("file_id").alias("id")).agg(worst.alias("w"))
    tags = corpus.file_tags(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("tags"))
    marks = corpus.favourites(spark, d).select(F.col("file_id").alias("id"), F.lit(True).alias("fav"))
    rows = files(spark, d).select("id", "lang", "extension").join(found, "id", "left").join(tags, "id", "left").join(marks, "id", "left")
    severity = F.when(F.col("w") == 3, "high").when(F.col("w") == 2, "medium").when(F.col("w") == 1, "low").otherwise("none")
    return rows.select("id", "lang", "extension", severity.alias("severity"), F.coalesce("tags", F.lit(0)).alias("tags"), F.coalesce("fav", F.lit(False)).alias("favourite"))


_LINKS = f"WITH {_CENTROIDS}, s AS (SELECT a.label AS x, b.label AS y, round(coalesce({_COS}, 0), 5) AS score FROM c a JOIN c b ON a.label <> b.label), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, y) <= 3)"


@query(f"{_LINKS} SELECT DISTINCT least(x, y) AS source, greatest(x, y) AS target, score FROM n ORDER BY source, target LIMIT 60")
def n32_cluster_graph(spark, d):
    """Each cluster with its three nearest others by centroid, each pair once."""
    c = _centres(spark, d).select("cluster", "centroid")  # a bounded number of rows
    pairs = c.crossJoin(F.broadcast(c.select(F.col("cluster").alias("other"), F.col("centroid").alias("there")))).filter("cluster != other")
    pairs = pairs.select("cluster", "other", F.round(v.cosine(F.col("centroid"), F.col("there")), 5).alias("score"))
    near = relational.top_per_group(pairs, "cluster", [F.desc("score"), F.col("other")], 3)
    return near.select(F.least("cluster", "other").alias("source"), F.greatest("cluster", "other").alias("target"), "score").distinct().orderBy("source", "target").limit(60)


@query(sql(f"WITH {_CENTROIDS}, {_OWN} SELECT own.id, filename, similarity FROM own JOIN files ON files.id = own.id WHERE cluster = 3 ORDER BY similarity DESC, own.id LIMIT 50"))
def n33_cluster_detail(spark, d):
    rows = _similar(spark, d).filter("cluster = 3").join(files(spark, d).select("id", "filename"), "id")
    return rows.orderBy(F.desc("similarity"), "id").limit(50).select("id", "filename", "similarity")


@query("SELECT label AS cluster, substr(sha256('m|64|' || count(*) || '|1'), 1, 32) = substr(sha256('m|64|50|1'), 1, 32) AS fresh FROM embeddings GROUP BY 1")
def n35_run_freshness(spark, d):
    """A run is fresh while the signature of what it was built from is that of now."""
    from foliant.operators import lifecycle

    sign = lambda n: lifecycle.freshness_signature(F.lit("m"), F.lit(64), n, F.lit(1))
    return _members(spark, d).groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", (sign(F.col("n")) == sign(F.lit(50))).alias("fresh"))


@query(sql(f"WITH {_FAMILIES}, x AS (SELECT 'duplicate' AS kind, b.file_id AS other FROM hashes a JOIN hashes b ON a.digest = b.digest AND a.file_id <> b.file_id WHERE a.file_id = 8 AND a.state = 'OK' AND b.state = 'OK' UNION ALL SELECT 'version', m.id FROM families f JOIN families m ON f.family = m.family AND m.id <> f.id WHERE f.id = 8 UNION ALL SELECT 'folder', b.id FROM files a JOIN files b ON a.parent_dir = b.parent_dir AND a.id <> b.id WHERE a.id = 8 AND coalesce(b.state, 'ACTIVE') = 'ACTIVE') SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY kind ORDER BY other) <= 10", "hashes"))
def n36_document_context(spark, d):
    """What stands around one document: copies, versions and files of its folder, ten of each at most."""
    rows = files(spark, d)
    h = hashes(spark, d).filter("state = 'OK'").select("file_id", "digest")
    copies = h.join(h.filter("file_id = 8").select("digest"), "digest", "left_semi").select(F.lit("duplicate").alias("kind"), F.col("file_id").alias("other"))
    family = cut(version_table(spark, d).select("id", "family"), "family")
    versions = family.join(family.filter("id = 8").select("family"), "family", "left_semi").select(F.lit("version").alias("kind"), F.col("id").alias("other"))
    folder = rows.filter(store.active()).join(rows.filter("id = 8").select("parent_dir"), "parent_dir", "left_semi").select(F.lit("folder").alias("kind"), F.col("id").alias("other"))
    return relational.top_per_group(copies.unionByName(versions).unionByName(folder).filter("other != 8"), "kind", [F.col("other")], 10).drop("place")


@query(f"WITH {_CENTROIDS}, {_OWN} SELECT cluster, id, similarity, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id) AS place FROM own QUALIFY place <= 100")
def v38_members_by_similarity(spark, d):
    return relational.top_per_group(_similar(spark, d), "cluster", [F.desc("similarity"), F.col("id")], 100)


@query("SELECT label AS cluster, count(*) AS members, max(vec_id) AS last FROM embeddings GROUP BY 1 ORDER BY last DESC, cluster LIMIT 1")
def v36_latest_run(spark, d):
    """The run that was added last."""
    return _members(spark, d).groupBy("cluster").agg(F.count("*").alias("members"), F.max("id").alias("last")).orderBy(F.desc("last"), "cluster").limit(1)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END)), 4) AS total FROM embeddings")
def v45_sanitised(spark, d):
    """Components that are not finite count as 0."""
    clean = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def v46_vectors_of(spark, d):
    wanted = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(wanted, "vec_id", "left_semi").select("vec_id", F.size("embedding").alias("dims"))


@query("SELECT label, count(*) AS rows, min(len(embedding)) AS dims, count(DISTINCT vec_id) = count(*) AS unique_ids, bool_and(list_sum(list_transform(embedding::DOUBLE[], lambda x: (isnan(x) OR isinf(x))::INTEGER)) = 0) AS finite FROM embeddings GROUP BY label")
def a54_store_check(spark, d):
    """What a vector store must hold: one dimension, unique identifiers, finite numbers."""
    finite = ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("dims"), (F.countDistinct("vec_id") == F.count("*")).alias("unique_ids"), F.bool_and(finite).alias("finite"))
    return rows


@query("SELECT label, count(*) AS rows FROM embeddings GROUP BY 1 ORDER BY rows DESC, label LIMIT 1")
def a53_largest_store(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(1)


@query(r"SELECT doc_id, length(regexp_replace(substr(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 1, 8000), '\s+', ' ', 'g')) AS n FROM documents")
def a58_embedding_text(spark, d):
    """A text as a model reads it: trimmed, at most 8,000 characters (the model's bound), blanks as one."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(F.substring(bare, 1, 8000), r"\s+", " ")).alias("n"))
