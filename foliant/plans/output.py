"""Queries that write and read back: runs, exports, reports, backups; and the remaining small views."""

from __future__ import annotations

import difflib
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions import names, scores
from foliant.functions import text as t
from foliant.functions.vectors import cosine
from foliant.operators import families, graph, relational, search, store, vectors
from foliant.operators.scratch import cut, folder
from foliant.plans import corpus
from foliant.plans.corpus import ACTIVE, files, hashes, sql
from foliant.plans.galaxy import _OWN, _TOPICS, _members, _similar, topic_terms
from foliant.plans.queries import _CENTROIDS, _COS, query, table
from foliant.plans.records import _DOSSIER, _DUP, _RETRY, _dossier, _duplicate_groups, a51_eligible, o9_ingestion_report, runs
from foliant.plans.retrieval import _FULL, _SIM, DIMS, _full_text, m1_relations, near_edges
from foliant.plans.retrieval import _similar as _similar_to
from foliant.plans.store import f8_scan_statistics
from foliant.plans.texts import _CATEGORIES, _FAMILIES, k19_categories, version_table
from foliant.sources import sinks


def _path(spark, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


# --- sinks ----------------------------------------------------------------------------------------------


@query(sql("SELECT 'type' AS metric, file_type AS name, 2 * count(*) AS n FROM files GROUP BY 2"))
def b7_saved_statistics(spark, d):
    """Statistics of two scans, appended and summed."""
    path, rows = _path(spark, "stats"), f8_scan_statistics(spark, d).filter("metric = 'type'")
    for _ in range(2):
        sinks.append(rows, path)
    return spark.read.parquet(path).groupBy("metric", "name").agg(F.sum("n").alias("n"))


@query(sql(f"WITH {_FAMILIES} SELECT family, count(*) AS members FROM families GROUP BY 1"))
def b10_saved_families(spark, d):
    return sinks.replace(version_table(spark, d), _path(spark, "families")).groupBy("family").agg(F.count("*").alias("members"))


@query(sql(f"WITH {_CATEGORIES} SELECT 'language' AS part, count(*) AS n FROM files UNION ALL SELECT 'categories', count(*) FROM categories UNION ALL SELECT 'pii', count(*) FROM pii", "pii"))
def b11_saved_annotations(spark, d):
    """The annotations of all documents as tables of one snapshot, which is complete before its name is used."""
    path = _path(spark, "annotations")
    parts = {"language": files(spark, d).select("id", "lang"), "categories": k19_categories(spark, d), "pii": corpus.pii(spark, d)}
    out = [sinks.replace(df, f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT count(*) AS rows, round(sum(list_sum(embedding::DOUBLE[])), 2) AS total FROM embeddings")
def b12_saved_vectors(spark, d):
    rows = sinks.replace(table(spark, d, "embeddings"), _path(spark, "vectors"))
    return rows.agg(F.count("*").alias("rows"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))), 2).alias("total"))


@query("SELECT label AS cluster, count(*) AS members FROM embeddings GROUP BY 1")
def b16_saved_run(spark, d):
    """A run is saved twice and another one beside it; reading one run gives its last state (b16, b17)."""
    path, rows = _path(spark, "members"), _members(spark, d).select("id", "cluster")
    sinks.save_run(rows.limit(3), path, "r1")
    sinks.save_run(rows.limit(5), path, "r2")
    sinks.save_run(rows, path, "r1")
    return sinks.read_run(spark, path, "r1").groupBy("cluster").agg(F.count("*").alias("members"))


@query(f"WITH {_CENTROIDS}, {_OWN} SELECT id, cluster, similarity FROM own")
def b17_saved_members(spark, d):
    path = _path(spark, "run")
    sinks.save_run(_similar(spark, d), path, "r1")
    return sinks.read_run(spark, path, "r1").select("id", "cluster", "similarity")


@query(sql(f"WITH {_TOPICS} SELECT cluster, term, place FROM topics"))
def b18_saved_topics(spark, d):
    """Topics of a run, saved and read back (b18, v39)."""
    path = _path(spark, "topics")
    sinks.save_run(topic_terms(spark, d), path, "r1")
    return sinks.read_run(spark, path, "r1").select("cluster", "term", "place")


@query("SELECT count(*) AS points, count(DISTINCT vec_id) AS ids FROM embeddings")
def b19_saved_points(spark, d):
    """A projection's points, saved and read back (b19, v37, v40, v41)."""
    path = _path(spark, "points")
    sinks.save_run(vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS), path, "p1")
    rows = sinks.read_run(spark, path, "p1").filter("size(coordinates) = 2")
    return rows.agg(F.count("*").alias("points"), F.countDistinct("id").alias("ids"))


@query(sql("SELECT file_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1"))
def b20_exported_statistics(spark, d):
    path = _path(spark, "json")
    sinks.export_json(files(spark, d).groupBy("file_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")), path)
    return spark.read.schema("file_type string, n long, bytes long").json(path)


@query(sql("SELECT id, filename, size_bytes FROM files"))
def b21_exported_tables(spark, d):
    """All rows as JSON without their content."""
    path = _path(spark, "json")
    sinks.export_json(files(spark, d).select("id", "filename", "size_bytes", "content_text"), path, ("content_text",))
    return spark.read.schema("id long, filename string, size_bytes long").json(path)


@query(sql("SELECT id, filename FROM files WHERE contains(filename, 'report')"))
def b22_exported_csv(spark, d):
    path = _path(spark, "csv")
    sinks.export_csv(files(spark, d).filter(F.contains("filename", F.lit("report"))).select("id", "filename"), path)
    return spark.read.option("header", True).schema("id long, filename string").csv(path)


@query(sql(f"WITH {_DUP} SELECT 'Duplicates' AS title, count(*) AS total FROM dup UNION ALL SELECT 'Ingestion', count(DISTINCT outcome) FROM queue", "hashes", "queue"))
def b23_written_report(spark, d):
    """A report as JSON and HTML with a manifest, written, verified and read back (b23, b24)."""
    path = _path(spark, "report")
    parts = [sinks.section("Duplicates", _duplicate_groups(spark, d), [F.desc("wasted"), "digest"]), sinks.section("Ingestion", o9_ingestion_report(spark, d), ["outcome"])]
    sinks.write_report("Report", parts, path)
    if bad := sinks.verify_report(path):
        raise ValueError(f"{bad} are not what was written")
    found = spark.read.option("wholetext", True).text(f"{path}/report.json")
    rows = found.select(F.explode(F.from_json("value", "sections array<struct<title:string,total:long>>")["sections"]).alias("s"))
    return rows.select("s.title", "s.total")


@query(sql("SELECT 'files' AS name, count(*) AS n, true AS ok FROM files UNION ALL SELECT 'hashes', count(*), true FROM hashes", "hashes"))
def b27_verified_backup(spark, d):
    """A backup with checksums (b26), read again."""
    path = _path(spark, "backup")
    sinks.backup({"files": files(spark, d), "hashes": hashes(spark, d)}, path)
    return sinks.verify_backup(spark, path)


@query(sql("SELECT file_id, digest, state FROM hashes", "hashes"))
def b28_restored_backup(spark, d):
    path = _path(spark, "backup")
    sinks.backup({"hashes": hashes(spark, d)}, path)
    return sinks.restore(spark, path, "hashes").select("file_id", "digest", "state")


# --- search and joins -----------------------------------------------------------------------------------


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(coalesce({_COS}, 0), 5) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def d23_pair_cosine(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query(sql(f"WITH {_SIM}, {_FULL}, x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS p1 FROM found QUALIFY p1 <= 30), y AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sim DESC, vec_id) AS p2 FROM sims QUALIFY p2 <= 30) SELECT coalesce(x.id, y.id) AS id, p1, p2, round(coalesce(1.0::DOUBLE / (60 + p1), 0) + coalesce(1.0::DOUBLE / (60 + p2), 0), 8) AS score FROM x FULL JOIN y ON x.id = y.id ORDER BY score DESC, coalesce(p1, 1000000000), coalesce(p2, 1000000000), id LIMIT 10"))
def d26_rerank_search(spark, d):
    """Both lists, three times as long as what is asked for, fused."""
    both = search.rrf(search.top(_full_text(spark, d), "score", "id", 30), search.top(_similar_to(spark, d).withColumnRenamed("vec_id", "id"), "sim", "id", 30), "id")
    far = F.lit(10**9)
    return both.orderBy(F.desc("score"), F.coalesce("p1", far), F.coalesce("p2", far), "id").limit(10)


@query(sql(f"WITH {_SIM}, {_FULL} SELECT id, round(0.5::DOUBLE * score / (1 + score) + 0.5::DOUBLE * sim, 6) AS score FROM found JOIN sims ON vec_id = id ORDER BY 2 DESC, id LIMIT 10"))
def d30_rank_and_cosine(spark, d):
    """Lexical rank and cosine in equal parts, best first."""
    both = _full_text(spark, d).join(_similar_to(spark, d).withColumnRenamed("vec_id", "id"), "id")
    score = F.round(0.5 * F.col("score") / (1 + F.col("score")) + 0.5 * F.col("sim"), 6)
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(sql(f"WITH {_SIM} SELECT vec_id AS id, round(1 - sim, 5) AS distance FROM sims JOIN files ON id = vec_id WHERE sim >= 0.1 AND file_type = 'document' ORDER BY sim DESC, vec_id LIMIT 10"))
def d29_filtered_nearest(spark, d):
    """The nearest vectors among files of a type, from a threshold on."""
    rows = _similar_to(spark, d).withColumnRenamed("vec_id", "id").filter("sim >= 0.1").join(files(spark, d).filter("file_type = 'document'").select("id"), "id", "left_semi")
    return rows.orderBy(F.desc("sim"), "id").limit(10).select("id", F.round(1 - F.col("sim"), 5).alias("distance"))


@query(sql(f"SELECT id FROM files f WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.file_id = f.id AND NOT ({_RETRY}))", "queue"))
def e6_not_exists(spark, d):
    ended = corpus.queue(spark, d).filter(~scores.retryable(F.col("outcome"), F.col("attempts"))).select(F.col("file_id").alias("id"))
    return files(spark, d).select("id").join(ended, "id", "left_anti")


@query()
def e15_vector_buckets(spark, d):
    """Candidate pairs that share a band of 16 hyperplanes' sides; equal vectors are one first, so copies form no pairs."""
    rows = table(spark, d, "embeddings").groupBy(F.xxhash64("embedding").alias("h")).agg(F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"))
    bands = cut(vectors.hyperplane_bands(rows, "vec_id", "embedding", DIMS), "bands")
    pairs = bands.join(bands.withColumnRenamed("vec_id", "other"), ["band", "bucket"]).filter("vec_id < other")
    return pairs.select(F.col("vec_id").alias("a"), F.col("other").alias("b")).distinct()


@query()
def e16_lexical_buckets(spark, d):
    """Pairs of texts that share a band of their SimHash."""
    return families.simhash_pairs(files(spark, d).filter(store.active()).select("id", "content_text"), "id", "content_text", min_lexical=0.0).select("src", "dst")


@query(sql(f"WITH {_SIM}, {_FULL}, x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS p1 FROM found QUALIFY p1 <= 20), y AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sim DESC, vec_id) AS p2 FROM sims QUALIFY p2 <= 20) SELECT coalesce(x.id, y.id) AS id, p1, p2 FROM x FULL JOIN y ON x.id = y.id"))
def e20_merged_rankings(spark, d):
    """All of two rankings with their places (e20, g1)."""
    a = search.top(_full_text(spark, d), "score", "id", 20).select("id", F.col("place").alias("p1"))
    b = search.top(_similar_to(spark, d).withColumnRenamed("vec_id", "id"), "sim", "id", 20).select("id", F.col("place").alias("p2"))
    return a.join(b, "id", "full_outer")


@query(sql(f"WITH {_FULL} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM found QUALIFY place <= 100"))
def g1_ranked(spark, d):
    return search.top(_full_text(spark, d), "score", "id", 100).select("id", "place")


@query()
def f37_similar_groups(spark, d):
    """Files linked by similar vectors, by the smallest of each group."""
    edges = near_edges(spark, d, 0.4).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.components(edges)


@query(sql("SELECT file_type, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM files GROUP BY 1"))
def g13_percent(spark, d):
    return relational.share(files(spark, d), "file_type").select("file_type", "percent")


@query(sql(f"WITH {_FAMILIES} SELECT family, max(members) AS members FROM families GROUP BY 1 ORDER BY members DESC, family LIMIT 500"))
def h6_families_by_size(spark, d):
    return version_table(spark, d).groupBy("family").agg(F.max("members").alias("members")).orderBy(F.desc("members"), "family").limit(500)


@query(sql("SELECT id FROM files WHERE id % 5 = 0 AND path NOT IN (SELECT path FROM files WHERE state = 'MISSING')"))
def i11_pruned_artifacts(spark, d):
    """Artifacts (every fifth file) whose file is still there."""
    gone = files(spark, d).filter("state = 'MISSING'").select("path")
    return files(spark, d).filter("id % 5 = 0").select("id", "path").join(gone, "path", "left_anti").select("id")


@query(sql("SELECT DISTINCT extension FROM files WHERE extension IN ('.pdf', '.csv', '.xyz')"))
def i14_supported_extensions(spark, d):
    """Asked for and there."""
    asked = spark.createDataFrame([(".pdf",), (".csv",), (".xyz",)], "extension string")
    return files(spark, d).select("extension").intersect(asked)


@query(sql("SELECT parent_dir, round(least(1.0::DOUBLE, ln(1 + count(*)) / ln(21.0::DOUBLE)), 8) AS centrality FROM files WHERE parent_dir IS NOT NULL GROUP BY 1"))
def j20_centrality(spark, d):
    rows = files(spark, d).filter("parent_dir is not null").groupBy("parent_dir").agg(F.count("*").alias("n"))
    return rows.select("parent_dir", F.round(scores.centrality(F.col("n")), 8).alias("centrality"))


@query(sql(f"SELECT file_id, {_RETRY} AS retry FROM queue", "queue"))
def j38_retry_eligible(spark, d):
    return corpus.queue(spark, d).select("file_id", scores.retryable(F.col("outcome"), F.col("attempts")).alias("retry"))


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The unified difference of the first 2,000 characters of two texts, 400 lines at most."""
    out = []
    for a, b in zip(before, after, strict=True):
        lines = difflib.unified_diff((a or "")[:2000].splitlines(), (b or "")[:2000].splitlines(), "before", "after", lineterm="")
        out.append("\n".join(list(lines)[:400]))
    return pd.Series(out, dtype=object)


@query()
def j41_version_differences(spark, d):
    """Differences between each version and the one before it."""
    rows = cut(version_table(spark, d).filter("confidence = 'HIGH'").select("family", "id", "rank"), "versions")
    text = files(spark, d).select("id", "content_text")
    pairs = rows.join(rows.select("family", (F.col("rank") + 1).alias("rank"), F.col("id").alias("before")), ["family", "rank"])
    both = pairs.join(text, "id").join(text.select(F.col("id").alias("before"), F.col("content_text").alias("old")), "before")
    return both.select("family", "before", "id", unified_diff("old", "content_text").alias("difference"))


_MASKED = {
    "k9_iban_masked": ("'DE' || lpad(id::VARCHAR, 20, '7')", "substr(v, 1, 4) || ' **** **** ' || right(v, 4)", lambda i: F.concat(F.lit("DE"), F.lpad(i, 20, "7")), t.mask_iban),
    "k10_card_masked": ("'4111' || lpad(id::VARCHAR, 12, '1')", "'**** **** **** ' || right(v, 4)", lambda i: F.concat(F.lit("4111"), F.lpad(i, 12, "1")), t.mask_card),
    "k11_ip_masked": ("'10.' || (id % 200) || '.3.4'", "string_split(v, '.')[1] || '.' || string_split(v, '.')[2] || '.*.*'", lambda i: F.concat(F.lit("10."), (i.cast("long") % 200).cast("string"), F.lit(".3.4")), t.mask_ip),
    "k12_name_masked": ("filename", "substr(v, 1, 1) || '***'", lambda i: F.col("filename"), t.mask_name),
    "k13_address_masked": ("path", "CASE WHEN length(v) > 8 THEN substr(v, 1, 8) || '…' ELSE '…' END", lambda i: F.col("path"), t.mask_address),
    "k14_dob_masked": ("'01.02.' || (1900 + id % 100)", "'**/**/' || right(v, 4)", lambda i: F.concat(F.lit("01.02."), (1900 + i.cast("long") % 100).cast("string")), t.mask_dob),
}


def _masker(name: str, make, mask):
    def run(spark, d):
        return files(spark, d).select("id", mask(make(F.col("id").cast("string"))).alias("masked"))

    run.__name__ = name
    return run


for _name, (_value, _form, _make, _mask) in _MASKED.items():
    query(sql(f"SELECT id, {_form} AS masked FROM (SELECT *, {_value} AS v FROM files)"))(_masker(_name, _make, _mask))


@query(sql(f"WITH {_DUP} SELECT count(*) AS groups, coalesce(sum(copies), 0)::BIGINT AS members, coalesce(sum(wasted), 0)::BIGINT AS wasted FROM dup", "hashes"))
def l4_duplicate_totals(spark, d):
    return _duplicate_groups(spark, d).agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("members"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


@query()
def m26_graph_facade(spark, d):
    """A file's neighbourhood with degrees, components and ranks of its nodes."""
    edges = cut(m1_relations(spark, d).select("src", "dst", "score"), "edges")
    nodes = cut(graph.reached(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), spark.createDataFrame([(1,)], "id long"), 1, 50).select("id"), "nodes")
    inside = cut(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"), "inside")
    by = graph.degrees(inside, "src", "dst", "score")
    pairs = inside.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ranks = graph.pagerank(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return nodes.join(by, "id", "left").join(graph.components(pairs), "id", "left").join(ranks, "id", "left")


@query()
def n13_singular_values(spark, d):
    """The two largest singular values, by the coordinates on their directions."""
    rows = vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS, centred=False)
    return rows.select(F.posexplode("coordinates").alias("i", "x")).groupBy("i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("value"))


def projected(rows, method: str):
    """Coordinates by a method; no or one point lies at the origin."""
    if rows.limit(2).count() < 2:
        return rows.select(F.col("vec_id").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("coordinates"))
    return vectors.principal(rows, "vec_id", "embedding", DIMS, centred=method == "pca")


@query("SELECT 'none' AS kind, 0 AS points, 0.0::DOUBLE AS spread UNION ALL SELECT 'one', 1, 0.0")
def n18_projection_cases(spark, d):
    rows = table(spark, d, "embeddings")
    part = lambda kind, df: projected(df, "pca").agg(F.count("*").alias("points"), F.coalesce(F.max(F.abs(F.element_at("coordinates", 1))), F.lit(0.0)).alias("spread")).select(F.lit(kind).alias("kind"), "points", "spread")
    return part("none", rows.filter("vec_id < 0")).unionByName(part("one", rows.orderBy("vec_id").limit(1)))


@query("SELECT vec_id AS id, label AS cluster, CASE WHEN (SELECT count(*) FROM embeddings) <= 5000 THEN 'SMALL' WHEN (SELECT count(*) FROM embeddings) <= 25000 THEN 'MEDIUM' ELSE 'LARGE' END AS tier FROM embeddings")
def n29_map(spark, d):
    """Points of a map with their clusters and the tier of its size."""
    rows = table(spark, d, "embeddings")
    n = rows.count()
    tier = "SMALL" if n <= 5000 else "MEDIUM" if n <= 25000 else "LARGE"
    points = projected(rows, "pca").filter("size(coordinates) = 2").select("id")
    return points.join(_members(spark, d).select("id", "cluster"), "id").withColumn("tier", F.lit(tier))


# --- remaining views ------------------------------------------------------------------------------------


@query(sql("SELECT a.id, coalesce(m.n, 0) AS member_count FROM files a LEFT JOIN (SELECT archive_parent_id AS id, count(*) AS n FROM files WHERE archive_parent_id IS NOT NULL GROUP BY 1) m USING (id) WHERE a.extension = '.zip' AND a.id IN (0, 13, 26, 39)"))
def v7_index_state_of(spark, d):
    from foliant.plans.records import v6_index_state

    return v6_index_state(spark, d).filter(F.col("id").isin(0, 13, 26, 39)).select("id", "member_count")


@query(sql("SELECT id FROM files WHERE coalesce(length(content_text), 0) = 0 OR id % 10 = 9"))
def v11_attempted(spark, d):
    """Files that were tried: those without text, and those of the last batch."""
    return files(spark, d).filter((F.coalesce(F.length("content_text"), F.lit(0)) == 0) | (F.col("id") % 10 == 9)).select("id")


@query("SELECT user_id AS run_id, CASE WHEN user_id % 4 = 0 THEN 'CANCELLED' WHEN user_id % 7 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events GROUP BY 1, 2")
def v17_cancelled(spark, d):
    return runs(spark, d).select("run_id", F.when(F.col("status") == "RUNNING", "CANCELLED").otherwise(F.col("status")).alias("status"))


@query("SELECT user_id AS run_id, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY 1")
def v18_error_counts(spark, d):
    return runs(spark, d).select("run_id", F.col("errors").alias("error_count"))


@query(sql("SELECT count(*) AS generation FROM files WHERE id % 9 = 2 OR state = 'MISSING'"))
def v20_bumped_generation(spark, d):
    """One step for each change since the table was made."""
    return files(spark, d).filter((F.col("id") % 9 == 2) | F.col("state").eqNullSafe("MISSING")).agg(F.count("*").alias("generation"))


@query(sql(f"SELECT vec_id, vec_id IN (SELECT id FROM files WHERE {ACTIVE}) AS kept FROM embeddings"))
def v23_recorded_removals(spark, d):
    live = files(spark, d).filter(store.active()).select(F.col("id").alias("vec_id"), F.lit(True).alias("live"))
    return table(spark, d, "embeddings").select("vec_id").join(live, "vec_id", "left").select("vec_id", F.coalesce("live", F.lit(False)).alias("kept"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT count(*) AS edges FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 0), 5) >= 0.4")
def v27_edge_count(spark, d):
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS, 0.4).agg(F.count("*").alias("edges"))


@query(sql(f"WITH {_CENTROIDS}, {_OWN}, {_TOPICS} SELECT cluster, count(*) AS size, round(avg(similarity), 4) AS cohesion, (SELECT term FROM topics x WHERE x.cluster = own.cluster AND place = 1) AS first_term FROM own GROUP BY 1"))
def v31_cluster_summaries(spark, d):
    first = topic_terms(spark, d).filter("place = 1").select("cluster", F.col("term").alias("first_term"))
    rows = _similar(spark, d).groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("similarity"), 4).alias("cohesion"))
    return rows.join(first, "cluster", "left")


@query(sql(f"WITH {_TOPICS} SELECT vec_id AS id, label AS cluster, (SELECT term FROM topics x WHERE x.cluster = label AND place = 1) AS topic FROM embeddings"))
def v33_memberships(spark, d):
    """Clusters of every document with their topic."""
    first = topic_terms(spark, d).filter("place = 1").select("cluster", F.col("term").alias("topic"))
    return _members(spark, d).select("id", "cluster").join(F.broadcast(first), "cluster", "left").select("id", "cluster", "topic")


@query(sql(f"WITH {_FAMILIES} SELECT id, stem, members, confidence, rank, is_primary FROM families"))
def v35_versions_of(spark, d):
    return version_table(spark, d).select("id", "stem", "members", "confidence", "rank", "is_primary")


@query("SELECT max(vec_id) AS last, count(*) AS points FROM embeddings")
def v37_latest_projection(spark, d):
    return vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS).agg(F.max("id").alias("last"), F.count("*").alias("points"))


@query(sql(f"WITH {_TOPICS} SELECT cluster, count(*) AS terms, max(score) AS best FROM topics GROUP BY 1"))
def v39_topics_of(spark, d):
    return topic_terms(spark, d).groupBy("cluster").agg(F.count("*").alias("terms"), F.max("score").alias("best"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 = 0")
def v40_points_of(spark, d):
    return vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", DIMS).filter("id % 4 = 0").select("id")


@query(sql(f"WITH {_FAMILIES} SELECT (SELECT count(*) FROM hashes WHERE state = 'OK') AS hashes, (SELECT count(*) FROM families) AS version_members, (SELECT count(*) FROM pii) AS entities, (SELECT count(*) FROM favourites) AS favourites, (SELECT count(*) FROM file_tags) AS file_tags, count(archive_parent_id) AS archive_links FROM files", "hashes", "pii", "favourites", "file_tags"))
def v42_derived_counts(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(hashes(spark, d).filter("state = 'OK'"), "hashes").crossJoin(n(version_table(spark, d), "version_members")).crossJoin(n(corpus.pii(spark, d), "entities"))
    return out.crossJoin(n(corpus.favourites(spark, d), "favourites")).crossJoin(n(corpus.file_tags(spark, d), "file_tags")).crossJoin(files(spark, d).agg(F.count("archive_parent_id").alias("archive_links")))


@query()
def v43_best_of_seeds(spark, d):
    """The best of three seeded clusterings by inertia."""
    rows = cut(table(spark, d, "embeddings").select("vec_id", "embedding"), "rows")
    best = None
    for seed in range(3):
        both = cut(rows.join(families.kmeans(rows, "vec_id", "embedding", 8, seed), "vec_id"), "run")
        centres = vectors.centroids(both, "cluster", "embedding").select("cluster", "centroid")
        cost = vectors.inertia(both.join(F.broadcast(centres), "cluster"), "embedding", "centroid").first()[0]
        best = min([x for x in (best, (cost, seed, both)) if x], key=lambda x: x[:2])
    return best[2].select("vec_id", "cluster", F.lit(best[1]).alias("seed"))


@query(f"WITH {_CENTROIDS} SELECT label, len(e) AS dims FROM c")
def v44_label_centroids(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.size("centroid").alias("dims"))


@query(sql("SELECT id, lang FROM files WHERE id IN (1, 4, 9, 16, 25)"))
def v56_language_of(spark, d):
    return files(spark, d).filter(F.col("id").isin(1, 4, 9, 16, 25)).select("id", "lang")


@query(sql("SELECT file_id, pii_type, hits FROM pii ORDER BY file_id, pii_type, hits DESC, fingerprint LIMIT 500", "pii"))
def v57_entities_of(spark, d):
    return corpus.pii(spark, d).orderBy("file_id", "pii_type", F.desc("hits"), "fingerprint").limit(500).select("file_id", "pii_type", "hits")


@query(sql(f"WITH {_CATEGORIES} SELECT id, category, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS place FROM categories"))
def v58_categories_of(spark, d):
    rows = k19_categories(spark, d).select("id", "category", "score")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "category")))


@query(sql("SELECT file_id, severity, pii_type, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pii_type, fingerprint) AS place FROM pii", "pii"))
def v59_findings_by_severity(spark, d):
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(rank, "pii_type", "fingerprint"))
    return corpus.pii(spark, d).select("file_id", "severity", "pii_type", place.alias("place"))


@query("SELECT event_id, event_type AS action, 'normal' AS sensitivity FROM events UNION ALL SELECT -1, 'export', 'high'")
def v61_audit_log(spark, d):
    """The log after one more record."""
    path = _path(spark, "audit")
    sinks.append(table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.lit("normal").alias("sensitivity")), path)
    sinks.append(spark.createDataFrame([(-1, "export", "high")], "event_id long, action string, sensitivity string"), path)
    return spark.read.parquet(path)


@query(sql("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 1"))
def v65_compacted(spark, d):
    """The vector store after heavy pruning, written anew into few files (v65, v66)."""
    path = _path(spark, "compact")
    table(spark, d, "embeddings").filter("vec_id % 3 != 1").repartition(2).write.parquet(path)
    return spark.read.parquet(path).select("vec_id")


@query(sql("SELECT outcome, count(*) AS n FROM queue WHERE NOT ignored GROUP BY 1", "queue"))
def v76_queue_counts(spark, d):
    return corpus.queue(spark, d).filter("not ignored").groupBy("outcome").agg(F.count("*").alias("n"))


@query(sql("SELECT 'ids' AS check_name, count(*) = count(DISTINCT id) AS ok FROM files UNION ALL SELECT 'paths', bool_and(path IS NOT NULL) FROM files UNION ALL SELECT 'hashes', bool_and(digest IS NOT NULL) FROM hashes WHERE state = 'OK'", "hashes"))
def v79_diagnostics(spark, d):
    part = lambda name, df, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("check_name"), "ok")
    out = part("ids", files(spark, d), F.count("*") == F.countDistinct("id")).unionByName(part("paths", files(spark, d), F.bool_and(F.col("path").isNotNull())))
    return out.unionByName(part("hashes", hashes(spark, d).filter("state = 'OK'"), F.bool_and(F.col("digest").isNotNull())))


@query(sql(f"WITH {_DOSSIER} SELECT count(*) AS members, min(id) AS first, max(id) AS last FROM dossier"))
def v81_dossier(spark, d):
    return _dossier(spark, d).agg(F.count("*").alias("members"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(sql(f"WITH {_DOSSIER} SELECT id, file_type AS section, row_number() OVER (PARTITION BY file_type ORDER BY id) - 1 AS position FROM dossier JOIN files USING (id)"))
def v83_dossier_sections(spark, d):
    rows = files(spark, d).join(_dossier(spark, d), "id", "left_semi").select("id", F.col("file_type").alias("section"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy("id")) - 1)


@query(sql(f"WITH {_DOSSIER} SELECT id FROM dossier WHERE id NOT IN (SELECT file_id FROM favourites)", "favourites"))
def v85_removed_members(spark, d):
    return _dossier(spark, d).join(corpus.favourites(spark, d).select(F.col("file_id").alias("id")), "id", "left_anti")


@query(sql(f"WITH {_DOSSIER} SELECT id, false AS dynamic FROM dossier"))
def v86_frozen(spark, d):
    """A frozen membership is a table of its own."""
    return sinks.replace(_dossier(spark, d), _path(spark, "frozen")).withColumn("dynamic", F.lit(False))


@query(sql("WITH a AS (SELECT digest FROM hashes WHERE file_id = 8 AND state = 'OK') SELECT file_id AS id FROM hashes WHERE digest IN (SELECT digest FROM a) AND state = 'OK' ORDER BY file_id LIMIT 100", "hashes"))
def v92_exact_group(spark, d):
    rows = hashes(spark, d).filter("state = 'OK'").select("file_id", "digest")
    return rows.join(rows.filter("file_id = 8").select("digest"), "digest", "left_semi").select(F.col("file_id").alias("id")).orderBy("id").limit(100)


@query(sql("SELECT name, count(*) AS files FROM tags JOIN file_tags USING (tag_id) GROUP BY 1", "tags", "file_tags"))
def v101_tag_counts(spark, d):
    counts = corpus.file_tags(spark, d).groupBy("tag_id").agg(F.count("*").alias("files"))
    return counts.join(F.broadcast(corpus.tags(spark)), "tag_id").select("name", "files")


@query(sql("SELECT id, extension IN ('.pdf') AND coalesce(length(content_text), 0) < 300 OR extension IN ('.jpg', '.png') AS candidate FROM files"))
def a32_image_candidates(spark, d):
    """What could be read from its image: documents with (here: little) text, and images that are asked for."""
    e = F.col("extension")
    return files(spark, d).select("id", ((e == ".pdf") & (F.coalesce(F.length("content_text"), F.lit(0)) < 300) | e.isin(".jpg", ".png")).alias("candidate"))


@query(sql(f"SELECT count(*) AS eligible, count(DISTINCT extension) AS kinds FROM files WHERE {ACTIVE} AND size_bytes BETWEEN 1 AND 52428800 AND extension IN ('.pdf', '.docx', '.txt', '.md', '.html', '.eml') AND id NOT IN (SELECT file_id FROM queue WHERE NOT ({_RETRY}))", "queue"))
def a35_extraction_batch(spark, d):
    return a51_eligible(spark, d).agg(F.count("*").alias("eligible"), F.countDistinct("extension").alias("kinds"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2)
SELECT count(*) AS postings, count(DISTINCT term) AS terms, (SELECT count(*) FROM documents) AS docs FROM p""")
def b4_bulk_index(spark, d):
    """The index of a whole load, built once and read back."""
    path = _path(spark, "bulk")
    search.save_index(table(spark, d, "documents").select("doc_id", "text"), path)
    rows = spark.read.parquet(f"{path}/postings")
    return rows.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms")).crossJoin(spark.read.parquet(f"{path}/corpus").select("docs"))


@query(sql("SELECT 'hashes' AS name, count(*) AS n FROM hashes UNION ALL SELECT 'queue', count(*) FROM queue", "hashes", "queue"))
def b26_backup(spark, d):
    """What a backup says that it holds."""
    path = _path(spark, "backup")
    sinks.backup({"hashes": hashes(spark, d), "queue": corpus.queue(spark, d)}, path)
    return spark.read.parquet(f"{path}/_sums").select("name", "n")


@query(sql(f"WITH {_FULL} SELECT id, score FROM found JOIN files USING (id) WHERE {ACTIVE} ORDER BY score DESC, {names.RANK_SQL}, modified_at DESC NULLS LAST, id LIMIT 20"))
def s6_served_search(spark, d):
    """The search that is served (s1, s5, s6): twenty results of the canonical entry."""
    from foliant.plans.retrieval import search_files

    return search_files(spark, files(spark, d, True), '"of the" re', 20)


@query(sql(f"WITH {_SIM} SELECT vec_id AS id, sim AS similarity FROM sims JOIN files ON id = vec_id WHERE {ACTIVE} ORDER BY sim DESC, vec_id LIMIT 10"))
def s7_served_vectors(spark, d):
    rows = _similar_to(spark, d).withColumnRenamed("vec_id", "id").join(files(spark, d).filter(store.active()).select("id"), "id", "left_semi")
    return rows.orderBy(F.desc("sim"), "id").limit(10).select("id", F.col("sim").alias("similarity"))


@query(sql(f"SELECT count(*) > 0 AS due, count(*) AS changes FROM files WHERE NOT ({ACTIVE}) AND id IN (SELECT vec_id FROM embeddings)"))
def v21_sweep_due(spark, d):
    """A sweep is due when vectors are held of files that are gone."""
    gone = files(spark, d).filter(~store.active()).select("id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return gone.agg((F.count("*") > 0).alias("due"), F.count("*").alias("changes"))


@query(sql("SELECT id, substr(sha256('other' || chr(31) || filename), 1, 24) <> substr(sha256('salt' || chr(31) || filename), 1, 24) AS differs FROM files"))
def v53_salt(spark, d):
    """The salt is a parameter: another one gives other fingerprints."""
    print_ = lambda salt: F.substring(F.sha2(F.concat(F.lit(salt + "\x1f"), "filename"), 256), 1, 24)
    return files(spark, d).select("id", (print_("other") != print_("salt")).alias("differs"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'travel' WHEN max(quality) = 1 THEN 'work_career' ELSE 'media' END AS category FROM labels GROUP BY 1")
def v55_set_override(spark, d):
    """Decisions after new ones were made for some documents."""
    old = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, "work_career").otherwise("media").alias("category"))
    return relational.upsert(old, old.filter("doc_id % 5 = 0").withColumn("category", F.lit("travel")), "doc_id")


@query(sql("SELECT id, CASE WHEN id % 6 = 1 THEN 'xx' ELSE lang END AS lang FROM files"))
def v60_set_language(spark, d):
    old = files(spark, d).select("id", "lang")
    return relational.upsert(old, old.filter("id % 6 = 1").withColumn("lang", F.lit("xx")), "id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def v66_removed_rows(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")


@query("SELECT vec_id, vec_id IN (2, 3, 5, 7, 11) AS refreshed FROM embeddings")
def v67_refreshed_list(spark, d):
    """An explicit list of documents is embedded again, the others stay."""
    rows = table(spark, d, "embeddings").select("vec_id")
    listed = spark.createDataFrame([(i,) for i in (2, 3, 5, 7, 11)], "vec_id long").withColumn("refreshed", F.lit(True))
    return rows.join(F.broadcast(listed), "vec_id", "left").select("vec_id", F.coalesce("refreshed", F.lit(False)).alias("refreshed"))


@query(sql("SELECT lang AS name, sha256('{\"language\":\"' || lang || '\"}') AS fingerprint, count(*) AS found FROM files WHERE lang IS NOT NULL GROUP BY 1"))
def v88_saved_queries(spark, d):
    """Saved queries (one a language) with the fingerprint of their JSON and what they find now."""
    rows = files(spark, d).filter("lang is not null").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("found"))
    return rows.select("name", F.sha2(F.to_json(F.struct(F.col("name").alias("language"))), 256).alias("fingerprint"), "found")


@query("SELECT o_orderpriority AS kind, count(*) AS definitions, min(o_orderkey) AS first FROM orders GROUP BY 1")
def v89_definitions(spark, d):
    """Report definitions (orders) by kind."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("definitions"), F.min("o_orderkey").alias("first"))
