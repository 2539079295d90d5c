"""Filters over documents and their annotations, families of versions, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import names, scores
from foliant.functions import text as t
from foliant.operators.scratch import cut


def filtered(df: DataFrame, *conditions: Column, having: Sequence[DataFrame] = (), without: Sequence[DataFrame] = (), on: str = "doc_id") -> DataFrame:
    """Rows that meet all conditions, occur in every table of `having` and in none of `without`."""
    for c in conditions:
        df = df.filter(c)
    for other in having:
        df = df.join(other.select(on), on, "left_semi")
    for other in without:
        df = df.join(other.select(on), on, "left_anti")
    return df


def version_families(df: DataFrame, folder: str, name: str, id_: str, at: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(id, family, folder, stem, members, confidence, rank, is_primary) of files of one folder whose names have one stem, two
    at least. HIGH if two names or more have a marker; MEDIUM if a name has a version word, or two members are linked in
    `near` (src, dst); else UNORDERED. HIGH families are ordered by marker (dates and numbers as they are, names without one
    last) and time, others by time; then by identifier. The last one is primary."""
    time = F.coalesce(F.col(at).cast("string"), F.lit("")) if at else F.lit("")
    rows = df.select(F.col(id_).alias("id"), F.coalesce(folder, F.lit("")).alias("folder"), names.version_stem(F.col(name)).alias("stem"), names.version_marker(F.col(name)).alias("marker"), names.has_version_word(F.col(name)).alias("word"), time.alias("at"))
    rows = rows.filter("stem != ''")
    groups = rows.groupBy("folder", "stem").agg(F.count("*").alias("members"), F.count("marker").alias("marked"), F.max("word").alias("word")).filter("members >= 2")
    if near is not None:
        ends = rows.select("folder", "stem", "id")
        a, b = ends.select(F.col("id").alias("src"), F.struct("folder", "stem").alias("fa")), ends.select(F.col("id").alias("dst"), F.struct("folder", "stem").alias("fb"))
        linked = near.join(a, "src").join(b, "dst").filter("fa = fb").select("fa.*").distinct().withColumn("near", F.lit(True))
        groups = groups.join(linked, ["folder", "stem"], "left").withColumn("word", F.col("word") | F.coalesce("near", F.lit(False))).drop("near")
    groups = groups.withColumn("confidence", F.when(F.col("marked") >= 2, "HIGH").when(F.col("word"), "MEDIUM").otherwise("UNORDERED"))
    rows = rows.join(groups.select("folder", "stem", "members", "confidence"), ["folder", "stem"])
    marked = (F.col("confidence") == "HIGH") & F.col("marker").isNotNull()
    order = Window.partitionBy("folder", "stem").orderBy(F.when(marked, 0).otherwise(1), F.when(marked, F.col("marker.kind")), F.when(marked, F.col("marker.at")), "at", "id")
    rows = rows.withColumn("rank", F.row_number().over(order) - 1)
    return rows.select("id", names.family_key(F.col("folder"), F.col("stem")).alias("family"), "folder", "stem", "members", "confidence", "rank", (F.col("rank") == F.col("members") - 1).alias("is_primary"))


def simhash_pairs(df: DataFrame, id_: str, text: str, bands: int = 4, min_lexical: float = 0.6, least: int = 3) -> DataFrame:
    """(src, dst, lexical): pairs of different texts of `least` tokens at least that share a band of their SimHash and whose
    token sets' Jaccard similarity reaches the bound. Equal texts are one, named by their smallest identifier, so copies form
    no pairs. Bands of 16 bits keep buckets small; a shared band is found with the probability that the hashes agree there."""
    rows = df.select(F.col(id_).alias("id"), t.latin_tokens(F.col(text)).alias("w"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest")).filter(F.size("w") >= least)
    nodes = rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("w").alias("w"))
    nodes = cut(nodes, "texts").select("id", scores.simhash64(scores.shingles(F.col("w"))).alias("h"), F.array_distinct("w").alias("w"))
    nodes = cut(nodes, "simhash")
    keys = nodes.select("id", F.posexplode(scores.band_keys(F.col("h"), bands)).alias("band", "key"))
    pairs = keys.join(keys.withColumnRenamed("id", "dst"), ["band", "key"]).filter("id < dst").select(F.col("id").alias("src"), "dst").distinct()
    a, b = nodes.select(F.col("id").alias("src"), F.col("w").alias("wa")), nodes.select(F.col("id").alias("dst"), F.col("w").alias("wb"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", F.round(t.jaccard(F.col("wa"), F.col("wb")), 5).alias("lexical"))
    return both.filter(F.col("lexical") >= min_lexical)


def kmeans(df: DataFrame, id_: str, vector: str, k: int, seed: int = 0, steps: int = 20) -> DataFrame:
    """(id, cluster) by distributed k-means."""
    rows = df.filter(F.col(vector).isNotNull()).select(id_, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(id_, "cluster")


def second_differences(df: DataFrame, at: str, value: str) -> DataFrame:
    """Of an aggregated series: value before - 2 value + value after; the first and last step have none.
    The series has a row a step, not a row a record."""
    w = Window.orderBy(at)
    return df.select(at, (F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)).alias("bend")).filter("bend is not null")
