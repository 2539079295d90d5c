"""Jobs over a folder of tables: python -m foliant search|hashes|derived|clusters --tables DIR [--out DIR].

search answers a query by words, by a vector, or by both; hashes finds copies and near copies; clusters groups vectors and names
topics; derived builds the layers that others need, in their order."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.validation import SearchParameters
from foliant.operators import search, vectors
from foliant.plans import corpus
from foliant.plans.galaxy import n23_build_clusters, n24_build_topics
from foliant.plans.records import o6_duplicates_report
from foliant.plans.retrieval import l7_near_duplicates, search_files
from foliant.plans.texts import k19_categories


def searched(spark: SparkSession, tables: str, query: str | None, mode: str = "lexical", limit: int = 20, probe: int = 0) -> DataFrame:
    """(id, score): by words; by the vector `probe`; or both fused."""
    SearchParameters(query, limit)
    files = corpus.files(spark, tables, True)
    if mode == "lexical":
        return search_files(spark, files, query, limit)
    store = corpus.table(spark, tables, "embeddings").withColumnRenamed("vec_id", "id")
    near = vectors.nearest(store, store.filter(F.col("id") == probe), "id", "embedding", 3 * limit).withColumnRenamed("similarity", "score")
    if mode == "semantic":
        return near.limit(limit)
    both = search.rrf(search.top(search_files(spark, files, query, 3 * limit), "score", "id", 3 * limit), search.top(near, "score", "id", 3 * limit), "id")
    return both.orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


#: Layers and what builds them, in the order in which they need each other.
LAYERS = {
    "hashes": corpus.hashes,
    "duplicates": o6_duplicates_report,
    "near_duplicates": l7_near_duplicates,
    "categories": k19_categories,
    "findings": corpus.pii,
    "clusters": n23_build_clusters,
    "topics": n24_build_topics,
}
JOBS = {"hashes": ("hashes", "duplicates", "near_duplicates"), "clusters": ("clusters", "topics"), "derived": tuple(LAYERS)}


def built(spark: SparkSession, tables: str, job: str, out: str) -> dict[str, int]:
    """Write the layers of a job; rows of each."""
    counts = {}
    for name in JOBS[job]:
        LAYERS[name](spark, tables).write.mode("overwrite").parquet(f"{out}/{name}")
        counts[name] = spark.read.parquet(f"{out}/{name}").count()
    return counts


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliant", description=__doc__)
    parser.add_argument("job", choices=["search", *JOBS])
    parser.add_argument("query", nargs="?")
    parser.add_argument("--tables", required=True)
    parser.add_argument("--mode", choices=["lexical", "semantic", "rerank"], default="lexical")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    if given.job == "search":
        searched(spark, given.tables, given.query, given.mode, given.limit).show(given.limit, False)
    elif not given.out:
        parser.error("--out is needed")
    else:
        print(built(spark, given.tables, given.job, given.out))


if __name__ == "__main__":
    main()
