"""Lexical search, fusion of rankings, chunks and retrieval metrics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import spaced, spaced_count, spaced_size, tokens
from foliant.operators.scratch import cut

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Query:
    phrases: tuple[tuple[str, ...], ...]
    prefixes: tuple[str, ...]
    exact: tuple[str, ...]


def parse_query(text: str) -> Query | None:
    """Quoted parts are phrases, bare words of two characters or more are prefixes, single characters are exact;
    all must match. Operators are ordinary words; None if nothing is left."""
    phrases, prefixes, exact = [], [], []
    for quoted, bare in re.findall(r'"([^"]*)"|([^"\s]+)', text or ""):
        words = re.findall(r"\w+", (quoted or bare).lower())
        if quoted and words:
            phrases.append(tuple(words))
        elif not quoted:
            for w in words:
                (prefixes if len(w) > 1 else exact).append(w)
    return Query(tuple(phrases), tuple(prefixes), tuple(exact)) if phrases or prefixes or exact else None


def _begins(prefix: str):
    return lambda word: word.startswith(prefix)


def matches(words: Column, query: Query) -> Column:
    """Whether a token array satisfies a query."""
    ok = F.lit(True)
    for p in query.prefixes:
        ok = ok & F.exists(words, _begins(p))
    for e in query.exact:
        ok = ok & F.array_contains(words, e)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for phrase in query.phrases:
        ok = ok & F.contains(joined, F.lit(" " + " ".join(phrase) + " "))
    return ok


def postings(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, len): the inverted index, a row a document and term."""
    words = df.select(id_, tokens(F.col(text)).alias("words")).select(id_, F.size("words").alias("len"), F.explode("words").alias("term"))
    return words.groupBy("term", id_, "len").agg(F.count("*").alias("tf"))


def _bucket(term: str, buckets: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % buckets


def save_index(df: DataFrame, path: str, id_: str = "doc_id", text: str = "text", buckets: int = 64) -> None:
    """Write the postings, each with the number of documents of its term, in buckets by term, so that a search reads the buckets of
    its terms only; and the corpus' counts."""
    rows = cut(postings(df, id_, text), "postings")
    each = rows.groupBy("term").agg(F.count("*").alias("df"))
    bucket = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long") % buckets
    rows = rows.join(each, "term").withColumn("bucket", bucket.cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    words = rows.groupBy(id_).agg(F.first("len").alias("n")).agg(F.sum("n").alias("words"))
    sizes = df.agg(F.count("*").alias("docs")).crossJoin(words)
    sizes.select("docs", (F.coalesce("words", F.lit(0)) / F.greatest("docs", F.lit(1))).alias("mean_len")).write.mode("overwrite").parquet(f"{path}/corpus")


def updated_index(index: DataFrame, changed: DataFrame, gone: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings after documents were changed or removed: theirs go, and the changed ones' new ones come."""
    out = changed.select(id_).unionByName(gone.select(id_))
    return index.join(out, id_, "left_anti").unionByName(postings(changed, id_, text).select(index.columns))


@dataclass(frozen=True)
class Index:
    """A saved index and the corpus' counts, which are read once."""

    path: str
    id_: str
    buckets: int
    docs: int
    mean_len: float

    def postings(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        """Rows of some terms; sorted files and buckets leave little to read."""
        schema = f"term string, {self.id_} long, len int, tf long, df long, bucket int"
        rows = spark.read.schema(schema).parquet(f"{self.path}/postings")
        return rows.filter(F.col("bucket").isin(*{_bucket(t, self.buckets) for t in terms}) & F.col("term").isin(*terms))


def open_index(spark: SparkSession, path: str, id_: str = "doc_id", buckets: int = 64) -> Index:
    docs, mean_len = spark.read.parquet(f"{path}/corpus").first()
    return Index(path, id_, buckets, docs, mean_len)


def search_index(spark: SparkSession, index: Index, terms: Sequence[str]) -> DataFrame:
    """(id, score) by BM25 of documents that hold every term, from a saved index: one pass over the postings of the terms."""
    terms = list(dict.fromkeys(terms))
    idf = F.log((index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(index.mean_len))))
    scored = index.postings(spark, terms).groupBy(index.id_).agg(F.count("*").alias("n"), F.sum(part).alias("score"))
    return scored.filter(F.col("n") == len(terms)).select(index.id_, F.round("score", 6).alias("score"))


def bm25(df: DataFrame, terms: Sequence[str], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of documents that hold every term. Texts are read once: the counts of each, a few numbers, are written
    down, and the corpus' statistics come from them."""
    terms = list(dict.fromkeys(terms))
    rows = df.select(id_, spaced(F.col(text)).alias("s"))
    rows = cut(rows.select(id_, spaced_size(F.col("s")).alias("len"), *[spaced_count(F.col("s"), t).alias(f"tf{i}") for i, t in enumerate(terms)]), "bm25")
    return _scored(rows, id_, len(terms))


def full_text(df: DataFrame, query: Query, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) by BM25 of documents that satisfy a query. A prefix is a term whose documents are those with any word
    that begins so; a phrase is a term whose occurrences are its places."""
    rows = df.select(id_, spaced(F.col(text)).alias("s"))
    counts = [spaced_count(F.col("s"), p, True) for p in query.prefixes] + [spaced_count(F.col("s"), e) for e in query.exact]
    counts += [spaced_count(F.col("s"), "  ".join(phrase)) for phrase in query.phrases]
    rows = cut(rows.select(id_, spaced_size(F.col("s")).alias("len"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)]), "search")
    return _scored(rows, id_, len(counts))


def _scored(rows: DataFrame, id_: str, n: int) -> DataFrame:
    stats = rows.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)])
    both = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(n):
        both = both.filter(F.col(f"tf{i}") > 0)
        idf = F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    return both.select(id_, F.round(score, 6).alias("score"))


def top(df: DataFrame, score: str, id_: str, k: int) -> DataFrame:
    """The k best with their place; ties by id."""
    best = df.orderBy(F.col(score).desc(), id_).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), id_)))


def rrf(first: DataFrame, second: DataFrame, id_: str, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (id, place)."""
    a, b = first.select(id_, F.col("place").alias("p1")), second.select(id_, F.col("place").alias("p2"))
    part = lambda p, w: F.coalesce(F.lit(w) / (k + F.col(p)), F.lit(0.0))
    return a.join(b, id_, "full_outer").select(id_, "p1", "p2", F.round(part("p1", weights[0]) + part("p2", weights[1]), 8).alias("score"))


def relevance(df: DataFrame, query: str, name: str, path: str, text: str) -> Column:
    """Additive: phrase in name 10, path 3, content 2; shared words 3, 1 and 0.5 each."""
    phrase, words = query.lower(), F.array(*[F.lit(w) for w in query.lower().split()])
    total = F.lit(0.0)
    for column, whole, each in ((name, 10.0, 3.0), (path, 3.0, 1.0), (text, 2.0, 0.5)):
        value = F.lower(F.coalesce(F.col(column), F.lit("")))
        total = total + F.when(F.contains(value, F.lit(phrase)), F.lit(whole)).otherwise(F.lit(0.0))
        total = total + F.size(F.array_intersect(words, tokens(F.col(column)))) * F.lit(each)
    return total


def chunks(df: DataFrame, id_: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """(id, chunk, start, length, body): stretches of `size` characters that overlap."""
    rows = df.select(id_, F.coalesce(F.col(text), F.lit("")).alias("t")).filter("length(t) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - overlap) / (size - overlap)) - 1).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk") * (size - overlap)
    return rows.select(id_, "chunk", start.alias("start"), F.substring("t", start + 1, F.lit(size)).alias("body")).withColumn("length", F.length("body"))


def retrieval_metrics(found: DataFrame, query: str, place: str, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """found: place of the relevant document of each query, null if it was not found. Recall at k and MRR."""
    return found.agg(*[F.avg((F.coalesce(F.col(place) <= k, F.lit(False))).cast("double")).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1 / F.col(place), F.lit(0.0))).alias("mrr"))


def fused(lexical: DataFrame, semantic: DataFrame, id_: str, exact: DataFrame, digests: DataFrame | None = None, families: DataFrame | None = None, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), limit: int = 20) -> DataFrame:
    """(id, p1, p2, score, place): rankings (id, place) fused, with half a point for ids in `exact` (their name and path hold all
    words); of equal digests (id, digest) and of each family (id, family) the first one stays; ties by the lexical place, then
    the semantic one, then id. Rankings are bounded lists, so the last window holds a few rows."""
    both = rrf(lexical, semantic, id_, k, weights).join(exact.select(id_, F.lit(0.5).alias("bonus")), id_, "left")
    both = both.withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 8)).drop("bonus")
    far = F.lit(10**9)
    order = [F.col("score").desc(), F.coalesce("p1", far), F.coalesce("p2", far), F.col(id_)]
    for table, column in ((digests, "digest"), (families, "family")):
        if table is not None:
            both = both.join(table.select(id_, F.col(column).cast("string").alias("_g")), id_, "left")
            own = F.coalesce("_g", F.concat(F.lit("id:"), F.col(id_).cast("string")))
            both = both.withColumn("_first", F.row_number().over(Window.partitionBy(own).orderBy(*order))).filter("_first = 1").drop("_first", "_g")
    best = both.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))
