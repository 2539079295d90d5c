"""Quality classifier by importance resampling.

Two generative models over hashed n-grams: one of the raw text (all documents), one of the target (documents
labelled good). A document's importance weight is the log ratio of its probability under both. Features are
words, pairs of words, and pairs of word shapes (which letters, digits and symbols a word is made of, and
whether it repeats the word before it), all hashed into one table. The target model is smoothed towards the
raw model with a fixed pseudo-count a bucket, so an n-gram that says nothing weighs nothing.

Documents are sampled by Gumbel top-k: seeded Gumbel noise is added to the log weight and the k largest stay,
which samples without replacement in proportion to the weights. k is the number of documents on the target's
side of the threshold that parts good from bad labelled documents best.

Raw counts cover all documents; target counts cover all labelled documents, without a sample. What the driver
receives is one vector of counts (a parameter's size), and a histogram of labelled scores of fixed size.

Defined cases: a null or empty text has weight 0; a document without a label takes part in raw counts only;
without labels the threshold is 0; repeated labels of a document count once, the best one; repeated rows are
rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, VECTORS, groups_of_texts, materialise, mix, numbered, prefix_sums, ranked, sized_join, span_hashes, summed, text_bytes, vector_rows, words_of

BUCKETS = 1 << 18
NO_ID = -(1 << 63)
PSEUDO = 20.0


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each n-gram of a run of texts, and the words of each text."""
    joined, starts, ends, first = words_of(texts)
    n = len(starts)
    hashes = span_hashes(prefix_sums(np.frombuffer(joined.tobytes().translate(LOWER), np.uint8)), starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    within = lambda low, high: np.concatenate([[0], np.cumsum((joined >= low) & (joined <= high))])
    upper, lower, digits, wide = within(65, 90), within(97, 122), within(48, 57), within(128, 255)
    count = lambda sums: sums[ends] - sums[starts]
    u, l, d = count(upper), count(lower) + count(wide), count(digits)
    most = lambda x: np.minimum(x, 2)
    shape = ((most(u) * 3 + most(l)) * 3 + most(d)) * 3 + most(ends - starts - u - l - d)
    ok = np.zeros(n, bool)
    ok[1:] = owner[1:] == owner[:-1]
    last = np.flatnonzero(ok)
    pairs = mix(hashes[last] * np.uint64(3) + hashes[last - 1] * np.uint64(7))
    again = (hashes[last] == hashes[last - 1]).astype(np.int64)
    shapes = mix(((shape[last - 1] * 81 + shape[last]) * 2 + again).astype(np.uint64) + np.uint64(1 << 40))
    bucket = (np.concatenate([hashes, pairs, shapes]) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.concatenate([owner, owner[last], owner[last]]), np.diff(first)


def _count(buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for batch in rows:
            texts, good = text_bytes(batch.column(0)), np.array([x == 1 for x in batch.column(1).to_pylist()], bool)
            for run_ in groups_of_texts(texts):
                bucket, owner, _ = features([texts[i] for i in run_], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[run_][owner]], minlength=buckets)
        if raw.any():
            yield from vector_rows({"raw": raw, "target": target})

    return run


def log_ratio(raw: np.ndarray, target: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + pseudo) / (expected + pseudo))


SCORES = "doc_id long, label int, n_words long, log_weight double"


def _score(table):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(table.value, np.float64)
        for batch in rows:
            texts = text_bytes(batch.column(2))
            score, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for run_ in groups_of_texts(texts):
                bucket, owner, n = features([texts[i] for i in run_], len(ratio))
                score[run_] = np.bincount(owner, weights=ratio[bucket], minlength=len(run_))
                words[run_] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(score)], names=[c.split()[0] for c in SCORES.split(", ")])

    return run


#: Labelled scores are counted in bins of asinh(score) * 16.
BINS = 16


def threshold(scores: DataFrame) -> float:
    """The score that parts labelled documents best (balanced accuracy): the middle of the best stretch of bins."""
    bins = scores.filter("label is not null").groupBy(F.floor(F.asinh("log_weight") * BINS).cast("int").alias("bin"), "label").count().collect()  # some hundred bins
    good, bad = {b: n for b, y, n in bins if y == 1}, {b: n for b, y, n in bins if y == 0}
    if not good or not bad:
        return 0.0
    marks = sorted({*good, *bad})
    at = lambda t: sum(n for b, n in good.items() if b >= t) / sum(good.values()) + sum(n for b, n in bad.items() if b < t) / sum(bad.values())
    best = max(at(t) for t in marks)
    first = next(i for i, t in enumerate(marks) if at(t) == best)
    below = marks[first - 1] + 1 if first else marks[0]
    return float(np.sinh((below + marks[first]) / 2 / BINS))


def labelled(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))


def scores(df: DataFrame, labels: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> DataFrame:
    """(doc_id, label, n_words, log_weight) a row of df; labels: (doc_id, quality 0 or 1)."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = sized_join(rows, materialise(labelled(labels).filter("doc_id is not null"), "labels"), "doc_id", "left").select("doc_id", "label", "text")
    sums = summed(rows.select("text", "label").mapInArrow(_count(buckets), VECTORS))
    raw, target = (sums.get(k, np.zeros(buckets)) for k in ("raw", "target"))
    table = df.sparkSession.sparkContext.broadcast(log_ratio(raw, target, pseudo).tobytes())  # 8 bytes a bucket
    return materialise(rows.mapInArrow(_score(table), SCORES), "quality")


def gumbel(key, seed: int):
    """Seeded Gumbel noise from 32 bits of an MD5."""
    text = F.concat(F.lit(f"gumbel {seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return -F.log(-F.log(u))


def resample(df: DataFrame, labels: DataFrame, seed: int = 11, **options) -> DataFrame:
    """scores() with perturbed, rank (0 is the best) and kept."""
    scored = scores(df, labels, **options)
    k = scored.filter(F.col("log_weight") >= threshold(scored)).count()
    keyed = scored.withColumn("perturbed", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    out = ranked(keyed, [F.col("perturbed").desc(), F.col("doc_id").asc_nulls_last()], "rank", "gumbel")
    return out.withColumn("kept", F.col("rank") < k)


def kept_rows(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of df that the sample keeps, with all their columns, whatever these are called. Rows that repeat an identifier
    stay or go with the best of them."""
    numbers = numbered(df, "doc_id", "text", whole=True)
    best = resample(numbers.select("doc_id", "text"), labels, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    kept = materialise(best.filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("at")), "quality-kept")
    return sized_join(numbers.withColumn("at", F.coalesce("doc_id", F.lit(NO_ID))), kept, "at", "left_semi").select("row.*")
