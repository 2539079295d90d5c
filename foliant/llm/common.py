"""What the operators of this subpackage share: scratch tables in the shared folder, size-checked
joins, distributed ranks, and word hashing over whole batches of text."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A side of a join is broadcast only if its measured size is at most so many bytes.
BROADCAST_BYTES = 48 << 20

#: One batch that goes to a Python worker: rows and bytes. Long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_own: dict[str, str] = {}


def batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; dealt over all cores if its file has fewer parts than there are cores."""
    batches(spark)
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/llm/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables and tar shards. Results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/llm")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. Lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Measured bytes of a materialised table in memory, from its rows: 16 a fixed column, texts and blobs by length."""
    size: Column = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised right side: broadcast if its measured size is within the limit, else shuffled
    (adaptive execution then splits skewed partitions)."""
    if table_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def partitions(df: DataFrame) -> int:
    """Partitions in which a scan deals df out: it grows with the input's bytes."""
    return df.rdd.getNumPartitions()


def ranked(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """df with a dense 0-based rank in the given order, without bringing rows together: range-sort,
    write, count each range, add the counts of the ranges before. Ties split over ranges only if the order has them."""
    spark = df.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_range", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    dealt = materialise(dealt, tag)
    counts = sorted(dealt.groupBy("_range").count().collect())  # a row for each range, whose number is a setting
    before, rows = 0, []
    for at, n in counts:
        rows.append((at, before))
        before += n
    schema = StructType([StructField("_range", dealt.schema["_range"].dataType), StructField("_before", LongType())])
    starts = F.broadcast(spark.createDataFrame(rows, schema))
    return dealt.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def numbered(df: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """(doc_id, text, doc): doc is the identifier if it is unique and never null, else a row number that is written down.
    whole: and the row itself, packed as `row`, so that no column of df can clash."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole else []))
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    return materialise(rows.withColumn("doc", F.monotonically_increasing_id()), "numbered")


# --- words and hashes over a batch of texts -------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = done * 2, step * step & _MASK
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, times a power of the inverse base, are polynomial hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(_BASE_INV, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def groups_of_texts(texts: list[bytes], most: int = 1 << 18):
    """Runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t) + 1
    if run:
        yield run


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, i.e. maximal runs of bytes other than 9-13 and 32, of a run of texts: (joined bytes, start, end,
    first word of each text and of the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_SPACE[joined]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return joined, starts, ends, first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin."""
    joined, starts, ends, first = words_of(texts)
    return span_hashes(prefix_sums(joined), starts, ends), first


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- vectors that every task adds to ----------------------------------------------------------------------

CHUNKS = 16


def vector_rows(vectors: dict[str, np.ndarray]):
    """A task's vectors in pieces, for summed()."""
    import pyarrow as pa

    for name, v in vectors.items():
        for i, piece in enumerate(np.array_split(v.astype(np.float64, copy=False), CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([piece.tobytes()])], names=["name", "piece", "data"])


VECTORS = "name string, piece int, data binary"


def _add(batches_):
    import pyarrow as pa

    sums: dict[tuple, np.ndarray] = {}
    for batch in batches_:
        for name, piece, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.frombuffer(data, np.float64)
            if (name, piece) in sums:
                sums[name, piece] += v
            else:
                sums[name, piece] = v.copy()
    for (name, piece), v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece], pa.int32()), pa.array([v.tobytes()])], names=["name", "piece", "data"])


def summed(df: DataFrame) -> dict[str, np.ndarray]:
    """The sums of the tasks' vectors. What is shuffled grows with the tasks; what comes back is one vector a name."""
    out: dict[str, dict[int, np.ndarray]] = {}
    for name, piece, data in df.repartition(CHUNKS, "name", "piece").mapInArrow(_add, VECTORS).collect():
        out.setdefault(name, {})[piece] = np.frombuffer(bytes(data), np.float64)
    return {name: np.concatenate([v[i] for i in sorted(v)]) for name, v in out.items()}
