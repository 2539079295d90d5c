"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="foliant-base-")
    return _own[app]


def folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """df written down and read back, so that iterations do not grow the plan and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores if its input has fewer parts than there are cores, as a small file is one part whatever
    its rows cost; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def in_order(df: DataFrame, order, name: str = "place") -> DataFrame:
    """df with a dense 0-based place in the given order, without one task that sorts all: ranges are sorted and written, and
    the rows of the ranges before are added."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    dealt = df.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()), "order")
    at = F.shiftright("_id", 33).alias("_range")
    counts = sorted(map(tuple, dealt.groupBy(at).count().collect()))  # a row a range, whose number is a setting
    before = [(r, sum(n for _, n in counts[:i])) for i, (r, _) in enumerate(counts)]
    starts = F.broadcast(spark.createDataFrame(before, "_range long, _before long"))
    return dealt.withColumn("_range", F.shiftright("_id", 33)).join(starts, "_range").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_range", "_before")
