"""A resumable job over files that arrive: batch by batch, with a stop file, at least once and without repeats in the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, stop: str | None = None, files: int = 1) -> bool:
    """Apply `work` to the files of `source` (Parquet) that no batch has had yet, `files` a batch; each batch replaces its own
    partition of `out`, so one that is run again changes nothing. Before a batch the stop file is looked for: if it is there,
    the job ends and the next run begins with that batch. Returns whether all was done."""

    def batch(rows: DataFrame, number: int) -> None:
        if stop and _there(spark, stop):
            raise InterruptedError("stopped")
        done = work(rows).withColumn("batch", F.lit(number))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if stop and _there(spark, stop):
            return False
        raise
    return True
