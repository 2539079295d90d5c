"""Lifecycle of indexed rows: reconciliation with a scan, memberships, retry queue and thread keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import scores


def reconciled(known: DataFrame, seen: DataFrame, key: str, parent: str | None = None, levels: int = 8) -> DataFrame:
    """Rows of `known` (key, state, ...) that a scan has not seen become MISSING, those it has ACTIVE. With `parent`,
    the members of a missing row are missing too, through at most `levels` levels of nesting."""
    marks = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    out = known.join(marks, key, "left").withColumn("state", F.when(F.col("_seen"), "ACTIVE").otherwise("MISSING")).drop("_seen")
    if parent:
        nodes = out.select(F.col(key).alias("_up"), F.col(parent).alias("_next"), (F.col("state") == "MISSING").alias("_gone"))
        for _ in range(levels):  # every turn looks one level higher
            out = out.withColumn("_at", F.col("_at") if "_at" in out.columns else F.col(parent))
            out = out.join(nodes, F.col("_at") == F.col("_up"), "left").withColumn("state", F.when(F.col("_gone"), "MISSING").otherwise(F.col("state"))).withColumn("_at", F.col("_next")).drop("_up", "_next", "_gone")
        out = out.drop("_at")
    return out


def membership(chosen: DataFrame, excluded: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """(chosen - excluded) + pinned, each key once."""
    return chosen.select(key).join(excluded.select(key), key, "left_anti").unionByName(pinned.select(key)).distinct()


def retry_queue(attempts: DataFrame, key: str, outcome: str, most: int = 3) -> DataFrame:
    """(key, attempts, outcome, retry, wait_seconds): attempts are counted, the outcome is the largest by name."""
    rows = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.max(outcome).alias("outcome"))
    return rows.withColumn("retry", scores.retryable(F.col("outcome"), F.col("attempts"), most)).withColumn("wait_seconds", scores.backoff_seconds(F.col("attempts")))


def thread_key(*ids: Column) -> Column:
    """From the first identifier that is neither null nor empty: thread: and 16 places of its SHA-1."""
    return F.concat(F.lit("thread:"), F.substring(F.sha1(F.coalesce(*[F.when(i != "", i) for i in ids])), 1, 16))


def freshness_signature(*parts: Column) -> Column:
    """32 places of the SHA-256 of the parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)
