"""Filters, aggregates, joins, top-k, set differences and merges over document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.scratch import in_order


def size_ranges(df: DataFrame, size: str, bounds: Sequence[int]) -> DataFrame:
    """Counts of half-open ranges between bounds, the last one open; ranges without rows do not appear."""
    at = F.lit(None).cast("int")
    for i in range(len(bounds) - 1, -1, -1):
        at = F.when(F.col(size) >= bounds[i], F.coalesce(at, F.lit(i))) if i == len(bounds) - 1 else F.when((F.col(size) >= bounds[i]) & (F.col(size) < bounds[i + 1]), F.lit(i)).otherwise(at)
    return df.withColumn("size_range", at).filter("size_range is not null").groupBy("size_range").agg(F.count("*").alias("files"), F.sum(size).alias("total"))


def share(df: DataFrame, by: str) -> DataFrame:
    """Rows of each value and their percentage of all rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files").alias("all_files"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(by, "files", F.round(F.col("files") * 100 / F.col("all_files"), 4).alias("percent"))


def top_per_group(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def all_of(df: DataFrame, key: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """Keys that occur with every wanted value (relational division)."""
    return df.filter(F.col(value).isin(*wanted)).groupBy(key).agg(F.countDistinct(value).alias("n")).filter(F.col("n") == len(set(wanted))).select(key)


def one_to_one(df: DataFrame, key: Sequence[str], id_: str) -> DataFrame:
    """Pairs of rows that are the only two with their key, smaller id first."""
    pairs = df.groupBy(*key).agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("second_id"))
    return pairs.filter("n = 2").select("first_id", "second_id")


def range_pairs(df: DataFrame, key: str, id_: str, at: str, seconds: int) -> DataFrame:
    """Pairs of rows of a key at most so many seconds apart, by equal or neighbouring time buckets."""
    rows = df.select(key, id_, at).withColumn("second", F.unix_micros(F.col(at).cast("timestamp")))
    width = seconds * 1_000_000
    left = rows.withColumn("bucket", F.floor(F.col("second") / width))
    right = left.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    right = right.select(F.col(key), F.col("bucket"), F.col(id_).alias("other_id"), F.col("second").alias("other_second"))
    near = left.join(right, [key, "bucket"]).filter((F.col(id_) < F.col("other_id")) & (F.abs(F.col("second") - F.col("other_second")) <= width))
    return near.select(key, id_, "other_id", (F.abs(F.col("second") - F.col("other_second")) / 1_000_000).alias("apart"))


def calendar(df: DataFrame, at: str) -> DataFrame:
    """Rows a day, with days without rows as 0, from the first day to the last."""
    days = df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    every = span.select(F.explode(F.sequence("low", "high", F.expr("interval 1 day"))).alias("day"))
    return every.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Target with the updates' rows in place of its own; new keys are added."""
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """(key, change): added, removed, changed or same."""
    a, b = before.alias("a"), after.alias("b")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kind = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(changed, "changed").otherwise("same")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change"))


def percentile_by_index(df: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles as the value at index int(n * p) of the sorted values. Rows are sorted in ranges over all groups, so a group of
    any size is dealt over tasks; a group's first place and size, a row a group, tell which places are asked for."""
    at = in_order(df.select(by, value), [F.col(by), F.col(value)])
    groups = at.groupBy(by).agg(F.count("*").alias("n"), F.min("place").alias("start"))
    index = lambda p: F.col("start") + F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    wanted = groups.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("point"), index(p).alias("place")) for name, p in points.items()])).alias("w"))
    found = at.join(wanted.select("n", "w.point", "w.place"), "place")
    return found.groupBy(by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("point") == name, F.col(value))).alias(name) for name in points])


#: A table is broadcast only if it has at most so many rows of a few numbers and a key, and keys of so many bytes on average.
BROADCAST_ROWS, KEY_BYTES = 50_000, 100


def frequent(table: DataFrame, key: str, count: str) -> tuple[DataFrame, int]:
    """The table's rows of frequent keys, to be broadcast, and the largest count among the others. A key is frequent if it has more
    than one in BROADCAST_ROWS of all that is counted, so there are fewer than that, and is no longer than KEY_BYTES."""
    total = table.agg(F.sum(count)).first()[0] or 0
    often = F.coalesce((F.col(count) * BROADCAST_ROWS > total) & (F.octet_length(F.col(key).cast("string")) <= KEY_BYTES), F.lit(False))
    return table.filter(often), table.filter(~often).agg(F.max(count)).first()[0] or 0


def looked_up(df: DataFrame, table: DataFrame, on: str, count: str | None = None) -> DataFrame:
    """df joined with a table of one row a key: broadcast if it is small; else only its rows of frequent keys are, and the rows of df
    with other keys are shuffled, of which no key has many. count: the table's column with a key's rows in df; else they are counted."""
    from foliant.operators.scratch import cut

    table = cut(table, "lookup")
    rows, size = table.agg(F.count("*"), F.sum(F.octet_length(F.col(on).cast("string")))).first()
    if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_ROWS * KEY_BYTES:
        return df.join(F.broadcast(table), on)
    counted = table if count else cut(df.groupBy(on).agg(F.count("*").alias("_rows")), "lookup")
    keys = frequent(counted, on, count or "_rows")[0].select(on)
    shuffled = table.hint("merge")  # else a table of short keys would be broadcast by its size on disk
    if keys.isEmpty():
        return df.join(shuffled, on)
    often = df.join(F.broadcast(table.join(F.broadcast(keys), on, "left_semi")), on)
    return often.unionByName(df.join(F.broadcast(keys), on, "left_anti").join(shuffled, on))
