"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. A source stops at a maximum number of epochs (times its
own size); what it leaves is shared again among the others by weight, until no source is above its cap. The
fixed point is a water level: sort sources by cap / weight; a source is capped if the level that the sources
from it on would reach is above its own ratio. A window over the per-source sums finds it in one pass.

Sampling: a source whose target is e times its size gives every document floor(e) whole times, and the rest
(e - floor(e)) by a seeded order of its documents: the prefix of that order whose words come nearest is taken
once more. The prefix is found without bringing a source's rows together: documents are summed by 65,536
hash buckets a source, a window over those sums finds the bucket where the target falls, and only the rows of
that bucket are ordered.

Only DataFrame functions are used. Defined cases: a null text or one without words has size 0 and adds
nothing; a null source is a source of its own, ordered last; repeated rows are rows of their own; an empty
table gives an empty table; columns that clash with computed names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialise

BUCKETS = 65_536


def word_count(text: Column) -> Column:
    """Runs of characters other than 9-13 and 32."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """32 bits of an MD5 over seed and key: reruns agree, on any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """sizes: (source, source_size). Returns them with weight and target. Weights repeat over the sources by code point, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    capped = F.col("level") * F.col("weight") >= F.col("cap")
    rows = rows.withColumn("water", F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    rows = rows.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", "weight", "target")


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): copies is how often the mix holds the row."""
    slim = df.select(F.col(key), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    slim = slim.withColumn("_h", seeded(F.col(key), seed)).withColumn("_bucket", F.shiftright("_h", 16))
    slim = materialise(slim, "mix")
    buckets = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("words"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = materialise(targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-targets")
    in_order = Window.partitionBy("source").orderBy("_bucket")
    sums = buckets.withColumn("_before", F.sum("words").over(in_order) - F.col("words"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    t = targets.alias("t")
    # The bucket of each source in which its rest ends; sources, so few rows.
    edge = sums.alias("s").join(t, same("s", "t") & (F.col("s._before") <= F.col("t._rest")))
    edge = edge.groupBy(F.col("s.source").alias("source")).agg(F.max(F.struct("s._bucket", "s._before")).alias("edge"))
    rule = t.join(edge.alias("e"), same("t", "e"), "left").select("t.*", F.col("e.edge._bucket").alias("_edge"), F.col("e.edge._before").alias("_edge_before"))
    rows = slim.alias("d").join(rule.alias("r"), same("d", "r")).select("d.*", *[f"r.{c}" for c in ("source_size", "target", "_whole", "_rest", "_edge", "_edge_before")])
    below = rows.filter(F.col("_bucket") != F.col("_edge")).withColumn("_once", (F.col("_bucket") < F.col("_edge")).cast("long"))
    within = Window.partitionBy("source").orderBy("_h", F.col(key), "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.filter(F.col("_bucket") == F.col("_edge"))
    sofar = F.col("_edge_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    at = at.withColumn("_once", (sofar * 2 + F.col("size") <= F.col("_rest") * 2).cast("long"))
    copies = F.least(F.col("_whole") + F.col("_once"), F.lit(math.ceil(epochs))).cast("long")
    out = below.unionByName(at).withColumn("copies", copies)
    return out.select(F.col(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_text")


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of df with all their columns, each as often as the mix holds it."""
    key = options.get("key", "doc_id")
    names = ["_key", "_source", "_size", "_hash"]
    picked = mix(df, **options).select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_text").alias("_hash"), "copies")
    picked = materialise(picked.groupBy(*names).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "mix-picked")
    marked = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("_key"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_hash"))
    a, b = marked.alias("a"), picked.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]).select("a.*", "_copies", "_rows")
    single = joined.filter("_rows = 1")
    # Rows that repeat with key, source and text share their copies evenly.
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("_rows"))
    repeated = joined.filter("_rows > 1").withColumn("_copies", F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("long"))
    both = single.unionByName(repeated).filter("_copies > 0")
    return both.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
