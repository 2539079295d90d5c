"""Edges, degrees, components, PageRank, and priority from document relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.scratch import cut


def shared_key_degree(df: DataFrame, id_: str, key: str) -> DataFrame:
    """Neighbours by an equal key: the group's size less one. No pair is formed."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return df.join(sizes, key, "left").select(id_, (F.coalesce("n", F.lit(1)) - 1).alias("degree"))


def neighbours(df: DataFrame, by: list[str], id_: str, order: list, most: int) -> DataFrame:
    """(src, dst): each row with the first `most` others of its group. Only a group's first rows are joined, so a group of any
    size gives at most `most` rows a member and no pair is formed beyond them."""
    key = F.struct(*by)
    rows = df.filter(" and ".join(f"{c} is not null" for c in by)).withColumn("_by", key)
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= most + 1)
    pairs = rows.select(F.col(id_).alias("src"), "_by").join(first.select("_by", F.col(id_).alias("dst"), "_place"), "_by").filter("src != dst")
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("src", "_by").orderBy("_place"))).filter(F.col("_n") <= most)
    return ranked.select("src", "dst", *[F.col(f"_by.{c}").alias(c) for c in by])


def reached(edges: DataFrame, start: DataFrame, depth: int, most: int) -> DataFrame:
    """(id, depth): nodes within `depth` steps of the start nodes over directed edges (a, b), at most `most`, nearest first,
    then by id. Each step is an anti join with the nodes seen."""
    seen = cut(start.select("id", F.lit(0).alias("depth")))
    for step in range(1, depth + 1):
        new = edges.join(seen.filter(F.col("depth") == step - 1).select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        seen = cut(seen.unionByName(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(step))).orderBy("depth", "id").limit(most))
    return seen


def degrees(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(id, degree, weighted): edges at a node, and the weights of those that leave it."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("id"), F.col(weight).alias("w")), F.struct(F.col(b).alias("id"), F.lit(0.0).alias("w")))).alias("e")
    return edges.select(ends).groupBy(F.col("e.id").alias("id")).agg(F.count("*").alias("degree"), F.sum("e.w").alias("weighted"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) by least labels with pointer jumping, until a step changes nothing; edges (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, "id", "left").join(hop, "component", "left").select("id", F.least("component", F.coalesce("near", "component"), F.coalesce("far", "component")).alias("component"))
        new = cut(new)
        settled = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component != old").isEmpty()
        labels = new
        if settled:
            return labels


#: Edges of one node that lie together, at most, and of one partition, on average.
NODE_EDGES, PART_EDGES = 100_000, 3_000_000

#: Steps that the next start of PageRank is drawn from.
STEPS_BACK = 4


def _numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, k), distinct edges (a, b) by k). k is a hash of the identifier under the first seed that gives no two nodes the same."""
    ids = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    for seed in range(100):
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
        nodes = ids.withColumn("k", number("id"))
        if nodes.groupBy("k").count().filter("count > 1").isEmpty():
            return nodes, cut(edges.select(number("a").alias("a"), number("b").alias("b")).distinct(), "edges")
    raise ValueError("no seed tells the nodes apart")


def _weights(dots: np.ndarray) -> list[float]:
    """Weights, one in sum, under which the combined changes are least; dots: inner products of the changes."""
    scale = np.sqrt(np.maximum(np.diag(dots), 1e-300))
    found = np.linalg.lstsq(dots / np.outer(scale, scale) + 1e-12 * np.eye(len(dots)), 1 / scale, rcond=None)[0] / scale
    return (found / found.sum()).tolist() if np.isfinite(found).all() and abs(found.sum()) > 1e-12 * np.abs(found).sum() else [0.0] * (len(dots) - 1) + [1.0]


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(id, rank) over directed edges (a, b); what dangling nodes hold is spread evenly. Steps end when the ranks
    change by less than the tolerance in sum; ValueError if they do not within `iterations`.

    A step starts from that combination of the last steps' results whose change would be least (Anderson's acceleration), which
    leaves the test and its bound of the error as they are: a step shrinks any error to alpha of it. Once a step changes
    more than the one before, the rest are plain. Edges are dealt by their start and sorted once and kept so; a node's edges lie at
    several places if they are many."""
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes, edges = _numbered_edges(edges)
    outs = edges.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("out")).withColumn("places", F.ceil(F.col("out") / NODE_EDGES).cast("int"))
    nodes = cut(nodes.join(outs, "k", "left"), "nodes")
    n, hang, total = nodes.agg(F.count("*"), F.count("*") - F.count("out"), F.coalesce(F.sum("out"), F.lit(0))).first()
    if not n:
        return nodes.select("id", F.lit(1.0).alias("rank"))
    hubs = F.broadcast(nodes.filter("places > 1").select(F.col("k").alias("a"), "places"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_EDGES))
    place = F.when(F.col("places").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("places"))).cast("int")
    held_edges = edges.join(hubs, "a", "left").select("a", place.alias("place"), "b").repartition(parts, "a", "place").sortWithinPartitions("a", "place").persist()
    try:
        # x: where the step starts; g and f: results and changes of the last steps
        state, start = nodes.withColumns({"g": F.array().cast("array<double>"), "f": F.array().cast("array<double>")}), F.lit(1.0 / n)
        held, last, plain = hang / n, float("inf"), False
        for step in range(iterations):
            m = min(STEPS_BACK, step + 1)
            state = state.withColumn("x", start)
            sent = state.filter("out is not null").select(F.col("k").alias("a"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), (F.col("x") / F.col("out")).alias("share"))
            got = held_edges.join(sent.hint("merge"), ["a", "place"]).groupBy(F.col("b").alias("k")).agg(F.sum("share").alias("got"))
            new = F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + held / n)
            state = state.join(got, "k", "left").withColumn("new", new)
            back = lambda old, value: F.slice(F.concat(old, F.array(value)), -m, m)  # noqa: B023, E731
            state = cut(state.select("id", "k", "out", "places", back("g", F.col("new")).alias("g"), back("f", F.col("new") - F.col("x")).alias("f")), "ranks")
            g, f = ([F.col(c)[i] for i in range(m)] for c in "gf")
            loose = F.col("out").isNull().cast("double")
            sums = state.agg(F.sum(F.abs(f[-1])), F.min(g[-1]), *[F.sum(x * loose) for x in g], *[F.sum(f[i] * f[j]) for i in range(m) for j in range(m)]).first()
            moved, least, helds, dots = sums[0], sums[1], sums[2 : 2 + m], np.array(sums[2 + m :]).reshape(m, m)
            if moved < tolerance and least > 0:
                return state.select("id", g[-1].alias("rank"))
            plain = plain or moved > last
            last = moved
            weights = [0.0] * (m - 1) + [1.0] if plain else _weights(dots)
            start = sum((F.lit(w) * x for w, x in zip(weights[1:], g[1:], strict=True)), F.lit(weights[0]) * g[0])
            held = sum(w * h for w, h in zip(weights, helds, strict=True))
    finally:
        held_edges.unpersist()
    raise ValueError(f"the ranks still move by {moved} after {iterations} steps")
