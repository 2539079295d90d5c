"""Vector search, centroids, cohesion, agreement of clusterings, bands by random hyperplanes, and exact similar pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import cosine, dot, normalised


def nearest(df: DataFrame, probe: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """The k rows most similar to a one-row probe (column `vector`), ties by id; the probe is broadcast."""
    near = df.crossJoin(F.broadcast(probe.select(F.col(vector).alias("probe")).limit(1)))
    return near.select(id_, F.round(cosine(F.col(vector), F.col("probe")), 5).alias("similarity")).orderBy(F.col("similarity").desc(), id_).limit(k)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, size, centroid): sums by dimension, combined before the shuffle."""
    parts = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    rows = parts.groupBy(label).agg(F.max("n").alias("size"), F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("_parts"))  # a row a dimension
    return rows.select(label, "size", F.col("_parts.x").alias("centroid"))


def cohesion(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean similarity of members to their centroid."""
    both = df.join(centroids(df, label, vector), label)
    return both.groupBy(label).agg(F.count("*").alias("size"), F.round(F.avg(cosine(F.col(vector), F.col("centroid"))), 5).alias("cohesion"))


#: Centres are broadcast only if so many bytes hold them.
CENTRE_BYTES = 48 << 20


def assign(df: DataFrame, centres: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """(id, near): the most similar centroid of each row; ties by label. centres: (label, centroid), broadcast if they are small,
    else compared block by block, which needs integer identifiers and labels."""
    n, dims = centres.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (dims or 0) * 8 > CENTRE_BYTES:
        probes = df.select((F.col(id_) * 2).alias("id"), F.col(vector).alias("v"))  # even ones; centres are odd, so no two are equal
        among = centres.select((F.col(label) * 2 + 1).cast("long").alias("id"), F.col("centroid").cast(dict(df.dtypes)[vector]).alias("v"))
        best = nearest_of_all(probes, "id", "v", dims, 1, among)
        return best.select((F.col("id") / 2).cast("long").alias(id_), ((F.col("other") - 1) / 2).cast("long").alias("near"))
    pairs = df.select(id_, vector).crossJoin(F.broadcast(centres.select(F.col(label).alias("near"), "centroid")))
    return pairs.groupBy(id_).agg(F.max_by(F.col("near"), F.struct(F.round(cosine(F.col(vector), F.col("centroid")), 5), -F.col("near"))).alias("near"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings from their contingency counts."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("cells"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("rows"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("columns"))
    one = both.crossJoin(rows).crossJoin(columns)  # a row each
    expected = F.col("rows") * F.col("columns") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("rows") + F.col("columns")) / 2
    return one.select(F.round(F.when(most == expected, F.lit(1.0)).otherwise((F.col("cells") - expected) / (most - expected)), 6).alias("ari"))


def hyperplane_bands(df: DataFrame, id_: str, vector: str, dims: int, bits: int = 128, bands: int = 8, seed: int = 20260101) -> DataFrame:
    """(id, band, bucket): signs of seeded Gaussian projections, in bands."""
    planes = np.random.default_rng(seed).normal(size=(bits, dims)).round(6)
    width = bits // bands
    keys = []
    for band in range(bands):
        key = F.lit(0).cast("long")
        for bit in range(width):
            plane = F.array(*[F.lit(float(x)) for x in planes[band * width + bit]])
            side = F.aggregate(F.zip_with(F.col(vector), plane, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0
            key = key * 2 + side.cast("long")
        keys.append(key)
    return df.select(id_, F.posexplode(F.array(*keys)).alias("band", "bucket"))


#: Vectors of one block, on average at most; rows of a block that are compared at once.
BLOCK, ROWS = 4096, 512


def _block_pairs(dims: int, threshold: float):
    """Rows come sorted by pair of blocks. Pairs whose cosine may reach the threshold when rounded, in pieces."""

    def of(key: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, block = rows.column(2).combine_chunks(), rows.column(3).to_numpy()
        v = rows.column(4).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        norms = np.sqrt((v * v).sum(1))
        left, right = np.flatnonzero(block == key[0]), np.flatnonzero(block == key[1])
        for low in range(0, len(left), ROWS):
            i = left[low : low + ROWS]
            lengths = norms[i][:, None] * norms[right][None, :]
            near = np.divide(v[i] @ v[right].T, lengths, out=np.zeros(lengths.shape), where=lengths != 0)
            ok = near >= threshold - 1e-5
            if key[0] == key[1]:
                ok &= i[:, None] < right[None, :]
            a, b = np.nonzero(ok)
            if len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[a])), ids.take(pa.array(right[b])), pa.array(near[a, b])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(x)], strict=True):
                if low == high:
                    continue
                if held and key != (x[low], y[low]):
                    yield from of(key, held)
                    held = []
                key = (x[low], y[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from of(key, held)

    return run


def similar_pairs(df: DataFrame, id_: str, vector: str, dims: int, threshold: float) -> DataFrame:
    """Every pair whose cosine, rounded to five places, reaches the threshold. Blocks of vectors are dealt by hash and each
    two blocks meet in one task, so all pairs are compared: the work grows with the square of the rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dims)
    blocks = max(math.ceil(rows.count() / BLOCK), math.ceil(math.sqrt(4 * parts)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "v")
    kind = dict(rows.dtypes)["id"]
    pairs = rows.repartition(parts, "x", "y").sortWithinPartitions("x", "y").mapInArrow(_block_pairs(dims, threshold), f"a {kind}, b {kind}, similarity double")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 5).alias("similarity"))
    return pairs.filter((F.col("a") < F.col("b")) & (F.col("similarity") >= threshold))


def _block_nearest(dims: int, k: int):
    """Rows come sorted by pair of blocks: the k most similar rows of the second block for each row of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = np.asarray(rows.column(2).to_pylist(), np.int64)
            probe = rows.column(3).to_numpy().astype(bool)
            v = rows.column(4).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
            others = np.flatnonzero(~probe)
            for low in range(0, int(probe.sum()), ROWS):
                i = np.flatnonzero(probe)[low : low + ROWS]
                near = np.round(unit[i] @ unit[others].T, 5)
                near[ids[i][:, None] == ids[others][None, :]] = -9
                best = np.lexsort((np.broadcast_to(ids[others], near.shape), -near))[:, :k]
                a = np.repeat(i, best.shape[1])
                b = others[best.ravel()]
                s = np.take_along_axis(near, best, 1).ravel()
                ok = s > -9
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.array(s[ok])], names=["id", "other", "similarity"])

        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(x)], strict=True):
                if low == high:
                    continue
                if held and key != (x[low], y[low]):
                    yield from of(pa.Table.from_batches(held))
                    held = []
                key = (x[low], y[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def nearest_of_all(df: DataFrame, id_: str, vector: str, dims: int, k: int, among: DataFrame | None = None) -> DataFrame:
    """(id, other, similarity, place): the k most similar others of every row, or of `among` (same columns), ties by
    identifier. Every two blocks meet in one task, which leaves k rows a probe; the k best of those stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = df.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dims)
    others = probes if among is None else among.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dims)
    blocks = max(math.ceil(probes.count() / BLOCK), math.ceil(math.sqrt(2 * parts)))

    def dealt(rows: DataFrame, side: str, probe: int) -> DataFrame:
        far = "y" if side == "x" else "x"
        rows = rows.withColumn(side, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return rows.select("x", "y", "id", F.lit(probe).alias("probe"), "v")

    both = dealt(probes, "x", 1).unionByName(dealt(others, "y", 0)).repartition(parts, "x", "y").sortWithinPartitions("x", "y")
    found = both.mapInArrow(_block_nearest(dims, k), "id long, other long, similarity double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def silhouette(df: DataFrame, id_: str, label: str, vector: str) -> DataFrame:
    """(id, score): cosine silhouette of every row, exactly and without pairs: the mean distance to a cluster is one less the
    product with the mean of its unit vectors. Clusters are a bounded number of rows; a lone row has no score."""
    unit = df.select(id_, label, normalised(F.col(vector)).alias("u"))
    sums = unit.select(label, F.posexplode("u").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy(label).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select(F.col(label).alias("_c"), "n", F.col("s.x").alias("s"))
    pairs = unit.crossJoin(F.broadcast(sums)).withColumn("p", dot(F.col("u"), F.col("s")))
    own = F.col(label) == F.col("_c")
    a = F.max(F.when(own & (F.col("n") > 1), (F.col("n") - F.col("p")) / (F.col("n") - 1)))
    b = F.min(F.when(~own, 1 - F.col("p") / F.col("n")))
    rows = pairs.groupBy(id_).agg(a.alias("a"), b.alias("b")).filter("a is not null and b is not null and greatest(a, b) > 0")
    return rows.select(id_, ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("score"))


def principal(df: DataFrame, id_: str, vector: str, dims: int, k: int = 2, centred: bool = True) -> DataFrame:
    """(id, coordinates): rows on the k directions of most variance. The dims x dims products are summed by the tasks, whatever
    the number of rows; signs are set so that each direction's largest part is positive."""
    rows = df.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            w = np.hstack([v, np.ones((len(v), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    total = sum((np.frombuffer(bytes(r.data)).reshape(dims + 1, dims + 1) for r in rows.mapInArrow(sums, "data binary").collect()), np.zeros((dims + 1, dims + 1)))  # a matrix a task
    n = max(total[dims, dims], 1.0)
    mean = total[dims, :dims] / n if centred else np.zeros(dims)
    values, directions = np.linalg.eigh(total[:dims, :dims] - n * np.outer(mean, mean))
    top = directions[:, np.argsort(-values)[:k]]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    coordinates = []
    for j in range(top.shape[1]):
        direction = F.array(*[F.lit(float(x)) for x in top[:, j]])
        coordinates.append(dot(F.col("v"), direction) - float(mean @ top[:, j]))
    return rows.select("id", F.array(*coordinates).alias("coordinates"))


def inertia(df: DataFrame, vector: str, centre: str) -> DataFrame:
    """Sum of squared distances of rows to the centre in the same row."""
    return df.agg(F.sum(F.aggregate(F.zip_with(F.col(vector), F.col(centre), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)).alias("inertia"))


def chosen_k(df: DataFrame, id_: str, vector: str, candidates, seed: int = 0, metric: str = "silhouette") -> list[tuple[int, float | None, float]]:
    """(k, silhouette, inertia) of each candidate, the chosen one first: the best silhouette, ties by fewer clusters; or the
    largest second difference of inertia."""
    from foliant.operators import families

    out = []
    for k in candidates:
        labels = families.kmeans(df, id_, vector, k, seed)
        rows = df.join(labels, id_)
        score = silhouette(rows, id_, "cluster", vector).agg(F.avg("score")).first()[0]
        centres = centroids(rows, "cluster", vector).select("cluster", "centroid")
        out.append((k, score, inertia(rows.join(centres, "cluster"), vector, "centroid").first()[0]))
    if metric == "silhouette":
        best = max(out, key=lambda r: (r[1] if r[1] is not None else -2, -r[0]))
    else:
        drops = [a[2] - b[2] for a, b in zip(out[:-1], out[1:], strict=True)]
        best = out[max(range(len(drops) - 1), key=lambda i: drops[i] - drops[i + 1])] if len(drops) > 1 else out[0]
    return [best, *[r for r in out if r is not best]]


def dbscan(df: DataFrame, id_: str, vector: str, dims: int, eps: float, least: int) -> DataFrame:
    """(id, cluster): rows with `least` neighbours (itself included) at a cosine distance of at most eps are cores; linked
    cores are a cluster, named by its smallest core; others join their smallest core's cluster, or are noise (null)."""
    from foliant.operators import graph
    from foliant.operators.scratch import cut

    pairs = cut(similar_pairs(df, id_, vector, dims, 1 - eps).select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cores = cut(both.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("n")).filter(F.col("n") >= least).select("id"))
    a, b = cores.withColumnRenamed("id", "a"), cores.withColumnRenamed("id", "b")
    linked = graph.components(pairs.join(a, "a", "left_semi").join(b, "b", "left_semi"))
    lone = cores.join(linked, "id", "left_anti").select("id", F.col("id").alias("component"))
    core = linked.unionByName(lone)
    border = both.join(a, "a", "left_anti").join(core.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
    return df.select(F.col(id_).alias("id")).join(core.unionByName(border), "id", "left").select("id", F.col("component").alias("cluster"))
