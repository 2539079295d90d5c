"""The document store's writes as set operations: merges that clear what changed, filters, prunes, memberships."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import names


def every(*conditions: Column) -> Column:
    """All conditions; true when there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def active(state: str = "state") -> Column:
    return F.coalesce(state, F.lit("ACTIVE")) == "ACTIVE"


def outside(path: str, scopes: Sequence[str]) -> Column:
    """Neither a scope itself nor below it."""
    return ~reduce(lambda a, s: a | names.in_subtree(F.col(path), s), scopes, F.lit(False))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last one in the given order."""
    packed = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return packed.select("_row.*")


def merged(target: DataFrame, updates: DataFrame, key: str, watch: Sequence[str], clear: str) -> DataFrame:
    """target after updates by key: columns of the updates replace; if a watched column changed, `clear` becomes null, else
    it stays; new keys come with it null. One shuffle of both sides on the key, whatever the number of updates."""
    t, u = target.alias("t"), updates.withColumn("_new", F.lit(True)).alias("u")
    changed = reduce(lambda a, c: a | ~F.col(f"t.{c}").eqNullSafe(F.col(f"u.{c}")), watch, F.lit(False))
    isnew = F.col("u._new").isNotNull()
    out = [F.coalesce(f"t.{key}", f"u.{key}").alias(key)]
    for c in target.columns:
        if c == clear:
            out.append(F.when(isnew & changed, None).otherwise(F.col(f"t.{c}")).alias(c))
        elif c != key:
            out.append((F.when(isnew, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")) if c in updates.columns else F.col(f"t.{c}")).alias(c))
    return t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer").select(out)


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with the smaller end first, each once, none from a node to itself."""
    return edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).filter("src < dst").distinct()


def only_pairs(df: DataFrame, key: Sequence[str], id_: str, old: Column, new: Column) -> DataFrame:
    """(old_id, new_id) of keys with exactly one old and one new row."""
    groups = df.groupBy(*key).agg(F.count_if(old).alias("_a"), F.count_if(new).alias("_b"), F.max(F.when(old, F.col(id_))).alias("old_id"), F.max(F.when(new, F.col(id_))).alias("new_id"))
    return groups.filter("_a = 1 and _b = 1").select("old_id", "new_id")


def capped_degree(edges: DataFrame, a: str, b: str, order: Sequence[Column], most: int) -> DataFrame:
    """The greedy degree cap, exactly: edges are taken in the given order (which has no ties) while both ends have room.

    Rounds decide many edges at once. An undecided edge is taken if at each end the edges before it, taken or undecided, are
    fewer than `most`: whatever becomes of them, there is room. It is dropped if at one end `most` are taken already. The
    first undecided edge of all is always decided, so rounds end; state is written down between them."""
    from foliant.operators.scratch import cut

    names_ = edges.columns
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    state = cut(edges.withColumns({"_key": key, "_taken": F.lit(False)}))
    done = None
    while True:
        ends = state.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("end")), F.struct(F.lit(1).alias("side"), F.col(b).alias("end")))).alias("_e"))
        before = F.row_number().over(Window.partitionBy("_e.end").orderBy("_key")) - 1
        taken = F.count_if(F.col("_taken")).over(Window.partitionBy("_e.end"))
        seen = ends.withColumns({"_before": before, "_full": (taken >= most) & ~F.col("_taken")})
        each = seen.groupBy(a, b).agg(F.max("_before").alias("_worst"), F.max("_full").alias("_drop"))
        state = cut(state.join(each, [a, b]).filter(~F.col("_drop")).withColumn("_taken", F.col("_taken") | (F.col("_worst") < most)).drop("_worst", "_drop"))
        counts = tuple(state.agg(F.count("*"), F.count_if("_taken")).first())
        if counts == done or counts[0] == counts[1]:
            return state.filter("_taken").select(names_)
        done = counts


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def labelled(df: DataFrame, column: str, labels: Mapping[str, Column]) -> DataFrame:
    """Counts of rows by each label's condition: one pass, one row a label."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in labels.items()])
    return counts.select(F.explode(F.create_map(*[x for n in labels for x in (F.lit(n), F.col(n))])).alias(column, "n"))
