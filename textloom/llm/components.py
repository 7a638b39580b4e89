"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import staged


def _roots(parent: DataFrame) -> DataFrame:
    """parent (node, parent) with each node's parent replaced by the root above it, by doubling steps."""
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = parent.join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved"))
        jumped = staged(jumped, "roots")
        parent = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge in edges (a, b: long); component is the smallest node reachable.

    A round puts all live nodes in an order, hangs each node below its least neighbour, or leaves it a root where it
    comes before all of them, follows these links to the roots by doubling, and contracts each tree to its root. The
    order is that of the ids, under which stars and chains vanish at once; in each third round it is pseudo-random,
    so that on average at most half of the nodes with a neighbour are roots, whatever the graph's shape. Rounds thus
    grow with the logarithm of the graph. Their maps are put together from the last to the first. All steps are written before the next; nothing is collected. Edges may repeat, and self-loops make their
    node known; an empty table gives an empty result.
    """
    loose = staged(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"), "edges")
    live, maps = loose.filter("a <> b").distinct(), []
    while not live.isEmpty():
        rank = (lambda c, k=len(maps): F.xxhash64(F.col(c), F.lit(k))) if len(maps) % 3 == 2 else F.col
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank("b")).alias("to"))
        # ranks tie only where two nodes share a 64-bit hash
        below = (rank("to") < rank("node")) | ((rank("to") == rank("node")) & (F.col("to") < F.col("node")))
        up = _roots(staged(least.select("node", F.when(below, F.col("to")).otherwise(F.col("node")).alias("parent")), "parents"))
        maps.append(up)
        moved = live.join(up.toDF("a", "pa"), "a").join(up.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        live = staged(moved.filter("a <> b").distinct(), "edges")
    alone = loose.filter("a = b").select(F.col("a").alias("node")).distinct()
    if not maps:
        return alone.withColumn("component", F.col("node"))
    found = maps.pop()
    while maps:
        found = staged(maps.pop().join(found.toDF("parent", "top"), "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")), "components")
    first = found.groupBy("parent").agg(F.min("node").alias("component"))
    out = found.join(first, "parent").select("node", "component")
    return out.unionByName(alone.join(out, "node", "left_anti").withColumn("component", F.col("node")))
