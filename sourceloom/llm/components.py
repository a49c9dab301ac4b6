"""Connected components of an edge table by hooking and contraction, with every round's state in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import keep, remove


def connected_components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """edges (a, b) of longs -> (node, root), one row per node that has an edge; root is the component's smallest node.

    A round hooks each node to its smallest neighbour if that is smaller, follows the pointers to their ends by doubling,
    and replaces the edges' ends by those roots; edges inside a root go.  A root has no smaller neighbour, so pointers
    never form a ring, and the rounds end when no edge is left.  Neighbours are never gathered: only minima are taken, with
    partial sums on the map side, and joins on a hub's key are split by adaptive execution.
    """
    live, live_path = keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []
    paths: list[str] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        ptr, ptr_path = keep(hooks.select("node", F.least("node", "low").alias("root")), "hooks")
        while True:
            up = ptr.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer, longer_path = keep(ptr.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") < F.col("root")).alias("moved")), "jump")
            moved = not longer.where("moved").isEmpty()
            remove(edges.sparkSession, ptr_path)
            ptr, ptr_path = longer.select("node", "root"), longer_path
            if not moved:
                break
        levels.append(ptr)
        paths.append(ptr_path)
        ra, rb = ptr.toDF("a", "ra"), ptr.toDF("b", "rb")
        then = live.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        nxt, nxt_path = keep(then, "edges")
        remove(edges.sparkSession, live_path)
        live, live_path = nxt, nxt_path
    remove(edges.sparkSession, live_path)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false"), paths
    out = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("node").alias("root"), F.col("root").alias("above"))
        out = out.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return out, paths
