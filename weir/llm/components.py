"""Connected components of an undirected graph, without gathering any of it on the driver.

Every round, each node hooks to its smallest neighbour below itself, the hooks are followed to their ends by doubling,
and the edges are contracted to those ends; edges within a component vanish. A round at least halves the nodes that
still have edges, except for those below all their neighbours. Tables are written to the shared folder between rounds.

Defined results: self-loops, repeated edges and either direction are the same as one edge; without edges the result is
empty; nulls make no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _flattened(parents: DataFrame) -> DataFrame:
    """parents (node, parent < node): every node's root."""
    while True:
        up = parents.select(F.col("node").alias("mid"), F.col("parent").alias("above"))
        step = common.written(
            parents.join(up, F.col("parent") == F.col("mid"), "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")),
            "component-hooks",
        )
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs; returns node, component (its smallest node) for nodes that are not their own smallest."""
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = common.written(live.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    roots = None
    while not live.isEmpty():
        flat = _flattened(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if roots is None:
            roots = flat
        else:
            up = flat.select(F.col("node").alias("mid"), F.col("parent").alias("above"))
            moved = roots.join(up, F.col("parent") == F.col("mid"), "left").select("node", F.coalesce("above", "parent").alias("parent"))
            roots = common.written(moved.unionByName(flat), "component-roots")
        x = flat.select(F.col("node").alias("xa"), F.col("parent").alias("ra"))
        y = flat.select(F.col("node").alias("xb"), F.col("parent").alias("rb"))
        both = live.join(x, F.col("a") == F.col("xa"), "left").join(y, F.col("b") == F.col("xb"), "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        live = common.written(both.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return roots.select("node", F.col("parent").alias("component"))
