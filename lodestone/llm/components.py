"""Connected components of an edge table, without gathering them anywhere.

Each round, every node takes its smallest neighbour (or itself) as parent, chains of parents
are shortened by pointer jumping, and edges are rewritten to the roots; edges within a root go.
A round at least halves the nodes that still have edges. The table is checkpointed each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import compacted


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents shortened until each node's parent is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = compacted(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")))
        if not parents.filter("moved").head(1):
            return parents.select("node", "parent")


def _lifted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends; a node without a root is its own. Those within a root go."""
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    both = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    return compacted(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    ``known`` holds the (node, root) of edges seen before; the result covers both, and only the
    edges that join two of its components take part.
    """
    if known is None:
        edges = compacted(edges.select("a", "b").filter("a <> b").distinct())
    else:
        edges = _lifted(edges.select("a", "b"), known)
        if not edges.head(1):
            return known
    roots = known
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        # A node below all its neighbours is a root of this round.
        parents = _jumped(compacted(near.select("node", F.least("node", "least").alias("parent"))))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), F.col("parent").alias("higher"))
            raised = roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            if roots is known:  # nodes that no edge held before
                raised = raised.unionByName(parents.join(known.select("node"), "node", "left_anti").select("node", F.col("parent").alias("root")))
            roots = compacted(raised)
        edges = _lifted(edges, parents.withColumnRenamed("parent", "root"))
        if not edges.head(1):
            return roots
