"""Connected components by contraction, as joins and groupings over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import staged


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and root (the smallest node it is connected with) of every node that has an edge.

    edges: columns `a` and `b`, long. In each round a node takes its smallest
    neighbour as parent if that is smaller; parents are followed to the roots,
    and edges between roots are what is left. Rounds grow with the logarithm
    of the size of a component, whatever its shape, and a node with any number
    of edges is summed before it is shuffled.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    roots = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        parents = _followed(staged(parents, label), label)
        if roots is None:
            roots = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = staged(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), label)
        of_a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        edges = staged(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), label)
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _followed(parents: DataFrame, label: str) -> DataFrame:
    """Each node with the root of its tree: paths halve until none is left."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = staged(parents.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("root").alias("was")), label)
        parents = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return parents
