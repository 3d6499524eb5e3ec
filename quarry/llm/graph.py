"""Connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def hooked(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` with the smallest of itself and its neighbours."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("near")).select("node", F.least("node", "near").alias("root"))


def flattened(labels: DataFrame, name: str) -> DataFrame:
    """Labels followed to their ends: every round a node takes its label's label."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = cut(labels.join(up, "root").select("node", F.col("next").alias("root"),
                                                    (F.col("next") != F.col("root")).alias("changed")), f"{name}-labels")
        if labels.filter("changed").isEmpty():
            return labels.select("node", "root")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Every phase hooks each node to its smallest neighbour, follows the labels to
    their ends and contracts the edges to those between different labels, so few
    edges are left after the first one; it ends when none is.  Labels and edges
    are written to the shared folder.  A node with very many edges is combined
    before the shuffle where it is grouped and split by AQE where it is joined.
    """
    rest = cut(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
               f"{name}-edges")
    labels = flattened(hooked(rest), name)
    steps = labels
    while True:
        left = steps.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = steps.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = cut(rest.join(left, "a").join(right, "b").filter("ra != rb")
                   .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
        if rest.isEmpty():
            return labels
        steps = flattened(hooked(rest), name)
        up = steps.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = cut(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-labels")
