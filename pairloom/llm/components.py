"""Connected components of a stored edge table, by hooking to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the least node reachable.

    Each round every node takes its least neighbour as parent, parents are followed to the top
    by doubling, and the edges are drawn anew between the tops. Rounds grow with the logarithm
    of the longest chain. Only sums per node and joins on one column are used, and each round is
    written to the shared folder, so lineage stays short and nothing comes to the driver.
    """
    edges = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parents = materialize(
            both.groupBy("node").agg(F.min("other").alias("other"))
            .select("node", F.least("node", "other").alias("parent")),
            "parents",
        )
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = materialize(
                parents.join(above, "parent").select(
                    "node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")
                ),
                "parents",
            )
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        top_a = parents.toDF("a", "top_a")
        top_b = parents.toDF("b", "top_b")
        edges = materialize(
            edges.join(top_a, "a").join(top_b, "b").where("top_a <> top_b")
            .select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b"))
            .distinct(),
            "edges",
        )
        if names is None:
            names = parents.toDF("node", "root")
        else:
            newer = parents.toDF("root", "top")
            names = materialize(
                names.join(newer, "root", "left").select("node", F.coalesce("top", "root").alias("root")),
                "roots",
            )
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
