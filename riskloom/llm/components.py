"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); equal roots mean connected.

    Each round, every node picks the neighbour (or itself) with the least
    salted hash and is replaced by it.  Random picks shrink any graph, long
    chains included, by a constant share per round, so the number of rounds is
    logarithmic.  Aggregates combine on the map side, hot nodes meet only in
    joins that adaptive execution can split, and each round is cut by a written
    table.  An empty edge table gives an empty result; NULL ends are ignored.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    salt = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))
        pick = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", key("a"))["n"].alias("parent"))
        pick = materialise(pick, "pick")
        if labels is None:
            labels = pick.select("node", F.col("parent").alias("root"))
        else:
            moved = pick.select(F.col("node").alias("root"), "parent")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = materialise(labels, "labels")
        edges = (
            edges.join(pick.toDF("a", "pa"), "a").join(pick.toDF("b", "pb"), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        edges = materialise(edges, "edges")
        salt += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
