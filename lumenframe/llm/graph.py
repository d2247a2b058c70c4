"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import cut, drop

#: Rounds and joins of the last call, for tests.
last_rounds = [0, 0]


def roots(step: DataFrame) -> DataFrame:
    """(node, root) for pointers (node, root) to smaller nodes: followed to their ends by doubling."""
    while True:
        last_rounds[1] += 1
        after = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(step.select("node", "root").join(after, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), step)
        if step.filter("moved").isEmpty():
            return step


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it is linked with.

    Each round points every node to the smallest of itself and its neighbours, follows the pointers to
    their ends, and contracts the edges.  A node that nothing points to and that points to nothing is
    the smallest of its neighbours; in the next round it has a smaller one, so of n nodes at most n / 2
    are left two rounds later.  The pointers double their reach with every join.  Nulls take no part.
    """
    last_rounds[:] = [0, 0]
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while known is None or not edges.isEmpty():
        last_rounds[0] += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = roots(cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))))
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))  # noqa: E731, B023
        fewer = edges.join(to("a"), "a").join(to("b"), "b").filter("a_to != b_to").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b"))
        edges = cut(fewer.distinct(), edges)
        if known is None:
            known = step.select("node", "root")
            known._cut_path = step.__dict__.pop("_cut_path")
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = cut(known.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), known, step)
    drop(edges)
    return known
