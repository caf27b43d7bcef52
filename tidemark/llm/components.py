"""Connected components of an edge table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of ``edges``; root is some vertex of its component.

    In each round a vertex is merged into the one of least random rank among itself and its neighbours,
    so a constant share of the vertices goes whatever the graph's shape; rounds grow with the logarithm of
    the largest component. Groups are reduced by min only, never collected, and each round's tables are
    written to the shared folder. The driver sees no links.
    """
    rest = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    merged, turn = None, 0
    while merged is None or not rest.isEmpty():
        rank = lambda v: F.struct(F.xxhash64(v, F.lit(turn)).alias("rank"), v.alias("v"))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("of")).select(F.col("a").alias("v"), F.least(rank(F.col("a")), F.col("of"))["v"].alias("into"))
        least = written(least, "merge")
        left, right = least.toDF("a", "into_a"), least.toDF("b", "into_b")
        rest = written(
            rest.join(left, "a").join(right, "b").where("into_a <> into_b").select(F.least("into_a", "into_b").alias("a"), F.greatest("into_a", "into_b").alias("b")).distinct(), "edges"
        )
        step = least.toDF("root", "next")
        merged = least.toDF("vertex", "root") if merged is None else merged.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
        turn += 1
    return written(merged, "roots")
