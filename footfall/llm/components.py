"""Connected components by contraction: every round each vertex joins its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges`` (columns a, b); ``root`` is the same within a component.

    Each round at least halves the vertices that still have edges, so the rounds grow with the logarithm
    of their number. A hub's edges are combined before the shuffle; joins on a hub are split by
    adaptive execution. What a round leaves is written, so a lost executor repeats one round only.
    """
    left = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "cc-parents")
        # Two jumps shorten the chains of parents before edges are rewritten.
        for _ in range(2):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(above, "p").select("a", F.col("q").alias("p"))
        parent = stage(parent, "cc-jumped")
        steps.append(parent)
        at_a = parent.select("a", F.col("p").alias("pa"))
        at_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(at_a, "a").join(at_b, "b").filter("pa <> pb")
        left = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("a").alias("root"))
    found = steps[0].select(F.col("a").alias("v"), F.col("p").alias("root"))
    for step in steps[1:]:
        later = step.select(F.col("a").alias("root"), F.col("p").alias("next"))
        found = found.join(later, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return stage(found, "cc-roots")
