"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.runtime import materialize, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node with an edge.

    Large-star and small-star rounds until the edges are stars. Minima are
    partial aggregates and the joins may be split, so a hub of many edges is no
    task of its own.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct(), "cc")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "cc-large")  # every a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
        roots = after.select("b").distinct()
        inner = after.join(roots.select(F.col("b").alias("r")), F.col("a") == F.col("r"), "left_semi")
        done = inner.isEmpty() and after.count() == after.select("a").distinct().count()
        release(edges, large)
        edges = after
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
