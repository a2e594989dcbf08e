"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut, forget, join_counted


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """Edges (a, b) of longs to one row a vertex: v, component (its smallest vertex).

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
    Every round ends in a written table, and the one before is removed.
    Neither edges nor vertices are gathered in one place: the smallest
    neighbour comes from an aggregation that combines before it shuffles, and
    it goes back to the many edges of a star's centre by broadcast.  Loops and
    repeated edges do no harm.  ``rows`` bounds the number of edges, where it
    is known.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, rows)
    while True:
        # done when every vertex points to one other, which points to none
        n, tails = now.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == tails and now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, name, 2 * n)
        # every vertex points to smaller ones now; they are all tied to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, down, ["u"], "n", 2 * n).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = (now, large), cut(small.where("u <> v").distinct(), name, 2 * n)
        for done in before:
            forget(done.inputFiles()[0].rpartition("/")[0] if done.inputFiles() else "")
    tied = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return tied.unionByName(tied.select(F.col("component").alias("v"), "component").distinct())
