"""What can be reached in many small graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.store import written


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` written, and their number, which the writing tells."""
    told = Observation()
    kept = written(rows.observe(told, F.count("*").alias("n")), "reach")
    return kept, told.get["n"]


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(g, node, steps) of what the edges (g, a, b) lead to from the starts (g, node), with the fewest steps.

    Jumps of 1, 2, 4, ... steps are joined to what is reached so far, so that a path of n steps takes log n rounds;
    each round is written, as rounds build on one another. Cycles end, as nothing new is reached. A start has 0 steps.
    """
    jumps = edges.select("g", "a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    reached, known = _counted(starts.select("g", "node").distinct().withColumn("steps", F.lit(0).cast("long")))
    step = 1
    while True:
        more = reached.join(jumps.withColumnRenamed("a", "node"), ["g", "node"]).select("g", F.col("b").alias("node"), (F.col("steps") + step).alias("steps"))
        reached, now = _counted(reached.unionByName(more).groupBy("g", "node").agg(F.min("steps").alias("steps")))
        if now == known:
            return reached
        known, step = now, 2 * step
        onward = jumps.select("g", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = written(jumps.join(onward, ["g", "b"]).select("g", "a", F.col("c").alias("b")).distinct(), "jumps")
