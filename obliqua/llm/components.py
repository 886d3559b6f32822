"""Connected components by alternating large-star and small-star steps.

Every step is a distributed join or aggregate over edges; the number of steps
grows with the logarithm of the longest path.  Nothing of the graph reaches the driver but
one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", "m")).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (its least reachable node) for the nodes of ``edges`` (u, v), which need not be distinct.

    Self-edges and null ends count for nothing; no edges give no rows.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = print_of(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        before, mark = mark, print_of(now)
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
    if mark[0]:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
