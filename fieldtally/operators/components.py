"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(vertices: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest vertex of each component: `vertices(by…, v)` plus `label`.

    Every round lets each vertex follow its smallest neighbour (several steps at
    once), then replaces the edges by the distinct edges between the vertices reached.
    The edge table shrinks each round and the number of rounds grows with the
    logarithm of the size, also for long chains. Rounds are cut with checkpoints.
    """
    by = list(by)
    e = edges.select(*by, "a", "b").filter(F.col("a") != F.col("b"))
    e = cut_lineage(e.unionByName(e.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        hop = e.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, "a", F.least("a", "m").alias("to"))
        for _ in range(2):
            ahead = hop.select(*by, F.col("a").alias("to"), F.col("to").alias("then"))
            hop = hop.join(ahead, [*by, "to"], "left").select(*by, "a", F.coalesce("then", "to").alias("to"))
        hop = cut_lineage(hop)
        steps.append(hop)
        left = hop.select(*by, "a", F.col("to").alias("x"))
        right = hop.select(*by, F.col("a").alias("b"), F.col("to").alias("y"))
        moved = e.join(left, [*by, "a"]).join(right, [*by, "b"]).filter(F.col("x") != F.col("y"))
        e = cut_lineage(moved.select(*by, F.col("x").alias("a"), F.col("y").alias("b")).distinct())

    def follow(table: DataFrame, hop: DataFrame) -> DataFrame:
        step = hop.select(*by, F.col("a").alias("label"), "to")
        return table.join(step, [*by, "label"], "left").select(*by, "v", F.coalesce("to", "label").alias("label"))

    return reduce(follow, steps, vertices.select(*by, "v", F.col("v").alias("label")))
