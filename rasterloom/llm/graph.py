"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).

    Each round hashes the nodes anew, points every node to the neighbour with the smallest hash (or to
    itself), follows pointers twice, and contracts. Hashing keeps long chains from shrinking by a step
    a round: whatever the graph, a fixed share of its nodes goes each time. Rounds are written to the
    shared folder."""
    live = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(steps) + 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        # The pointers' shuffle is shared by the joins that follow them.
        up = hop.select("node", F.least(order("node"), "m")["n"].alias("up"))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            up = up.join(above, "up").select("node", F.col("upper").alias("up"))
        up = materialise(up)
        side = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        live = live.join(side("a"), "a").join(side("b"), "b")
        live = live.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        live = materialise(live.where("a <> b").distinct())
        steps.append(up)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    # A node's root: what the rounds made of it, one after the other.
    labels = steps[0].select("node", F.col("up").alias("root"))
    for up in steps[1:]:
        step = up.select(F.col("node").alias("root"), "up")
        labels = labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    labels = materialise(labels)
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
