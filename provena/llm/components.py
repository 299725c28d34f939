"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provena.session import stored

#: Hops grow exponentially through the pointer jumps, so this many rounds cover any path.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of `edges` (a, b); label is the least node of the component.

    Each round takes the least label among the neighbours, then follows that label once (a
    pointer jump), so star-like groups settle in two or three rounds.  Hot nodes are harmless:
    minima are combined before the shuffle and skewed joins are split.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(MAX_ROUNDS):
        seen = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = state.join(seen, "node").select("node", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        jump = step.join(state.select(F.col("node").alias("hop"), F.col("label").alias("far")), "hop", "left")
        nxt = stored(jump.select("node", F.least("hop", "far").alias("label"), "old"))
        if nxt.where(F.col("label") != F.col("old")).isEmpty():
            return nxt.select("node", "label")
        state = nxt.select("node", "label")
    raise RuntimeError("components did not settle")
