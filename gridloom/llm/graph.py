"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of every node of edges (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, then
    that label's own label (pointer jumping); rounds are written to the shared folder.
    Edges are read in each round: they should be a table, not a long plan.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    label, written = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), None
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stash(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        changed = not new.where("old <> label").isEmpty()
        if written is not None:
            drop_stash(written)
        label, written = new.select("node", "label"), new
        if not changed:
            return label
