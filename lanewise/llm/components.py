"""Connected components of a table of links, as a chain of joins whose intermediate tables are cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component), component the smallest node that can be reached.

    Each round hooks every node's label onto the smallest label among its neighbours' and then follows the label's own
    label, so paths shrink by doubling.  Both steps aggregate partially before they shuffle; a node with very many links is
    therefore no hot task.  Only nodes with a link appear; no link goes to the driver.  Raises if ``rounds`` aren't enough.
    """
    both = settled(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(rounds):
        around = (
            both.join(label.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = label.join(around, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        # what a label learnt is handed to the label's own node, too
        told = hooked.groupBy(F.col("was").alias("node")).agg(F.min("component").alias("told"))
        hooked = hooked.join(told, "node", "left").select("node", F.least("component", "told").alias("component"), "was")
        hooked = settled(hooked)
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nxt = settled(hooked.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was"))
        changed = nxt.where("component <> was").limit(1).count()
        label = nxt.select("node", "component")
        if not changed:
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
