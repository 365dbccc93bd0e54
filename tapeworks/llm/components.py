"""Connected components of a graph of links, as joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import packed


MAX_BROADCAST = 200_000  # labels that are sent to every task at once


def components(links: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); ``component`` is the smallest node that can be reached.

    Every node takes the smallest label among itself and its neighbours, then the label
    of that label, until nothing changes. Each round is settled. Minima are aggregated
    before the shuffle, so a node with very many links is no heavy group. Labels are
    broadcast up to ``max_broadcast`` nodes, so a round has one shuffle; beyond that they
    are merged, whatever their rows seem to weigh (a hash table of them weighs three times
    that), where a label that many nodes share has one row on the other side, and adaptive
    execution splits the shared side.
    """
    both, _ = packed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels, seen = packed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    sent = F.broadcast if seen["rows"] <= max_broadcast else lambda df: df.hint("merge")
    while True:
        near = both.join(sent(labels.select(F.col("node").alias("b"), "c")), "b").select(F.col("a").alias("node"), "c", F.lit(None).cast("long").alias("was"))
        low = near.unionByName(labels.select("node", "c", F.col("c").alias("was"))).groupBy("node").agg(F.min("c").alias("c"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("c"), F.col("c").alias("further"))
        new = low.join(sent(jump), "c", "left").select("node", "was", F.least("c", "further").alias("c"))
        labels, seen = packed(new, changed=F.count_if(F.expr("c <> was")))
        labels = labels.select("node", "c")
        if not seen["changed"]:
            return labels.withColumnRenamed("c", "component")
