"""Connected components as joins: labels stay in tables, none comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a long, b long): component is the smallest id reachable.

    Each round takes the least label among neighbours, then that label's own label; the rounds grow with
    the logarithm of a component's width. A hub's many links are reduced before they are shuffled.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        fresh = scratch.keep(least.join(up, "c", "left").select("id", "old", F.coalesce(F.least("c", "up"), "c").alias("component")), "labels")
        done = fresh.filter("component < old").isEmpty()
        scratch.drop(labels)
        labels = fresh.select("id", "component")
        if done:
            scratch.drop(both)
            return labels
