"""Connected components of a graph of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import few, saved


def components(links: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) for every id in ``links`` (a, b).

    Each round every id tells its neighbours the smallest label it knows, and
    labels are then followed to their own label; rounds needed grow with the
    logarithm of the longest path.  All rows stay in Spark; a hot id's messages
    are combined (min) before the shuffle.  Links of few documents go in few tasks,
    so a round costs a cluster's disks no more files than it has rows for.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    rows = both.count()
    both = few(both, rows)
    labels = saved(few(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), rows))
    while True:
        seen = few(both.join(labels.withColumnsRenamed({"id": "b"}), "b").select("a", "component"), rows).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = few(labels.join(seen, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was")), rows)
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = saved(few(lower.join(jump, "component").select("id", F.col("next").alias("component"), "was"), rows))
        labels = after.select("id", "component")
        if after.filter("component <> was").isEmpty():
            return labels
