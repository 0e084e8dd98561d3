"""Connected components of a table of links, by alternating large and small stars.

Every round moves links towards the smallest node of their component; links of a node are only ever counted and joined,
never gathered, so a node with very many links is no task of its own. Each round ends in a checkpoint, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest of its neighbourhood."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: a row for each node that has a link, but for the roots themselves; root is the smallest node of its component. ``links``: columns a, b."""
    links = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.toDF("node", "root")
        mark = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")
