"""Connected components by large and small stars, entirely in DataFrames.

Both star steps keep components and hang nodes ever closer to the smallest one;
after O(log n) rounds every node hangs directly on the smallest of its component.
Every round is written to the shared folder, so no lineage grows and nothing but
two sums goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import release, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b. Large: neighbours above a node hang on its least neighbour;
    small: the node and its neighbours below hang on the least of them."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(low, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b)."""
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        after = written(_star(_star(edges, True), False), "edges")
        new = _mark(after)
        release(edges)
        edges = after
        if new == mark:
            break
        mark = new
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())
