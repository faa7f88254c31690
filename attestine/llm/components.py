"""Connected components of a link table by alternating large-star and small-star steps.

Each step only shuffles links, so neither links nor components ever reach the driver; lineage is cut after every
round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestine.llm import storage


def _star(links: DataFrame, *, large: bool) -> DataFrame:
    """Large: each node's larger neighbours meet its least neighbour. Small: its smaller neighbours and itself do."""
    ways = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else ways.groupBy("a").agg(F.min("b").alias("m"))
    near = ways.join(least, "a")
    if large:
        return near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least member) for every node in links (a, b); nodes without links don't appear."""
    links = links.select("a", "b").filter("a <> b")
    before = None
    for _ in range(max_rounds):
        table = storage.materialize(_star(_star(links, large=True), large=False).filter("a <> b").distinct(), "links")
        state = tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        links = table
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    low = F.least("a", "b")
    edges = links.select(F.greatest("a", "b").alias("node"), low.alias("component"))
    return edges.union(links.select(low.alias("node"), low.alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
