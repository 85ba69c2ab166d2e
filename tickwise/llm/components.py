"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import checked_broadcast, cut


def _with_least(edges: DataFrame, least: DataFrame, parts: int, hub: int | None) -> DataFrame:
    """edges(u, v) with the m of their u; nodes of more than `hub` links, few by their number, meet them by broadcast."""
    if hub is None:
        return edges.join(least.select("u", "m"), "u").coalesce(parts)
    least = cut(least)
    hubs = checked_broadcast(least.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u").coalesce(parts)
    return edges.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, parts: int, hub: int | None) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(parts)
    return _with_least(both.where("v > u"), least, parts, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, parts: int, hub: int | None) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(parts)
    moved = _with_least(down, least, parts, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(parts)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, hub: int = 20_000) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Alternates large-star and small-star steps until every link points at a root: a number of
    rounds that grows with the logarithm of the longest path, each a few shuffles of the links.
    A node of more than `hub` links (and more than a thousandth of all of them, so that such nodes stay
    few) does not meet its neighbours in one task. Self links and nulls are ignored; nodes without links are absent.
    """
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    # Links never grow in number: a partition for each 200,000 of them is enough.
    n = edges.count()
    parts = max(1, -(-n // 200_000))
    most = max(hub, n // 1000)
    edges = edges.coalesce(parts)
    while True:
        # Done when no node that hangs below another also has one hanging below it, and each hangs below one only.
        per_node = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        state = per_node.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)")).alias("open"), F.max(F.col("up") + F.col("down")).alias("links")).first()
        if not state.open:
            break
        split = most if state.links > most else None
        edges = cut(_small_star(_large_star(edges, parts, split), parts, split))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
