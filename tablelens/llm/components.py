"""Connected components by alternating large-star and small-star steps; only edge tables move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours; combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("u > v")
    least = _least(down)
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (node, component): the smallest node reachable from each linked node.

    Links may repeat or point either way; links with a null end and links of a node to itself give
    nothing. Each round writes its edges, which never outnumber the links, to the shared folder; the
    driver sees two numbers a round. Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.select("u", "v").filter("u != v")
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            break
        before = tuple(sign)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """What `components` gives for the links behind parts and further links (u, v), by the components that the latter join.

    parts: (node, component) as `components` gave them. The links behind them are not walked again.
    """
    links = links.select("u", "v").filter("u != v")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    fresh = nodes.join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    named = cut_lineage(parts.select("node", "component").union(fresh))
    for end in "uv":
        links = links.join(named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
    over = components(links.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return named.join(over, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
