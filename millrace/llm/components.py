"""Connected components of links that stay distributed: alternating large and small stars, one table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    least = cut_lineage(least)  # a join of two plain tables, whose hot keys Spark can split
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``id`` and ``label`` (smallest id reachable) of every node of the links; ends of a link may come in any order.

    Nodes without a link have no row, links of a node with itself and null ends are ignored. Hot nodes are only ever in
    aggregates with a map-side part or in joins that Spark can split.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = cut_lineage(edges.distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = cut_lineage(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(roots)
