"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import saved


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; here a > b holds in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the least node reached.

    Alternates large and small stars until nothing changes. Each round is a written table. Hot nodes only make a hot
    side of a join, which Spark splits. Raises RuntimeError if links still change after `rounds` rounds (their number
    grows as the logarithm of the largest component).
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = edges.agg(mark.alias("m")).first().m
    for k in range(rounds):
        if not before[0]:
            break
        edges = saved(_small_star(_large_star(edges)), f"{folder}/edges-{k}")
        now = edges.agg(mark.alias("m")).first().m
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
