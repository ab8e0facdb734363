"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copycensus.session import materialize


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _distinct_edges(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return _distinct_edges(joined.select("v", F.col("m")).toDF("u", "v").union(joined.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component_id`` (the least node reachable) for every node that has a link to another.

    Ends when a pair of steps changes nothing; each step is written, so a lost executor repeats one step. Null ends, loops
    and repeated links are ignored; no links give no rows.
    """
    edges = materialize(_distinct_edges(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    before = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "node")
    return stars.union(edges.select("v", "v").distinct().toDF("node", "component_id"))
