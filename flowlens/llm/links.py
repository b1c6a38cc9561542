"""Connected components of a large graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)`` (longs): the smallest id it is connected with.

    Rounds of two steps keep the components and shorten the paths: every id's larger neighbours are linked to the
    smallest id of its neighbourhood, then its smaller neighbours are, until nothing changes. Minima combine
    before the shuffle, and each round's edges are stored, so a lost executor costs one round. The number of rounds grows with the
    logarithm of the longest path.
    """
    edges = cut(_tidy(edges.select("a", "b")))
    last = None
    while True:
        small = cut(_small_star(_large_star(edges)))
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        edges, last = small, now
    return (small.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(small.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, larger end first."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every strictly larger neighbour of an id to the smallest of the id and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    # minima are stored, so that the join has two bare exchanges and a hub's rows are split
    low = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a"), F.least("a", "low").alias("low")))
    return _tidy(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link an id and its smaller neighbours to the smallest of them."""
    edges = cut(edges)
    low = cut(edges.groupBy("a").agg(F.min("b").alias("low")))
    near = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _tidy(near.union(low.select("a", F.col("low").alias("b"))))
