"""Longest paths: contraction of chains by max-plus doubling, then peeling of what is left.

Every round does two things. Nodes whose predecessors are all known become known themselves, and arcs that leave known nodes turn into a lower bound for
the nodes they enter. A node with one unknown predecessor, whose bound cannot exceed the way through it, just follows that predecessor; all such nodes are moved up to
the first one that does not follow, in doubling steps (anchor of the anchor, sum of the distances), and their arcs start there. Parallel
arcs keep the largest weight, which makes new followers out of nodes where branches meet. So rounds grow with the logarithm of a chain, and with the number of
levels only where every level has nodes that wait for several unknown ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def longest_paths(edges: DataFrame) -> DataFrame:
    """``(id, depth)``, stored, for the ends of ``edges(from, to)``: the longest path from any node without predecessors. Nodes on or behind a cycle have none and are left out.
    Runs jobs in every round; each stores the nodes and arcs that are still open, so a lost executor costs one step."""
    arcs = cut(edges.select("from", "to").filter("`from` IS NOT NULL AND `to` IS NOT NULL").distinct().withColumn("w", F.lit(1)))
    level = cut(_ids(arcs, "from").join(_ids(arcs, "to"), "id", "left_anti").withColumn("depth", F.lit(0)))
    known, followers = [level], []
    bound = level.limit(0).withColumnRenamed("depth", "bound")
    while True:
        # level and bound are stored and the arcs are a bare exchange, so a hub's arcs are split
        seen = cut(arcs.join(level.withColumnRenamed("id", "from"), "from", "left").select("from", "to", "w", "depth"))
        entered = seen.filter("depth IS NOT NULL").groupBy(F.col("to").alias("id")).agg(F.max(F.col("depth") + F.col("w")).alias("bound"))
        bound = cut(bound.unionByName(entered).groupBy("id").agg(F.max("bound").alias("bound")))
        arcs = seen.filter("depth IS NULL").select("from", "to", "w")
        chains = _contract(_followers(arcs, bound))
        if chains is not None:
            followers.append((len(known), chains))
            arcs = cut(_rewritten(arcs, chains))
            bound = bound.join(chains, "id", "left_anti")
        waiting = cut(_ids(arcs, "to"))
        level = cut(bound.join(waiting, "id", "left_anti").withColumnRenamed("bound", "depth"))
        bound = bound.join(waiting, "id", "left_semi")
        if level.isEmpty() and chains is None:
            break
        known.append(level)
        if waiting.isEmpty():
            break
    depth = known[0]
    for part in known[1:]:
        depth = depth.unionByName(part)
    for _, chains in reversed(followers):  # an anchor may follow in a later round
        found = chains.join(cut(depth).withColumnRenamed("id", "anchor"), "anchor").select("id", (F.col("depth") + F.col("away")).alias("depth"))
        depth = depth.unionByName(found)
    return cut(depth)


def _ids(arcs: DataFrame, end: str) -> DataFrame:
    return arcs.select(F.col(end).alias("id")).distinct()


def _followers(arcs: DataFrame, bound: DataFrame) -> DataFrame:
    """``(id, anchor, away)``: nodes with one open predecessor that no other way reaches later. Open nodes have a depth of 1 at least."""
    single = arcs.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n"), F.min("from").alias("anchor"), F.max("w").alias("away")).filter("n = 1")
    of_anchor = bound.select(F.col("id").alias("anchor"), F.col("bound").alias("_low"))
    judged = single.join(bound, "id", "left").join(of_anchor, "anchor", "left")
    return judged.filter("coalesce(bound, 0) <= greatest(1, coalesce(_low, 1)) + away").select("id", "anchor", "away")


def _contract(chains: DataFrame) -> DataFrame | None:
    """Followers with the first node up the chain that does not follow, or None if there are none. What runs in a circle has none and is left out."""
    chains = cut(chains)
    size = chains.count()
    if not size:
        return None
    for _ in range(size.bit_length() + 1):
        up = chains.select(F.col("id").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("away").alias("_away"))
        chains = cut(chains.select("id", "anchor", "away").join(up, "anchor", "left").select(
            "id", F.coalesce("_anchor", "anchor").alias("anchor"), (F.col("away") + F.coalesce("_away", F.lit(0))).alias("away"), F.col("_anchor").isNotNull().alias("moved")))
        if chains.filter("moved").isEmpty():
            break
    chains = chains.filter("NOT moved").select("id", "anchor", "away")
    return None if chains.isEmpty() else chains


def _rewritten(arcs: DataFrame, chains: DataFrame) -> DataFrame:
    """Arcs without those into followers; those that leave followers leave their anchors."""
    into = chains.select(F.col("id").alias("to"))
    left = arcs.join(into, "to", "left_anti").join(chains.withColumnRenamed("id", "from"), "from", "left")
    return left.select(F.coalesce("anchor", "from").alias("from"), "to", (F.col("w") + F.coalesce("away", F.lit(0))).alias("w")).groupBy("from", "to").agg(F.max("w").alias("w"))
