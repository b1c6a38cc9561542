"""Walking the graph: depth of every node, lineage of chosen nodes.

Depth is the longest path, found by contraction (``levels``). Lineage joins a frontier of (start, node) pairs with edges that are stored in buckets, so that only
the frontier is shuffled. A single question walks step by step; pairs are compared with former ones only at nodes where edges meet, as others are reached once. With a
``ReachIndex`` walks go in the order of depth: every pair is met at the node's own level, when all ways to it have been walked, so it is read and expanded once
and compared with nothing. Cycles are condensed for it, so that levels exist. What a step finds is stored in the checkpoint directory; a lost executor costs one
step and plans do not grow.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..session import cut, new_folder, store
from .edges import EdgeTables, bucketed
from .levels import longest_paths
from .merge import endpoints
from .skew import lookup_join


class CyclicGraphError(ValueError):
    """Depth is undefined: some nodes lie on or behind a cycle."""


def node_depth(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """``(id, depth)`` of ``nodes(id)``: longest path from any node without predecessors; 0 for nodes without flows. Runs jobs."""
    edges = cut(flows.select("from", "to").distinct())
    ids = cut(nodes.select("id").distinct())
    depth = longest_paths(edges)
    stuck = endpoints(edges).filter("id IS NOT NULL").join(depth, "id", "left_anti")
    if some := stuck.orderBy("id").limit(20).collect():
        raise CyclicGraphError(f"{stuck.count()} nodes on or behind a cycle, first {', '.join(r.id for r in some)}")
    return ids.join(depth, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def layer_sizes(depths: DataFrame) -> DataFrame:
    """Nodes per depth."""
    return depths.groupBy("depth").agg(F.count("*").alias("nodes"))


def layer_maxima(depths: DataFrame) -> DataFrame:
    """One row: the deepest layer and the size of the largest one."""
    return layer_sizes(depths).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
                                   F.coalesce(F.max("nodes"), F.lit(0)).cast("bigint").alias("max_rows"))


_PAIR = "start_id string, id string"


def cycle_members(edges: DataFrame, among: DataFrame) -> DataFrame:
    """``(id, comp)``, stored, for the nodes of ``among(id)`` that lie on a cycle: the smallest node of their strongly connected component.

    Nodes that neither follow nor precede a cycle are trimmed by ``longest_paths`` in both directions. Then, until nothing is left, the smallest id among a node's
    ancestors colours it, and the nodes from which a colour's own node can be reached within the colour are its component. Rounds grow with the length
    of the cycles and of the ways between them. Runs jobs."""
    inner = cut(edges.join(among, edges["from"] == among["id"], "left_semi").join(among, edges["to"] == among["id"], "left_semi"))
    done = []
    while True:
        for swap in (False, True):  # off: behind no cycle, then: before none
            turned = inner.select(F.col("to").alias("from"), F.col("from").alias("to")) if swap else inner
            free = longest_paths(turned).select("id")
            for end in ("from", "to"):
                inner = inner.join(free.withColumnRenamed("id", end), end, "left_anti")
            inner = cut(inner.select("from", "to"))
        if inner.isEmpty():
            break
        colour = cut(endpoints(inner).withColumn("comp", F.col("id")))
        while True:
            pushed = inner.join(colour.withColumnRenamed("id", "from"), "from").select(F.col("to").alias("id"), "comp")
            least = pushed.unionByName(colour).groupBy("id").agg(F.min("comp").alias("comp"))
            new = cut(least.join(colour.withColumnRenamed("comp", "_old"), "id").withColumn("changed", F.col("comp") != F.col("_old")).drop("_old"))
            colour = new.drop("changed")
            if new.filter("changed").isEmpty():
                break
        same = cut(inner.join(colour.withColumnRenamed("id", "from").withColumnRenamed("comp", "a"), "from")
                   .join(colour.withColumnRenamed("id", "to").withColumnRenamed("comp", "b"), "to").filter("a = b").select("from", "to", "a"))
        found = cut(colour.filter("id = comp"))
        fresh = found
        while True:
            back = same.join(fresh.withColumnRenamed("id", "to"), "to").select(F.col("from").alias("id"), F.col("a").alias("comp")).distinct()
            fresh = cut(back.join(found, ["id", "comp"], "left_anti"))
            if fresh.isEmpty():
                break
            found = cut(found.unionByName(fresh))
        done.append(found)
        for end in ("from", "to"):
            inner = inner.join(found.select(F.col("id").alias(end)), end, "left_anti")
        inner = cut(inner.select("from", "to"))
    out = among.select("id", F.col("id").alias("comp")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return cut(out)


@dataclass(frozen=True)
class ReachIndex:
    """What lineage needs to know of a graph, built once: cycles condensed to single nodes, the arcs between those in buckets by either end, each with the level of
    its other end and whether the walk can go on there."""
    arcs: EdgeTables
    edges: EdgeTables | None
    members: DataFrame
    levels: DataFrame
    cyclic: bool

    @classmethod
    def of(cls, flows: DataFrame) -> "ReachIndex":
        """From ``flows(from, to)``. Runs jobs."""
        edges = cut(flows.select("from", "to").filter("`from` IS NOT NULL AND `to` IS NOT NULL AND `from` <> `to`").distinct())
        ids, levels = endpoints(edges), longest_paths(edges)
        stuck = cut(ids.join(levels, "id", "left_anti"))
        cyclic, arcs = not stuck.isEmpty(), edges
        members = stuck.withColumn("comp", F.col("id"))
        if cyclic:
            members = cycle_members(edges, stuck)
            for end in ("from", "to"):
                arcs = arcs.join(members.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
            arcs = cut(arcs.filter("`from` <> `to`").select("from", "to").distinct())
            alone = members.select(F.col("comp").alias("id")).distinct().withColumn("depth", F.lit(0))
            levels = cut(longest_paths(arcs).unionByName(alone).groupBy("id").agg(F.max("depth").alias("depth")))
        for end in ("from", "to"):  # the level of either end
            arcs = arcs.join(levels.select(F.col("id").alias(end), F.col("depth").alias(f"{end}_level")), end)
        out = arcs.select(F.col("from").alias("id")).distinct().withColumn("goes_on", F.lit(True))
        arcs = arcs.join(cut(out).withColumnRenamed("id", "to"), "to", "left").select(
            "from", "to", "from_level", "to_level", (F.col("from_level") > 0).alias("from_goes_on"), F.coalesce("goes_on", F.lit(False)).alias("to_goes_on"))
        return cls(EdgeTables.of(cut(arcs)), EdgeTables.of(edges) if cyclic else None, members, levels, cyclic)


def _read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)


def _walk(index: ReachIndex, first: DataFrame, near: str, far: str) -> list[str]:
    """Spread ``first(start_id, id, level, goes_on)`` along the arcs, level by level; the folders of all pairs found. A pair is stored by its level and read when the walk gets there."""
    spark = first.sparkSession
    folders: list[str] = []
    waiting: dict[int, list[str]] = defaultdict(list)

    def keep(pairs: DataFrame) -> None:
        path, seen = new_folder(spark), Observation()
        pairs.observe(seen, F.collect_set("level").alias("levels")).write.partitionBy("level").option("compression", "zstd").parquet(path)
        levels = seen.get.get("levels") or []
        for level in levels:  # as many as the graph is deep
            waiting[level].append(f"{path}/level={level}")
        if levels:
            folders.append(path)

    keep(first)
    while waiting:
        level = (min if near == "from" else max)(waiting)
        here = _read(spark, waiting.pop(level), _PAIR + ", goes_on boolean")
        step = index.arcs.step(here.filter("goes_on").select("start_id", "id").distinct(), near)
        keep(step.select("start_id", F.col(far).alias("id"), F.col(f"{far}_level").alias("level"), F.col(f"{far}_goes_on").alias("goes_on")).distinct())
    return folders


def _meeting(flows: DataFrame) -> EdgeTables:
    """The distinct edges in buckets of either end, each with whether its far end (``meets``) can be reached from there by other edges too."""
    edges = cut(flows.select("from", "to").filter("`from` IS NOT NULL AND `to` IS NOT NULL AND `from` <> `to`").distinct())
    tables = []
    for near, far in (("from", "to"), ("to", "from")):
        several = edges.groupBy(far).agg(F.count("*").alias("n")).filter("n > 1").select(far, F.lit(True).alias("meets"))
        tables.append(bucketed(lookup_join(edges, several, far).withColumn("meets", F.coalesce("meets", F.lit(False))), near))
    return EdgeTables(*tables)


def _spread(edges: EdgeTables, start: DataFrame, near: str, far: str, barred: DataFrame | None = None) -> list[str]:
    """Spread ``start(start_id, id)`` along the edges; the folders of the pairs found. A node with one edge into it is reached once, so only pairs at nodes where edges meet
    are compared with those found before. ``barred(start_id, id)`` is never entered."""
    spark = start.sparkSession
    schema = _PAIR + ", meets boolean"
    found: list[str] = []
    frontier = start
    while True:
        step = edges.step(frontier, near).select("start_id", F.col(far).alias("id"), "meets").filter("id <> start_id")
        at_meetings = step.filter("meets").distinct()
        if found:
            at_meetings = at_meetings.join(_read(spark, found, schema).filter("meets"), ["start_id", "id"], "left_anti")
        step = step.filter("NOT meets").unionByName(at_meetings)
        path = store(step if barred is None else step.join(barred, ["start_id", "id"], "left_anti"))
        frontier = _read(spark, [path], schema).select("start_id", "id")
        if frontier.isEmpty():
            return found
        found.append(path)


def lineage(flows: DataFrame | ReachIndex, starts: DataFrame) -> DataFrame:
    """``(start_id, id)`` for each id in ``starts(id)``: the node, all its ancestors, then the
    descendants that can be reached without passing through an ancestor.

    Ancestors and descendants differ but on a cycle: there all members are ancestors, so only what the start itself leads to outside goes on. The result has a
    row for each start and node in its lineage, so with all nodes as starts it is the closure of the graph. Given flows, a walk goes step by step and compares what it
    finds with former pairs at meeting points only; given a ``ReachIndex``, which pays where one graph is asked often, it goes level by level and compares nothing. Runs jobs, some for each step.
    """
    spark = starts.sparkSession
    first = store(starts.select(F.col("id").alias("start_id"), "id").distinct())
    own = _read(spark, [first], _PAIR)
    if isinstance(flows, ReachIndex):
        return _indexed_lineage(flows, own)
    edges = _meeting(flows)
    up = _spread(edges, own, "to", "from")
    if not up:
        return _read(spark, [first, *_spread(edges, own, "from", "to")], _PAIR)
    above = _read(spark, up, _PAIR)
    # a start that leads to an ancestor of its own is on a cycle; only such starts can meet an ancestor on their way down
    on_cycle = cut(edges.step(own, "from").select("start_id", F.col("to").alias("id")).join(above, ["start_id", "id"], "left_semi").select("start_id").distinct())
    barred = None if on_cycle.isEmpty() else cut(above.join(on_cycle, "start_id", "left_semi"))
    return _read(spark, [first, *up, *_spread(edges, own, "from", "to", barred)], _PAIR)


def _indexed_lineage(index: ReachIndex, own: DataFrame) -> DataFrame:
    """``lineage`` of ``own(start_id, id)``, stored, level by level."""
    spark = own.sparkSession
    # each start as a node of the condensed graph, and what the start itself leads to outside its cycle
    placed = own.join(index.members, "id", "left").withColumn("id", F.coalesce("comp", "id")) if index.cyclic else own.withColumn("comp", F.lit(None).cast("string"))
    placed = cut(placed.join(index.levels, "id").select("start_id", "id", F.col("depth").alias("level"), F.col("comp").isNotNull().alias("on_cycle")))
    up = _walk(index, placed.select("start_id", "id", "level", F.lit(True).alias("goes_on")), "to", "from")
    down_from = placed.filter("NOT on_cycle").select("start_id", "id", "level", F.lit(True).alias("goes_on"))
    if index.cyclic:
        outside = index.edges.step(placed.filter("on_cycle").select("start_id", F.col("id").alias("comp"), F.col("start_id").alias("id")), "from")
        outside = (outside.select("start_id", F.col("comp").alias("own_comp"), F.col("to").alias("id")).join(index.members, "id", "left")
                   .withColumn("id", F.coalesce("comp", "id")).filter("id <> own_comp").join(index.levels, "id")
                   .select("start_id", "id", F.col("depth").alias("level"), F.lit(True).alias("goes_on")).distinct())
        down_from = down_from.unionByName(outside)
    down = _walk(index, down_from, "from", "to")
    found = own
    if up + down:
        found = _read(spark, up + down, _PAIR)
        if index.cyclic:
            found = found.join(index.members.withColumnRenamed("id", "member"), F.col("id") == F.col("comp"), "left").select("start_id", F.coalesce("member", "id").alias("id"))
        found = found.unionByName(own)
    return found.distinct()


def focus(graph: Graph, node_id: str) -> Graph:
    """The part of a graph in the lineage of one node: its nodes, and the flows with both ends in it."""
    start = graph.spark.createDataFrame([(node_id,)], "id string")
    members = cut(lineage(graph.flows, start).select("id"))
    inside = graph.flows
    for end in ("from", "to"):
        inside = lookup_join(inside, members.withColumnRenamed("id", end), end, "left_semi", stored=True)
    return Graph(graph.categories, graph.nodes.join(members, "id", "left_semi"), inside)
