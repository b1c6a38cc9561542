"""Rows made for reading: labels, subtitles, search marks, neighbours, sensitive destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_subtitle, non_blank
from ..model import Graph
from ..session import cut
from .sensitivity import dominant_sensitivity, judged_lists
from .skew import lookup_join, null_safe_join


def adjacency(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Neighbours as rows ``(id, direction, neighbour)``, direction ``in`` or ``out``; a node without
    neighbours in a direction has one row with a null neighbour.

    Rows, not lists: a hub has as many neighbours as a third of the graph. Which nodes are alone comes from one count by id for both directions, a hub's ends combined before
    it; a node id that repeats has its rows as often.
    """
    def end(direction: str, near: str):
        return F.struct(F.col(near).alias("id"), F.lit(0).alias("_nodes"), F.lit(int(direction == "in")).alias("_in"), F.lit(int(direction == "out")).alias("_out"))

    ends = flows.select(F.explode(F.array(end("in", "to"), end("out", "from"))).alias("x")).select("x.*").filter("id IS NOT NULL")  # a null end meets no node
    marks = nodes.select("id", F.lit(1).alias("_nodes"), F.lit(0).alias("_in"), F.lit(0).alias("_out")).unionByName(ends)
    met = marks.groupBy("id").agg(F.sum("_nodes").cast("int").alias("_nodes"), F.max("_in").alias("_in"), F.max("_out").alias("_out"))
    lacking = F.concat(F.expr("array_repeat('in', if(_in = 0, _nodes, 0))"), F.expr("array_repeat('out', if(_out = 0, _nodes, 0))"))
    rows = met.select("id", F.explode(lacking).alias("direction"), F.lit(None).cast("string").alias("neighbour"))
    for direction, near, far in (("in", "to", "from"), ("out", "from", "to")):
        rows = rows.unionByName(flows.select(F.col(near).alias("id"), F.lit(direction).alias("direction"), F.col(far).alias("neighbour")))
    return rows


def search_nodes(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes with ``matched``: the label (id if blank) contains the term, ignoring case."""
    shown = F.lower(F.coalesce(non_blank(F.col("label")), F.col("id")))
    return nodes.withColumn("matched", shown.contains(term.lower()))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("label_count"))


def with_label_count(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of nodes that share their label, a null label included. A grouped count joined back, not a
    window: one label ("index.js") may cover a third of all nodes."""
    return null_safe_join(nodes, label_counts(nodes), "label")


def with_subtitle(nodes: DataFrame) -> DataFrame:
    subtitle = node_subtitle(F.col("label_count"), F.col("location"), F.col("system"), F.col("kind"))
    return with_label_count(nodes).withColumn("subtitle", subtitle)


def with_labels(flows: DataFrame, categories: DataFrame, fallback_to_id: bool = False) -> DataFrame:
    """Flows with ``labels``: the labels of their categories in category order, joined by ", ". A
    category that is unknown or has a blank label is left out, or shows its id."""
    chosen = "labels_or_ids" if fallback_to_id else "labels"
    judged = judged_lists(flows, categories).select("categories", F.col(chosen).alias("labels"))
    return null_safe_join(flows.drop("labels"), judged, "categories")


def edge_labels(flows: DataFrame, categories: DataFrame) -> DataFrame:
    """``(from, to, labels)``; unknown and blank labels are left out."""
    return with_labels(flows, categories).select("from", "to", "labels")


def flow_details(graph: Graph) -> DataFrame:
    """Flows with the labels of both ends (id if blank or unknown) and their category labels (id if
    unknown), via and evidence."""
    names = graph.nodes.select("id", non_blank(F.col("label")).alias("name"))
    rows = with_labels(graph.flows, graph.categories, True).select("from", "to", "labels", "via", "evidence")
    names = cut(names)
    for end in ("from", "to"):
        own = names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
        rows = lookup_join(rows, own, end, stored=True)
    return rows.select(
        "from", "to", F.coalesce("_from", "from").alias("from_label"), F.coalesce("_to", "to").alias("to_label"),
        "labels", "via", "evidence")


def node_details(nodes: DataFrame) -> DataFrame:
    """Label (id if blank), kind, system and location of each node, with kind and system on one line."""
    kind = F.initcap("kind")
    system = non_blank(F.col("system"))
    return nodes.select(
        "id", F.coalesce(non_blank(F.col("label")), F.col("id")).alias("title"),
        F.concat(kind, F.coalesce(F.concat(F.lit(" · "), system), F.lit(""))).alias("line"), "location")


def sensitive_leaks(graph: Graph) -> DataFrame:
    """Flows into a log sink or third party that carry anything but public data, with their dominant
    sensitivity."""
    outside = (graph.nodes.filter(F.col("kind").isin("sink", "external"))
               .select(F.col("id").alias("to"), F.col("kind").alias("to_kind"), F.col("label").alias("to_label")))
    loud = dominant_sensitivity(graph.flows, graph.categories).filter(~F.col("sensitivity").isin("", "public"))
    return lookup_join(loud, outside, "to", "inner").select("from", "to", "to_kind", "to_label", "sensitivity")
