"""Questions over a graph, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.merge import collapse, prune_orphans, valid_edges
from ..operators.sensitivity import filter_by_sensitivity, with_sensitivity
from ..operators.weights import kind_totals, node_throughput, stacked_offsets


def blackbox(graph: Graph) -> Graph:
    """All services as one Application node."""
    return collapse(graph, "service", "svc:app", "Application")


@dataclass(frozen=True)
class FlowVolume:
    nodes: DataFrame
    ribbons: DataFrame
    kinds: DataFrame


def flow_volume(graph: Graph) -> FlowVolume:
    """Throughput per node, weight, offsets and dominant sensitivity per flow, totals per kind."""
    nodes = node_throughput(graph.nodes, graph.flows)
    ribbons = with_sensitivity(stacked_offsets(graph.nodes, graph.flows), graph.categories)
    return FlowVolume(nodes, ribbons, kind_totals(nodes))


def view(graph: Graph, sensitivities: Iterable[str]) -> Graph:
    """The graph as seen with only some sensitivities switched on: visible flows between existing
    nodes, with their sensitivity, and the nodes that visible flows touch."""
    visible = filter_by_sensitivity(graph.flows, graph.categories, sensitivities)
    nodes = prune_orphans(graph.nodes, visible)
    # a visible flow's end is touched, so it is in the pruned nodes whenever it is a node at all
    drawn = with_sensitivity(valid_edges(visible, graph.nodes), graph.categories, "public")
    return Graph(graph.categories, nodes, drawn)


def graph_summary(graph: Graph) -> DataFrame:
    """One row: node and flow counts, and the line that reports them."""
    counts = (graph.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("f"))
              .unionByName(graph.flows.select(F.lit(0).alias("n"), F.lit(1).alias("f")))
              .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("nodes"),
                   F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("flows")))
    return counts.withColumn("summary", F.format_string("%d nodes, %d flows", "nodes", "flows"))
