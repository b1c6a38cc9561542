"""From calls or files to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import BUILTIN, Dictionaries
from ..model import Graph
from ..operators.merge import call_edges, edges_to_graph, relabel_nodes
from ..session import cut
from ..sources.calls import extract_calls
from ..sources.files import ObservedStats
from ..sources.infra import store_relabels
from ..sources.tree import list_tree, read_content, routed_files
from .views import graph_summary


def graph_from_calls(calls: DataFrame, infra_files: DataFrame | None = None, d: Dictionaries = BUILTIN,
                     store_edges: bool = True) -> Graph:
    """The graph of a ``calls`` table, with store labels refined by ``infra_files``.

    The merged (service, target) table is written to the checkpoint directory, so that calls are
    classified once although nodes, categories and both flow directions all come from it. With
    ``store_edges=False`` nothing runs until a table is used.
    """
    edges = call_edges(calls, d)
    graph = edges_to_graph(cut(edges) if store_edges else edges, d)
    nodes = graph.nodes
    if infra_files is not None:
        relabels = store_relabels(infra_files, d)  # one row per store node named in the dictionary
        nodes = relabel_nodes(nodes, cut(relabels) if store_edges else relabels)
    return Graph(graph.categories, nodes, graph.flows)


def graph_from_files(files: DataFrame, d: Dictionaries = BUILTIN) -> Graph:
    """The graph of a ``files`` table with ``content``, ``language`` and ``is_infra``."""
    infra = files.filter("is_infra").select("root_idx", F.col("segments").alias("walk_key"),
                                            F.col("content").cast("string").alias("src"))
    return graph_from_calls(extract_calls(files.filter("NOT is_infra")), infra, d)


def scan(spark: SparkSession, roots: list[str], d: Dictionaries = BUILTIN) -> tuple[Graph, DataFrame]:
    """Scan directory trees: their graph, and one row of statistics.

    Only paths are stored between the steps; the statistics are metrics of the job that stores them. Code and infrastructure files are read apart, each once
    per use of the graph's tables; the calls themselves are merged before anything is stored.
    """
    stats = ObservedStats(routed_files(list_tree(spark, roots)))
    routed = cut(stats.watched)
    code = read_content(routed.filter("readable AND NOT is_infra AND language IS NOT NULL"))
    infra = read_content(routed.filter("readable AND is_infra"))
    infra_files = infra.select("root_idx", F.col("segments").alias("walk_key"),
                               F.col("content").cast("string").alias("src"))
    return graph_from_calls(extract_calls(code), infra_files, d), stats.frame()


def scan_summary(stats: DataFrame, graph: Graph) -> str:
    """The line that reports a scan."""
    s, g = stats.first(), graph_summary(graph).first()
    return (f"{s.files} files scanned ({s.parsed} parsed, {s.infra} infra) across {len(s.languages)} languages; "
            f"{g.summary}")
