"""Building a graph: merge rules, relabelling, pruning, collapsing.

Rows that describe the same thing are merged by its key. "First" always means smallest ``seq``, any
orderable column, so the result does not depend on how the input is partitioned. Every rule is an
associative aggregate: Spark combines on the map side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BUILTIN, Dictionaries, dim_category
from ..functions.identifiers import categories_in
from ..functions.targets import target_system, with_target
from ..functions.text import base_name, evidence, non_blank, sensitivity_rank, service_id
from ..model import Graph
from ..session import cut
from . import bitsets
from .skew import lookup_join

CALL_SEQ = "struct(root_idx, rel, start_byte, -end_byte AS neg_end)"


def _first(value: Column, seq: str) -> Column:
    return F.min_by(value, F.col(seq))


def _first_non_blank(column: str, seq: str) -> Column:
    """First value that is neither null nor empty; empty if there is none."""
    order = F.when(non_blank(F.col(column)).isNotNull(), F.col(seq))  # null order is ignored
    return F.coalesce(F.min_by(column, order), F.lit(""))


def merge_categories(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per category id: first label, highest sensitivity (first of equals)."""
    loudest = F.struct(-sensitivity_rank(F.col("sensitivity")), F.col(seq))
    return rows.groupBy("id").agg(_first(F.col("label"), seq).alias("label"),
                                  F.min_by("sensitivity", loudest).alias("sensitivity"))


def merge_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per node id: kind and label of the first row (the id if that label is blank), first
    non-blank system and location."""
    label = F.coalesce(non_blank(F.col("label")), F.col("id"))
    return rows.groupBy("id").agg(
        _first(F.col("kind"), seq).alias("kind"),
        _first(label, seq).alias("label"),
        _first_non_blank("system", seq).alias("system"),
        _first_non_blank("location", seq).alias("location"))


def drop_invalid_flows(flows: DataFrame) -> DataFrame:
    """Drop flows with an empty end and flows from a node to itself."""
    return flows.filter("coalesce(`from`, '') <> '' AND coalesce(`to`, '') <> '' AND `from` <> `to`")


def merge_flows(rows: DataFrame, seq: str = "seq", categories: list[str] | None = None) -> DataFrame:
    """One row per (from, to): sorted union of categories, first non-blank via and evidence.

    Rows that agree in all but categories and ``seq`` combine first, in a hash table if ``seq`` is a number; strings are only chosen among what is left. ``categories``
    are the ids that may occur; without them a job collects those that do."""
    valid = drop_invalid_flows(rows)
    ids = sorted(categories) if categories is not None else bitsets.ids_of(valid)
    alike = (valid.withColumns(bitsets.encode("categories", ids)).groupBy("from", "to", "via", "evidence")
             .agg(F.min(seq).alias("_seq"), *bitsets.united(ids)))
    merged = alike.groupBy("from", "to").agg(
        *bitsets.united(ids), _first_non_blank("via", "_seq").alias("via"), _first_non_blank("evidence", "_seq").alias("evidence"))
    return merged.select("from", "to", bitsets.decode(ids).alias("categories"), "via", "evidence")


def prune_orphans(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Nodes touched by at least one flow."""
    return nodes.join(endpoints(flows), "id", "left_semi")


def has_node(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(id)`` with ``exists``: is there such a node?"""
    return (ids.join(nodes.select("id", F.lit(True).alias("exists")), "id", "left")
            .withColumn("exists", F.coalesce("exists", F.lit(False))))


def endpoints(flows: DataFrame) -> DataFrame:
    """Distinct ids at either end of a flow."""
    return flows.select(F.explode(F.array("from", "to")).alias("id")).distinct()


def valid_edges(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows whose two ends both exist as nodes."""
    ids = cut(nodes.select("id"))
    for end in ("from", "to"):
        flows = lookup_join(flows, ids.select(F.col("id").alias(end)), end, "left_semi", stored=True)
    return flows


def relabel_nodes(nodes: DataFrame, relabels: DataFrame) -> DataFrame:
    """Overwrite labels by ``relabels(id, label)``, one row per id; unknown ids are ignored."""
    new = relabels.select("id", F.col("label").alias("_label"))
    return (nodes.join(new, "id", "left")
            .withColumn("label", F.coalesce("_label", "label")).drop("_label"))


def ordered(graph: Graph) -> Graph:
    """Nodes by id, flows by (from, to), categories by id. Only worth it right before writing."""
    return Graph(graph.categories.orderBy("id"), graph.nodes.orderBy("id"), graph.flows.orderBy("from", "to"))


def finalize(graph: Graph) -> Graph:
    """Drop untouched nodes and sort all three tables."""
    return ordered(Graph(graph.categories, prune_orphans(graph.nodes, graph.flows), graph.flows))


def keep_classified(calls: DataFrame, d: Dictionaries = BUILTIN) -> DataFrame:
    """Calls that have a target and name at least one category, with both."""
    # explode keeps a row once per element: here its category list, or nothing if the list is empty
    named = F.filter(F.array(categories_in(F.col("args_text"), d)), lambda c: F.size(c) > 0)
    return (with_target(calls, d).filter(F.col("target_id").isNotNull())
            .select("*", F.explode(named).alias("categories")))


def call_edges(calls: DataFrame, d: Dictionaries = BUILTIN) -> DataFrame:
    """One row per (service, target): categories, and the columns of the first call between them.

    The only shuffles over calls. All calls of one callee in one file to one target combine in hash tables before the first; what the second sees is as small as the
    graph, and everything else in the graph follows from it. The order of calls in a file is packed into one number: files are shorter
    than 2^47 bytes, calls than 2^40.
    """
    ids = [c for c, _, _ in d.categories()]
    order = F.expr(f"cast(start_byte AS decimal(19,0)) * {1 << 71}BD + cast({(1 << 40) - 1} - (end_byte - start_byte) AS decimal(19,0)) * {1 << 31}BD + line").cast("decimal(38,0)")
    kept = keep_classified(calls, d).withColumns(bitsets.encode("categories", ids))
    callees = (kept.select(service_id(F.col("base"), F.col("rel")).alias("service_id"), "target_id", "root_idx", "base", "rel", "callee",
                           "target_label", "target_kind", order.alias("_order"), *bitsets.encode("", ids))
               .groupBy("service_id", "target_id", "root_idx", "base", "rel", "callee", "target_label", "target_kind")
               .agg(F.min("_order").alias("_order"), *bitsets.united(ids)))
    line = F.expr(f"cast(_order % {1 << 31}BD AS int)")
    first = F.struct(F.struct("root_idx", "rel", F.col("_order").alias("at")).alias("seq"), F.col("callee").alias("via"),
                     evidence(F.col("rel"), line).alias("evidence"), F.col("base"), F.col("rel"), F.col("target_label"), F.col("target_kind"))
    return (callees.groupBy("service_id", "target_id").agg(F.min(first).alias("first"), *bitsets.united(ids))
            .select("service_id", "target_id", bitsets.decode(ids).alias("categories"), "first.*"))


def edges_to_graph(edges: DataFrame, d: Dictionaries = BUILTIN) -> Graph:
    """The graph of the call edges: user to service without, service to target with evidence."""
    spark = edges.sparkSession
    blank = F.lit("")
    outward = edges.select(F.col("service_id").alias("from"), F.col("target_id").alias("to"),
                           "categories", "via", "evidence")
    ids = [c for c, _, _ in d.categories()]
    inward = (edges.withColumns(bitsets.encode("categories", ids)).groupBy("service_id").agg(*bitsets.united(ids))
              .withColumn("categories", bitsets.decode(ids)).select(F.lit("source:user").alias("from"), F.col("service_id").alias("to"), "categories",
                      blank.alias("via"), blank.alias("evidence")))

    location = F.concat_ws("/", "base", "rel")
    services = edges.select(
        F.col("service_id").alias("id"), F.lit("service").alias("kind"), base_name(F.col("rel")).alias("label"),
        F.col("base").alias("system"), location.alias("location"), "seq")
    targets = edges.select(
        F.col("target_id").alias("id"), F.col("target_kind").alias("kind"), F.col("target_label").alias("label"),
        target_system(F.col("target_kind")).alias("system"), blank.alias("location"), "seq")
    # every service and target has a flow by construction, and the user has one as soon as there is any
    user = edges.limit(1).select(
        F.lit("source:user").alias("id"), F.lit("source").alias("kind"), F.lit("User").alias("label"),
        F.lit("People").alias("system"), blank.alias("location"))
    nodes = merge_nodes(services.unionByName(targets)).unionByName(user)

    used = edges.select(F.explode("categories").alias("id")).distinct()
    categories = dim_category(spark, d).join(used, "id", "left_semi")
    return Graph(categories, nodes, outward.unionByName(inward))


def remap_ends(flows: DataFrame, ids: DataFrame, new_id: str) -> DataFrame:
    """Replace both ends by ``new_id`` where they are in ``ids(id)``."""
    ids = cut(ids)
    for end in ("from", "to"):
        hit = ids.select(F.col("id").alias(end), F.lit(True).alias("_hit"))
        flows = (lookup_join(flows, hit, end, "left", stored=True)
                 .withColumn(end, F.when(F.col("_hit"), F.lit(new_id)).otherwise(F.col(end))).drop("_hit"))
    return flows


def collapse(graph: Graph, kind: str = "service", new_id: str = "svc:app", label: str = "Application") -> Graph:
    """Black box: all nodes of one kind become a single node; flows are merged again without via and
    evidence, flows inside the box vanish, untouched nodes go."""
    boxed = graph.nodes.filter(F.col("kind") == kind).select("id")
    flows = remap_ends(graph.flows.select("from", "to", "categories"), boxed, new_id)
    ids = bitsets.ids_of(graph.flows)
    merged = (drop_invalid_flows(flows).withColumns(bitsets.encode("categories", ids)).groupBy("from", "to").agg(*bitsets.united(ids))
              .select("from", "to", bitsets.decode(ids).alias("categories"), F.lit("").alias("via"), F.lit("").alias("evidence")))

    box = graph.spark.createDataFrame([(0, new_id, kind, label, "", "")],
                                      "seq int, id string, kind string, label string, system string, location string")
    others = graph.nodes.filter(~F.col("kind").eqNullSafe(kind)).withColumn("seq", F.lit(1))
    nodes = merge_nodes(box.unionByName(others))
    return Graph(graph.categories, prune_orphans(nodes, merged), merged)
