"""Small column helpers shared by the graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def non_blank(c: Column) -> Column:
    """Null in place of the empty string."""
    return F.nullif(c, F.lit(""))


def sensitivity_rank(sensitivity: Column) -> Column:
    """Rank of a sensitivity; 0 if unknown, empty or null."""
    by_rank: dict[int, list[str]] = {}
    for name, rank, _ in dims.SENSITIVITIES:
        by_rank.setdefault(rank, []).append(name)
    expr = F.when(F.lit(False), 0)
    for rank, names in by_rank.items():
        expr = expr.when(sensitivity.isin(names), rank)
    return expr.otherwise(0)


def kind_order(kind: Column) -> Column:
    """Column position of a node kind; null for an unknown kind."""
    expr = F.when(F.lit(False), 0)
    for name, order, _ in dims.KINDS:
        expr = expr.when(kind == name, order)
    return expr


def union_categories(a: Column, b: Column) -> Column:
    """Sorted, distinct union of two category arrays; null when nothing is left."""
    empty = F.array().cast("array<string>")
    merged = F.sort_array(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
    return F.when(F.size(merged) > 0, merged)


def base_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def service_id(base: Column, rel: Column) -> Column:
    return F.concat(F.lit("svc:"), base, F.lit("/"), rel)


def evidence(rel: Column, line: Column) -> Column:
    return F.concat_ws(":", rel, line.cast("string"))


def line_at(text: Column, byte_offset: Column) -> Column:
    """The line, from 1, of a byte offset into the UTF-8 form of a text."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset.cast("int")), "ISO-8859-1")
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def node_subtitle(label_count: Column, location: Column, system: Column, kind: Column) -> Column:
    """Kind of a node, or the tail of its directory when its label is not unique."""
    location, system = F.coalesce(location, F.lit("")), F.coalesce(system, F.lit(""))
    directory = F.when(location.contains("/"), F.regexp_replace(location, r"(?s)/[^/]*\z", "")).otherwise(location)
    prefix = F.concat(system, F.lit("/"))
    directory = F.when((system != "") & directory.startswith(prefix),
                       F.substring(directory, F.length(prefix) + 1, F.length(directory))).otherwise(directory)
    parts = F.split(directory, "/")
    tail = F.when(F.size(parts) > 2, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -2, 2), "/"))
                  ).otherwise(directory)
    return F.when((label_count > 1) & (location != "") & (tail != ""), tail).otherwise(kind)
