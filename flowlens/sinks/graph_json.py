"""A graph as one JSON document, written in parts.

The document is a sequence of lines in order: section opening, one line per row, section closing.
Spark sorts and writes the lines in parallel; the part files, concatenated in name order, are the
document ``{"categories": [...], "nodes": [...], "flows": [...]}``. Blank optional fields are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank
from ..model import Graph
from ..session import cut


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _optional(name: str) -> Column:
    return non_blank(F.col(name)).alias(name)


def _sections(graph: Graph) -> list[tuple[str, DataFrame, list[str], list[Column]]]:
    """Name, rows, sort key and fields in document order."""
    categories = F.when(F.size("categories") > 0, F.col("categories")).alias("categories")
    return [
        ("categories", graph.categories, ["id"], [_required("id"), _required("label"), _optional("sensitivity")]),
        ("nodes", graph.nodes, ["id"], [_required("id"), _required("kind"), _required("label"),
                                        _optional("system"), _optional("location")]),
        ("flows", graph.flows, ["from", "to"], [_required("from"), _required("to"), categories,
                                                _optional("via"), _optional("evidence")]),
    ]


def json_lines(graph: Graph) -> DataFrame:
    """``(section, step, key, line)``; ordered by the first three, the lines are the document. Runs jobs that store the rows."""
    parts = []
    last = len(_sections(graph)) - 1
    for number, (name, rows, key, fields) in enumerate(_sections(graph)):
        sort_key = F.array(*[F.col(k) for k in key])
        body = cut(rows.select(sort_key.alias("key"), F.to_json(F.struct(*fields)).alias("line")))  # read twice
        first = body.agg(F.min("key").alias("first"))  # one row
        # every row but the first follows a comma
        comma = F.when(F.col("key") == F.col("first"), "    ").otherwise("  , ")
        items = (body.withColumn("k", F.lit(1)).join(F.broadcast(first.withColumn("k", F.lit(1))), "k")
                 .select(F.lit(number).alias("section"), F.lit(1).alias("step"), "key",
                         F.concat(comma, "line").alias("line")))
        opening = ("{\n" if number == 0 else "") + f'  "{name}": ['
        closing = "  ]" + ("," if number < last else "\n}")
        none = F.array().cast("array<string>")
        frame = graph.spark.createDataFrame([(number, 0, opening), (number, 2, closing)],
                                            "section int, step int, line string")
        parts += [frame.select("section", "step", none.alias("key"), "line"), items]
    return reduce(DataFrame.unionByName, parts)


def write_graph_json(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """Write the document as text parts below ``path``."""
    json_lines(graph).orderBy("section", "step", "key").select("line").write.mode(mode).text(path)
