"""Adding to an existing graph: mergeable states of its three tables.

A state keeps with every "first" value the position it came from, as a pair of which the smallest wins, and category sets as they are. Smallest pairs and unions are
associative and commutative, so any number of parts, built apart and merged in any order, give the graph that one build over all rows gives. A saved state is merged with a
delta without reading what the graph was built from.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank, sensitivity_rank
from ..model import TABLES, Graph
from . import bitsets
from .merge import drop_invalid_flows


def _from(seq: str, value: Column) -> Column:
    """A value with its position; null, which is smaller than nothing, for a null value."""
    return F.when(value.isNotNull(), F.struct(F.col(seq).alias("seq"), value.alias("value")))


def category_state(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """State of ``rows(id, label, sensitivity, seq)``, by id. Labels count as they are, null ones too."""
    loudest = F.struct((-sensitivity_rank(F.col("sensitivity"))).alias("quiet"), F.col(seq).alias("seq"), F.col("sensitivity").alias("value"))
    each = rows.select("id", F.struct(F.col(seq).alias("seq"), F.col("label").alias("value")).alias("label"), loudest.alias("sensitivity"))
    return _smallest(each)


def node_state(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """State of ``rows(id, kind, label, system, location, seq)``, by id; blank labels stand for the id, other blanks do not count."""
    label = F.coalesce(non_blank(F.col("label")), F.col("id"))
    each = rows.select("id", F.struct(F.col(seq).alias("seq"), F.col("kind").alias("value")).alias("kind"), _from(seq, label).alias("label"),
                       *[_from(seq, non_blank(F.col(c))).alias(c) for c in ("system", "location")])
    return _smallest(each)


def flow_state(rows: DataFrame, seq: str = "seq", categories: list[str] | None = None) -> DataFrame:
    """State of ``rows(from, to, categories, via, evidence, seq)``, by both ends; invalid flows are dropped."""
    each = drop_invalid_flows(rows).select("from", "to", "categories", *[_from(seq, non_blank(F.col(c))).alias(c) for c in ("via", "evidence")])
    return _smallest(each, ("from", "to"), categories)


def _smallest(states: DataFrame, key: tuple[str, ...] = ("id",), categories: list[str] | None = None) -> DataFrame:
    """One state per key: the smallest of each pair, the union of category sets. Combines before the shuffle."""
    pairs = [c for c in states.columns if c not in (*key, "categories")]
    if "categories" not in states.columns:
        return states.groupBy(*key).agg(*[F.min(c).alias(c) for c in pairs])
    ids = sorted(categories) if categories is not None else bitsets.ids_of(states)
    merged = states.withColumns(bitsets.encode("categories", ids)).groupBy(*key).agg(*bitsets.united(ids), *[F.min(c).alias(c) for c in pairs])
    return merged.select(*key, bitsets.decode(ids).alias("categories"), *pairs)


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two states of one table as one."""
    return _smallest(one.unionByName(other), tuple(c for c in ("id", "from", "to") if c in one.columns))


def category_rows(state: DataFrame) -> DataFrame:
    return state.select("id", F.col("label.value").alias("label"), F.col("sensitivity.value").alias("sensitivity"))


def node_rows(state: DataFrame) -> DataFrame:
    filled = [F.coalesce(f"{c}.value", F.lit("")).alias(c) for c in ("system", "location")]
    return state.select("id", F.col("kind.value").alias("kind"), F.col("label.value").alias("label"), *filled)


def flow_rows(state: DataFrame) -> DataFrame:
    return state.select("from", "to", "categories", *[F.coalesce(f"{c}.value", F.lit("")).alias(c) for c in ("via", "evidence")])


@dataclass(frozen=True)
class GraphState:
    """The states of a graph's tables. Positions (``seq``) have one type in all parts and tell the rows of all parts apart."""
    categories: DataFrame
    nodes: DataFrame
    flows: DataFrame

    @classmethod
    def of(cls, categories: DataFrame, nodes: DataFrame, flows: DataFrame, seq: str = "seq") -> "GraphState":
        """From raw rows as ``merge_categories``, ``merge_nodes`` and ``merge_flows`` take them."""
        return cls(category_state(categories, seq), node_state(nodes, seq), flow_state(flows, seq))

    def merge(self, other: "GraphState") -> "GraphState":
        return GraphState(*[merge_states(getattr(self, t), getattr(other, t)) for t in TABLES])

    def graph(self) -> Graph:
        """The graph, as one build over all rows would have given it."""
        return Graph(category_rows(self.categories), node_rows(self.nodes), flow_rows(self.flows))

    def save(self, path: str) -> None:
        """Make this the state that ``path`` holds. A new version is written beside the old one and named as the current one at the end, so a write that fails
        leaves the old version in force. Versions are kept until somebody removes them."""
        spark, version = self.flows.sparkSession, uuid.uuid4().hex
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{version}/{name}")
        last = _versions(spark, path)
        spark.createDataFrame([(len(last), version)], "turn int, version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "GraphState":
        versions = _versions(spark, path)
        if not versions:
            raise FileNotFoundError(f"no graph state at {path}")
        return cls(*[spark.read.parquet(f"{path}/{versions[-1]}/{t}") for t in TABLES])

    def upsert(self, path: str) -> "GraphState":
        """Merge this into the state that ``path`` holds, if it holds one, and save the result; one writer at a time."""
        spark = self.flows.sparkSession
        merged = GraphState.load(spark, path).merge(self) if _versions(spark, path) else self
        merged.save(path)
        return GraphState.load(spark, path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions in the order in which they were saved, one row each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return [r.version for r in spark.read.schema("turn int, version string").parquet(f"{path}/versions").orderBy("turn").collect()]
